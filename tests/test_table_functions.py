"""User table functions in SQL: nulls, groups, analysed schemas and refusals."""

import pytest

from veraframe.functions import table_functions as TF


def test_runs_of_groups_in_any_input_order(spark):
    rows = [("b", 9), ("a", 3), (None, 1), ("a", 1), ("b", None), ("a", 2), ("a", 7), ("a", 7), (None, 2), ("b", 5)]
    t = spark.createDataFrame(rows, "g string, at int").repartition(3)
    TF.register_runs(spark, "runs_at", "g", "at")
    got = spark.sql("SELECT * FROM runs_at(TABLE(SELECT *, 1 AS n FROM {t}))", t=t)
    assert [c for c, _ in got.dtypes] == ["g", "first", "last", "n"]
    assert set(map(tuple, got.collect())) == {("a", 1, 3, 3), ("a", 7, 7, 2), ("b", 5, 5, 1), ("b", 9, 9, 1), (None, 1, 2, 2)} and got.count() == 5
    assert spark.sql("SELECT * FROM runs_at(TABLE(SELECT * FROM {t}))", t=t.limit(0)).count() == 0
    with pytest.raises(Exception, match="no column at"):
        spark.sql("SELECT * FROM runs_at(TABLE(SELECT g FROM {t}))", t=t).collect()


def test_detections_by_lateral(spark):
    t = spark.createDataFrame([(1, "xax"), (2, None), (3, "")], "id int, content string")
    TF.register_detector(spark, "letters_x", lambda c: ((i, 0.5) for i, ch in enumerate(c) if ch == "x"))
    got = spark.sql("SELECT t.id, d.* FROM {t} t, LATERAL letters_x(t.content) d", t=t)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0.5), (1, 2, 0.5)]
