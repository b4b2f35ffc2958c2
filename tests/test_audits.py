"""Audits on small tables: nulls, ties, empty tables, and references outside the split."""

import itertools

import pytest

from veraframe.operators import audits as A

ROWS = [("a", "original", 1.0, 5.0), ("b", "original", 2.0, 5.0), ("c", "m1", 2.0, 5.0), ("d", "m1", 3.0, 5.0), ("e", "m2", None, 5.0), ("f", "m2", 0.0, 5.0)]
SCHEMA = "sample_id string, class string, value double, flat double"


def test_methods_against_originals_count_ties_as_half(spark):
    found = {r.method: r.auroc for r in A.against_originals(spark.createDataFrame(ROWS, SCHEMA).filter("value IS NOT NULL"), "class", "value", ("m1", "m2", "m3")).collect()}
    real = [v for _, c, v, _ in ROWS if c == "original"]

    def area(kept):
        fake = [v for _, c, v, _ in ROWS if c in kept and v is not None]
        return sum((f > r) + (f == r) / 2 for f, r in itertools.product(fake, real)) / (len(fake) * len(real))

    assert found["m3"] is None
    assert (found["m1"], found["m2"], found["fake"]) == pytest.approx((area({"m1"}), area({"m2"}), area({"m1", "m2"})))


def test_correlation_of_a_flat_factor_is_zero_and_of_two_rows_null(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {(r.factor, r.against): (r.n, r.rho) for r in A.factor_rank_correlations(docs, ["value", "flat"], ["flat"]).collect()} == {("value", "flat"): (5, 0.0), ("flat", "flat"): (6, 0.0)}
    two = A.factor_rank_correlations(docs.limit(2), ["value"], ["value"]).collect()
    assert [(r.n, r.rho) for r in two] == [(2, None)]
    same = A.factor_rank_correlations(docs, ["value"], ["value"]).collect()
    assert same[0].rho == pytest.approx(1.0)


def test_a_null_group_has_its_quantiles(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None), ("y", 7.0)], "g string, v double")
    found = {r.g: (r.n, r.min, r.median, r.max, r["mean"]) for r in A.quantile_summary(rows, "v", ["g"]).collect()}
    assert found == {None: (2, 1.0, 2.0, 3.0, 2.0), "y": (1, 7.0, 7.0, 7.0, 7.0)}


def test_balance_without_real_rows_has_no_ratio(spark):
    rows = spark.createDataFrame([("t", "fake"), ("v", "real"), ("v", "fake"), ("v", "fake")], "split string, label string")
    assert {r.split: (r.samples, r.real, r.fake, r.fake_to_real) for r in A.split_balance(rows).collect()} == {"t": (1, 0, 1, None), "v": (3, 1, 2, 2.0)}


def test_crop_problems(spark):
    official = spark.createDataFrame([("a", "train"), ("b", "val"), ("gone", "train")], "sample_id string, split string")
    crops = spark.createDataFrame([("a", "train", "b"), ("b", "val", None), ("c", "train", "nowhere")], "sample_id string, split string, parent string")
    assert sorted(map(tuple, A.crop_problems(crops, official, ("parent",)).collect())) == [("membership", "c"), ("membership", "gone"), ("parent", "a"), ("parent", "c"), ("split", "c")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert A.quantile_summary(none, "value", ["class"]).isEmpty()
    assert A.against_originals(none, "class", "value", ("m1",)).isEmpty()
    assert A.factor_rank_correlations(none, ["value"], ["flat"]).isEmpty()
    assert A.paired_differences(none.withColumnRenamed("flat", "real"), ["value"], "sample_id", "real", "class").isEmpty()


def test_slots_of_members(spark):
    schema = "video_id long, slot int, mode string, frames array<struct<member: long, frame: int>>"
    rows = [(1, 0, "planned", [(0, 4), (1, 4)]), (1, 1, "joint", [(0, 9), (1, 9)]), (1, 2, "individual", [(0, 12), (1, 13)]), (1, 3, "failed", [(0, 17), (1, None)])]
    found = {r.member: tuple(r)[2:] for r in A.slot_audit(spark.createDataFrame(rows, schema), [4, 8, 12, 16]).collect()}
    assert found == {0: (4, 2, 1, 0, 1, pytest.approx(1 / 3)), 1: (4, 1, 2, 1, 1, pytest.approx(2 / 3))}


def test_degraded_conditions_against_clean(spark):
    matrix = spark.createDataFrame([("clean", "none", 0.9), ("a", "mild", 0.8), ("b", "mild", 0.6), ("c", "severe", 0.6)], "condition string, severity string, auroc double")
    assert {r.condition: r.delta for r in A.condition_deltas(matrix, "auroc").collect()} == pytest.approx({"a": -0.1, "b": -0.3, "c": -0.3})
    found = {r.severity: (r["mean"], r.worst, r.worst_condition) for r in A.severity_summary(matrix, "auroc").collect()}
    assert {k: v[2] for k, v in found.items()} == {"mild": "b", "severe": "c", "all": "b"}
    assert found["all"][0] == pytest.approx(2 / 3)
