"""Closed windows, scores of new rows and the score cache, against plain versions and through retries."""

import math

import pytest
from pyspark.sql import functions as F

from veraframe.sources import score_cache as SC
from veraframe.sources.shared import new_path
from veraframe.streaming import monitoring as MO

HOUR = 3600


def log_of(spark, rows):
    made = spark.createDataFrame(rows, "turn int, event_id long, at long, verdict string, total_ms double")
    return made.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_late_rows_are_dropped_and_open_windows_are_kept_back(spark):
    rows = [(0, 1, 100, "a", 1.0), (0, 2, 200, "a", 3.0), (0, 3, 3 * HOUR + 50, "b", 5.0), (0, 4, None, "b", 9.0)]
    rows += [(1, 5, 300, "a", 100.0), (1, 6, 2 * HOUR + 3500, "a", 7.0), (1, 7, 9 * HOUR, "b", 2.0)]  # watermark: 3 h less 550 s, so 5 is late and 6 is not
    got, reports = MO.appended(spark, MO.closed_windows, log_of(spark, rows), "turn")
    found = sorted((r.start.timestamp() // HOUR, r.verdict, r.n, r.sum_ms, r.max_ms) for r in got.collect())
    base = found[0][0]
    assert [(f[0] - base, *f[1:]) for f in found] == [(0, "a", 2, 4.0, 3.0), (2, "a", 1, 7.0, 7.0), (3, "b", 1, 5.0, 5.0)]
    assert [r["dropped"] for r in reports] == [0, 1] and [r["held"] for r in reports] == [1, 1]


def test_days_are_rolled_up_from_closed_hours(spark):
    rows = [(0, h, h * HOUR + 1, "ab"[h % 2], float(h)) for h in range(60)] + [(1, 100, 5, "a", 1e6), (1, 101, 100 * HOUR, "a", 0.5)]
    got, _ = MO.appended(spark, lambda log: MO.rolled_up(MO.closed_windows(log)), log_of(spark, rows), "turn")
    want = [(24, 24, float(sum(range(d * 24, d * 24 + 24))), d * 24 + 23.0) for d in (0, 1)] + [(12, 12, float(sum(range(48, 60))), 59.0)]
    assert [tuple(r)[2:] for r in got.orderBy("start").collect()] == want


def test_scores_need_no_stored_rows_and_their_state_ends(spark):
    rows = [(0, k, k * 10) for k in range(20)] * 2 + [(1, k, k * 10) for k in range(10, 30)] + [(2, 99, 10 * 86400), (3, 98, 10 * 86400), (3, 5, 10 * 86400), (3, 97, None)]
    made = spark.createDataFrame(rows, "turn int, key long, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1000)).drop("at")
    out, plans = new_path(spark, "scores"), []

    def score(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.select("key", (F.col("key") * 2.0).alias("logit"))

    reports = MO.in_turns(made, "turn", lambda s: MO.scores_within(s, score, ["key"], out, f"{out}-state"))
    got = {r.key: (r.logit, r.times) for r in MO.first_scores(spark, out, ["key"]).collect()}
    assert got == {k: (k * 2.0, 1) for k in [*range(30), 98, 99]} | {5: (10.0, 2)}  # 5 came again after its day had passed
    assert [r["held"] for r in reports] == [20, 30, 1, 3]
    assert not any(out in p for p in plans)


def frames_of(spark, n, changed=()):
    return spark.createDataFrame([(k, f"h{k}{'x' if k in changed else ''}", float(k)) for k in range(n)], "key long, sha string, x double")


def scorer(calls=None, fail=None):
    def score(df):
        if calls is not None:
            calls.append(df.count())
        value = F.when(F.col("key") == fail, F.lit(float("nan"))).otherwise(F.col("x") + 1) if fail is not None else F.col("x") + 1
        return df.select("key", "sha", value.alias("logit"))

    return score


def test_cache_resumes_and_no_retry_doubles_a_row(spark):
    path, frames, calls = new_path(spark, "cache"), frames_of(spark, 50), []
    at = (["key"], "sha", path, "t1")
    SC.write_shards(frames, *at, scorer(), 8)  # died before its commit
    with pytest.raises(SC.StaleScores, match="no commit"):
        SC.consolidated(frames, ["key"], "sha", ["key"], path, "t1", "v1", 8)
    twice = frames.unionByName(frames)
    assert SC.fill(twice, *at, "v1", scorer(calls), 8) == {"shards": 8, "resumed": 0, "computed": 8}
    assert SC.fill(frames, *at, "v1", scorer(calls), 8) == {"shards": 8, "resumed": 8, "computed": 0}
    assert calls == [50]
    got = SC.consolidated(twice, ["key"], "sha", ["key"], path, "t1", "v1", 8).collect()
    assert [(r.key, r.sha, r.logit) for r in got] == [(k, f"h{k}", k + 1.0) for k in range(50)]


def test_only_shards_without_a_commit_are_scored(spark):
    path, frames, calls = new_path(spark, "cache"), frames_of(spark, 50), []
    with pytest.raises(SC.StaleScores, match="in 1 shards"):
        SC.fill(frames, ["key"], "sha", path, "t1", "v1", scorer(fail=7), 8)
    counts = SC.fill(frames, ["key"], "sha", path, "t1", "v1", scorer(calls), 8)
    own = frames.groupBy(SC.shard_of(["key"], 8).alias("s")).agg(F.count_if(F.col("key") == 7).alias("has"), F.count(F.lit(1)).alias("n")).filter("has = 1").first().n
    assert counts == {"shards": 8, "resumed": 7, "computed": 1} and calls == [own]
    got = SC.consolidated(frames, ["key"], "sha", ["key"], path, "t1", "v1", 8).collect()
    assert [r.logit for r in got] == [k + 1.0 for k in range(50)] and not any(math.isnan(r.logit) for r in got)


def test_stale_contents_settings_and_tags_are_refused(spark):
    path, frames = new_path(spark, "cache"), frames_of(spark, 30)
    SC.fill(frames, ["key"], "sha", path, "t1", "v1", scorer(), 4)
    for other, tag, settings, shards, text in [(frames_of(spark, 30, {3}), "t1", "v1", 4, "other frames"), (frames_of(spark, 29), "t1", "v1", 4, "other frames"), (frames, "t1", "v2", 4, "settings"), (frames, "t1", "v1", 5, "settings"), (frames, "t2", "v1", 4, "no commit")]:
        with pytest.raises(SC.StaleScores, match=text):
            SC.consolidated(other, ["key"], "sha", ["key"], path, tag, settings, shards)
    with pytest.raises(SC.StaleScores, match="other frames"):
        SC.fill(frames_of(spark, 30, {3}), ["key"], "sha", path, "t1", "v1", scorer(), 4)
    assert SC.fill(frames, ["key"], "sha", path, "t2", "v1", scorer(), 4)["computed"] == 4
    assert SC.consolidated(frames, ["key"], "sha", ["key"], path, "t1", "v1", 4).count() == 30


def test_no_frames_and_null_keys(spark):
    path = new_path(spark, "cache")
    assert SC.fill(frames_of(spark, 1).limit(0), ["key"], "sha", path, "t", "v", scorer(), 4) == {"shards": 0, "resumed": 0, "computed": 0}
    assert SC.consolidated(frames_of(spark, 1).limit(0), ["key"], "sha", ["key"], path, "t", "v", 4).count() == 0
    odd = spark.createDataFrame([(None, None, 1.0), (None, "a", 2.0), (1, None, 3.0)], "key long, sha string, x double")
    SC.fill(odd, ["key"], "sha", path, "t", "v", scorer(), 4)
    assert sorted(r.logit for r in SC.consolidated(odd, ["key"], "sha", ["key"], path, "t", "v", 4).collect()) == [2.0, 3.0, 4.0]


def test_bytes_must_match_their_hash(spark):
    rows = spark.sql("SELECT X'01' AS b, sha2(X'01', 256) AS h UNION ALL SELECT X'02', sha2(X'02', 256)")
    assert SC.verified(rows, "b", "h").count() == 2
    with pytest.raises(Exception, match="does not match its hash"):
        SC.verified(rows.withColumn("h", F.lit("0")), "b", "h").collect()
