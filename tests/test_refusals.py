"""Operators that refuse: all or nothing."""

import pytest

from veraframe.operators import decisions as D
from veraframe.operators import manifests as M

SCHEMA = "sample_id string, source_id string, identity_id string, stem string, label string, method string, parent_sample_id string, paired_sample_id string, official_split string, checksum_sha256 string"
METHODS = ("a", "b")


def clips(*changes):
    """Two originals that are each other's donors, with two fakes each; ``changes`` are (sample_id, column, value)."""
    rows = []
    for t, d in (("1", "2"), ("2", "1")):
        rows.append(dict(sample_id=f"r{t}", source_id=t, stem=t, label="real", official_split="train", checksum_sha256="x"))
        rows += [dict(sample_id=f"{m}{t}", source_id=t, stem=f"{t}_{d}", label="fake", method=m, parent_sample_id=f"r{t}", paired_sample_id=f"r{d}", official_split="train", checksum_sha256="x") for m in METHODS]
    for sample, column, value in changes:
        next(r for r in rows if r["sample_id"] == sample)[column] = value
    return rows


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def test_families_are_whole_or_refused(spark):
    out = M.content_families(frame(spark, clips()), METHODS).collect()
    assert {(r.family_id, r.sample_id, r.donor) for r in out} == {("1", "r1", None), ("1", "a1", "r2"), ("1", "b1", "r2"), ("2", "r2", None), ("2", "a2", "r1"), ("2", "b2", "r1")}
    assert {r.leakage_group for r in out} == {"a1"}


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (("a1", "stem", "one"), ("not_a_fake_name", "a1")),
        (("a1", "method", "b"), ("methods_differ", "1")),
        (("a1", "stem", "1_9"), ("donor_missing", "a1")),
        (("a1", "parent_sample_id", None), ("lineage_differs", "a1")),
        (("a1", "official_split", "val"), ("splits_differ", "a1")),
        (("r2", "stem", "1"), ("duplicate_original", "1")),
        (("r1", "checksum_sha256", None), ("checksum_missing", "1")),
    ],
)
def test_family_problems(spark, change, problem):
    df = frame(spark, clips(change))
    assert problem in {(r.code, r.key) for r in M.family_members(df, METHODS)[1].collect()}
    with pytest.raises(ValueError, match=problem[0]):
        M.content_families(df, METHODS)


def test_splits_are_all_or_nothing(spark):
    pairs = spark.createDataFrame([("1", "2", "train")], "a string, b string, split string")
    df = frame(spark, clips())
    assert {(r.sample_id, r.split) for r in M.official_splits(df, pairs, pairs).collect()} == {(r["sample_id"], "train") for r in clips()}
    apart = spark.createDataFrame([("1", "3", "train"), ("2", "4", "val")], "a string, b string, split string")
    with pytest.raises(ValueError, match="originals_differ: a1"):
        M.official_splits(df, apart, apart)
    with pytest.raises(ValueError, match="pair_not_official: 1-2"):
        M.official_splits(df, pairs, spark.createDataFrame([("1", "5")], "a string, b string"))


def test_guards_fail_the_job(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "test")], "family_id long, split string")
    assert M.only_splits(rows, ["train", "test"]).count() == 2
    with pytest.raises(Exception, match="sealed split"):
        M.only_splits(rows, ["train"]).collect()
    parts = spark.createDataFrame([(1, "conformal")], "family_id long, partition string")
    with pytest.raises(Exception, match="in no partition"):
        M.partition_rows(rows, parts, "conformal").collect()
    assert M.partition_rows(rows.filter("family_id = 1"), parts, "conformal").count() == 1


def test_digest_depends_on_the_order(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "k long, v string")
    one = M.table_digest(df, ["v"], ["k"], rows=4).first().digest
    assert one == M.table_digest(df.repartition(7), ["v"], ["k"], rows=4).first().digest
    assert one != M.table_digest(df.selectExpr("49 - k AS k", "v"), ["v"], ["k"], rows=4).first().digest


def test_matched_frames_keep_to_their_slots(spark):
    rows = [(1, s, "original", "real", 10 * s, 5) for s in range(3)] + [(1, s, "m", "fake", 10 * s + (s == 2), 6) for s in range(3)]
    out = M.match_real_frames(spark.createDataFrame(rows, "family_id long, slot int, method string, label string, frame_index int, factor long")).collect()
    assert sorted((r.slot, r.real_frame_index, r.exact) for r in out) == [(0, 0, True), (1, 10, True), (2, 20, False)]


def test_evidence_follows_the_verdict(spark):
    stages = [D.Stage(4, 0.1, 1.0, 0.3, 0.3), D.Stage(8, 0.1, 1.0, 0.3, 0.3), D.Stage(16, 0.1, 1.0, 0.3, 0.3)]
    logits = {"real": lambda s: -3.0 - s / 100, "fake": lambda s: 3.0 + s / 100, "doubt": lambda s: -0.1 if s % 2 else -0.2}
    frames = spark.createDataFrame([(v, s, f(s)) for v, f in logits.items() for s in range(16)], "sample_id string, slot int, logit double")
    out = {r.sample_id: (r.sign, [e.slot for e in r.evidence]) for r in D.evidence(frames, D.adaptive(D.stage_scores(frames, [4, 8, 16]), stages)).collect()}
    assert out == {"real": (-1, [0, 4, 8, 12]), "fake": (1, [0, 4, 8, 12]), "doubt": (-1, [0, 2, 4, 6])}
