"""Reports on small tables, against plain Python: broken input, nulls, empty tables, refusals."""

import json
import math

import pytest

from veraframe.functions import provenance as P
from veraframe.functions.augmentation import augmentation_plan
from veraframe.functions.sampling import family_plans, nested_plans
from veraframe.operators import audits as A
from veraframe.operators import decisions as D
from veraframe.operators import sweeps as W
from veraframe.operators.metrics import agreement_summary

FILES = "class string, name string, bytes long, readable boolean, duration_s double, width int, height int, codec string"


def test_acquisition(spark):
    expected = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "9")], "class string, stem string")
    rows = [("a", "1.mp4", 10, True, 4.0, 64, 48, "x"), ("a", "2.mp4", 0, True, 1.0, 64, 48, "x"), ("a", "7.mp4", 5, False, 2.0, 64, 48, "x"), ("a", "tmp1", 3, None, None, None, None, None), ("a", "read.me", 3, None, None, None, None, None)]
    found = spark.createDataFrame(rows, FILES)
    got = {r["class"]: tuple(r)[1:] for r in A.acquisition_by_class(expected, found).collect()}
    assert got == {"a": (3, 3, 15, 1, 2, 1, 1, 1, 4.0, 4.0), "b": (1, 0, 0, 1, 0, 0, 0, 0, None, None)}
    assert sorted(map(tuple, A.probe_histograms(found).collect())) == [("a", "codec", "x", 1), ("a", "resolution", "64x48", 1)]
    none = spark.createDataFrame([], FILES)
    assert A.acquisition_by_class(expected.limit(0), none).isEmpty() and A.probe_histograms(none).isEmpty()


def test_provenance(spark):
    act = {"action": "c2pa.created", "when": "2024", "softwareAgent": {"name": "Tool"}, "digitalSourceType": P.SOURCE_TYPE_PREFIX + "algorithmicMedia"}
    active = {"title": "https://x", "assertions": [{"label": "c2pa.actions", "data": {"actions": [act] * 15}}, {"label": "c2pa.actions.v2", "data": {"actions": [act] * 15}}, {"label": "other", "data": {"actions": [act]}}]}
    store = {"active_manifest": "m", "manifests": {"m": active}, "validation_results": {"activeManifest": {"success": [{"code": "a.b"}, {"code": "a.b"}, {"code": "x y"}], "informational": [{"code": "timeStamp.odd"}]}}}
    rows = spark.createDataFrame([(1, json.dumps(store)), (2, None), (3, "{}"), (4, "no json"), (5, '{"active_manifest": "gone", "manifests": {"m": {}}}')], "k int, store string")
    got = {r.k: r for r in P.provenance_summary(rows, "store", ["k"]).collect()}
    assert (got[1].title, len(got[1].actions), got[1].declares_ai_generated, got[1].timestamp, got[1].success_codes) == (None, 20, True, "untrusted", ["a.b"])
    assert (got[1].actions[0].software_agent, got[1].actions[0].digital_source_type.label) == ("Tool", "Generated algorithmically")
    for k in (2, 3, 4, 5):
        assert (got[k].title, got[k].actions, got[k].ingredients, got[k].timestamp, got[k].declares_ai_generated, got[k].manifest_count) == (None, [], [], "absent", False, int(k == 5))


def test_plans_follow_probability_and_cap(spark):
    rows = spark.range(4000).selectExpr("id", "cast(id % 6 as int) - 1 as epoch")
    got = augmentation_plan(rows, "id", "epoch", 3).collect()
    ops = ("gamma", "resize", "blur", "noise", "jpeg", "h264_qp")
    assert all(all(r[c] is None for c in ops) for r in got if r.epoch < 0)
    assert {r.epoch: r.severity_cap for r in got} == {-1: 0.0, 0: 0.5, 1: 0.625, 2: 0.75, 3: 0.875, 4: 1.0}
    live = [r for r in got if r.epoch >= 0]
    for c, p in zip(ops, (0.3, 0.3, 0.2, 0.2, 0.35, 0.3), strict=True):
        assert abs(sum(r[c] is not None for r in live) / len(live) - p) < 0.04
    assert not [r for r in live if r.jpeg is not None and r.h264_qp is not None]
    assert all(0.05 <= abs(math.log(r.gamma)) <= 0.05 + 0.17 * r.severity_cap + 1e-9 for r in live if r.gamma is not None)
    assert augmentation_plan(rows.limit(0), "id", "epoch", 3).isEmpty()


def test_sweep_refuses_without_a_candidate(spark):
    sweep = spark.createDataFrame([(1.0, 0.5, 0.5, 0.5, False)], "percentile double, sharpness_min double, hf_ratio_min double, blockiness_max double, chosen boolean")
    with pytest.raises(ValueError, match="budget"):
        W.chosen_gate(sweep)
    assert W.chosen_gate(sweep.selectExpr("percentile", "sharpness_min", "hf_ratio_min", "blockiness_max", "true as chosen")) == D.Gate(0.5, 0.5, 0.5)


def test_calibration_fits_against_plain_python(spark):
    rows = [(i, int(i % 3 == 0), (1.5 if i % 3 == 0 else -1.5) + math.sin(i * 7.0) * 2.5, ("dev", "temperature", "conformal")[(i * 7 // 3) % 3]) for i in range(300)]
    scores = spark.createDataFrame(rows, "k long, y int, z double, part string")
    got = {(r.mode, r.alpha): r for r in W.calibration_fits(scores, ["z"], "y", "k", "part", [0.001, 0.1]).collect()}
    t = got["mondrian", 0.1].temperature
    p = lambda z: 1 / (1 + math.exp(-z / t))
    conf = [(y, 1 - p(z) if y else p(z)) for _, y, z, part in rows if part == "conformal"]

    def cut(values, alpha):
        rank = math.ceil((len(values) + 1) * (1 - alpha))
        return sorted(values)[rank - 1] if rank <= len(values) else 1.0

    dev = [(k, y, p(z)) for k, y, z, part in rows if part == "dev"]
    for (mode, alpha), r in got.items():
        sides = [[s for y, s in conf if mode == "marginal" or y == side] for side in (0, 1)]
        q = [cut(v, alpha) for v in sides]
        assert (r.q_real, r.q_fake) == pytest.approx(q)
        assert r.supported == (alpha >= 1 / (min(map(len, sides)) + 1))
        sets = [(y, x <= q[0], 1 - x <= q[1], x) for _, y, x in dev]
        decided = [(y, f) for y, a, f, _ in sets if a != f]
        assert r.abstention == pytest.approx(1 - len(decided) / len(dev))
        assert r.coverage == pytest.approx(sum(f if y else a for y, a, f, _ in sets) / len(dev))
        keep = max(1, round((1 - r.abstention) * len(dev)))
        first = sorted(dev, key=lambda d: (-max(d[2], 1 - d[2]), d[0]))[:keep]
        assert r.baseline_accuracy == pytest.approx(sum((x >= 0.5) == (y == 1) for _, y, x in first) / keep)
    with pytest.raises(Exception, match="too few calibration rows"):
        W.supported_fits(W.calibration_fits(scores, ["z"], "y", "k", "part", [0.001])).collect()
    losses = {(r.part, r.scaling): r for r in W.calibration_losses(scores, ["z"], "y", "k", "part").collect()}
    assert losses["temperature", "scaled"].nll <= losses["temperature", "raw"].nll
    assert losses["dev", "raw"].n == len(dev)


def test_frame_plans(spark):
    counts = [None, -3, 0, 1, 2, 15, 16, 17, 100, 3_000_000_000]
    rows = spark.createDataFrame(list(enumerate(counts)), "id int, n long")
    for r in nested_plans(rows, "n").collect():
        n = max(r.n or 0, 0)
        m = min(16, n)
        want = [0] * (m == 1) if m < 2 else sorted({round(i * (n - 1) / (m - 1)) for i in range(m)})
        assert (r.plan_16, r.plan_8, r.plan_4) == (want, want[::2], want[::4])
    families = spark.createDataFrame([(1, 40), (1, 16), (2, 40), (2, 15), (3, None), (3, 90), (None, 20)], "f int, n int")
    got = {r.f: (r.members, r.shared, r.plan and len(r.plan)) for r in family_plans(families, "f", "n").collect()}
    assert got == {1: (2, 16, 16), 2: (2, 15, None), 3: (2, 0, None), None: (1, 20, 16)}


def test_decisions_that_agree(spark):
    schema = "sample_id string, y int, verdict string, frames_used int"
    a = spark.createDataFrame([("p", 0, D.FAKE, 4), ("q", 0, D.REAL, 8), ("r", 1, D.FAKE, 4), ("only", 0, D.FAKE, 4)], schema)
    b = spark.createDataFrame([("p", 0, D.FAKE, 4), ("q", 0, D.FAKE, 16), ("r", 1, D.UNCERTAIN, 4)], schema)
    assert tuple(D.decision_agreement(a, b).first()) == (3, 1, pytest.approx(1 / 3), pytest.approx(2 / 3), 1, 2, 1)
    assert tuple(D.decision_agreement(a.limit(0), b.limit(0)).first()) == (0, 0, None, None, 0, 0, 0)


def test_agreement_summary(spark):
    rows = spark.createDataFrame([(0.5,), (0.1,), (-0.2,), (None,)], "rho double")
    assert tuple(agreement_summary(rows, "rho", 0.1).first()) == (3, pytest.approx(2 / 3), pytest.approx(-0.14), pytest.approx(0.1))
    assert tuple(agreement_summary(rows.limit(0), "rho", 0.1).first()) == (0, None, None, None)
