"""Data-set sources, landmark geometry, signals and degradations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veraframe.functions import scalars as S
from veraframe.functions import signals as SG
from veraframe.sources import datasets as ds

ROWS = [{"path": "a/x.mp4", "label": "FAKE", "original": "a/y.mp4", "n": 3}, {"path": "a/y.mp4", "label": "REAL", "original": None}, {"path": "a/z.tar.mp4", "label": "unsure"}]


def sidecar(spark, folder, form, text):
    (folder / f"side.{form}").write_text(text)
    spec = ds.generic_spec("d", "1", metadata=f"side.{form}", form=form, parent="original")
    return {r.media_path: (r.label, r.source_id, r.parent_sample_id) for r in ds.read_dataset(spark, str(folder), spec).collect()}


def test_sidecars_of_all_forms(spark, tmp_path):
    want = {"a/x.mp4": ("fake", "x", "d:a/y.mp4"), "a/y.mp4": ("real", "y", None)}
    assert sidecar(spark, tmp_path, "jsonl", "\n\n".join(map(json.dumps, ROWS))) == want
    assert sidecar(spark, tmp_path, "json", json.dumps(ROWS)) == want
    assert sidecar(spark, tmp_path, "csv", 'path,label,original\na/x.mp4,FAKE,a/y.mp4\na/y.mp4,REAL,\n"a/z, z.mp4",unsure,\n') == want
    for f in tmp_path.glob("*.json"):
        f.unlink()
    assert sidecar(spark, tmp_path, "json", json.dumps({r["path"]: {k: v for k, v in r.items() if k != "path"} for r in ROWS}, indent=1)) == want


def test_folders(spark, tmp_path):
    for path in ("Celeb-real/id1_a.mp4", "Celeb-synthesis/id1_a.mp4", "Celeb-synthesis/deep/no.mp4", "elsewhere/no.mp4"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(path.encode())
    (tmp_path / "List_of_testing_videos.txt").write_text("1 Celeb-real\\id1_a.mp4\n\n")
    out = {r.media_path: r for r in ds.read_dataset(spark, str(tmp_path), ds.dataset_spec("celeb-df-v2", "v2"), checksums=True).collect()}
    assert set(out) == {"Celeb-real/id1_a.mp4", "Celeb-synthesis/id1_a.mp4"}
    real, fake = (out[f"{x}/id1_a.mp4"] for x in ("Celeb-real", "Celeb-synthesis"))
    assert (real.official_split, real.label, len(real.checksum_sha256)) == ("test", "real", 64)
    assert (fake.official_split, fake.parent_sample_id, fake.generator_method) == (None, real.sample_id, "Celeb-DF-synthesis")
    with pytest.raises(ValueError, match="none of the directories"):
        ds.read_dataset(spark, str(tmp_path), ds.dataset_spec("deeperforensics-1.0"))


def test_registry():
    assert isinstance(ds.dataset_spec("dfdc"), ds.SidecarSpec) and len(ds.dataset_spec("faceforensics++").buckets) == 18
    with pytest.raises(KeyError, match="celeb-df-v2"):
        ds.dataset_spec("none")
    with pytest.raises(ValueError, match="v1"):
        ds.dataset_spec("dfdc", "v2")


def test_signals_tell_what_they_should():
    rng = np.random.default_rng(2)
    plain = np.clip(128 + 40 * np.sin(np.arange(224) / 9)[:, None] + 20 * np.cos(np.arange(224) / 5)[None] + rng.normal(0, 4, (224, 224)), 0, 255).astype(np.uint8)
    blurred = SG.degraded(plain, (("blur", 2.0),), "k")
    noisy = SG.degraded(plain, (("noise", 10.0),), "k")
    blocky = np.kron(plain[::8, ::8], np.ones((8, 8))).astype(np.uint8)
    one, two = SG.signals_v1, SG.signals_v2
    assert one(blurred)[0] < one(plain)[0] and one(blurred)[1] < one(plain)[1] and one(blocky)[2] > 10 > one(plain)[2]
    assert abs(two(plain)[3] - 4) < 1 and abs(two(noisy)[3] - np.hypot(4, 10)) < 1.5 and two(blocky)[2] > 2 * two(plain)[2]
    assert SG.signals_hybrid(plain).tolist() == [*one(plain), two(plain)[3]]


def test_stress_matrix(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 256, 64).tolist()) for i in range(4)] + [(9, [100] * 64)]
    df = spark.createDataFrame(rows, "k long, pixels array<short>")
    out = SG.stress_matrix(df, "pixels", 8, ["k"])
    got = {(r.k, r.condition): r.pixels for r in out.collect()}
    assert len(got) == 5 * len(SG.CONDITIONS) and got == {(r.k, r.condition): r.pixels for r in SG.stress_matrix(df.repartition(3), "pixels", 8, ["k"]).collect()}
    assert set(got[9, "blur_s2.0"]) <= {99, 100} and set(got[9, "gamma_1.4"]) == {int(255 * (100 / 255) ** 1.4)} and len(set(got[9, "noise_s10"])) > 5
    assert max(np.std(got[0, "resize_0.33"]), np.std(got[0, "resize_0.75"])) < np.std(rows[0][1])
    built = out.filter("NOT (k = 9 AND condition = 'blur_s1.0') AND condition <> 'noise_s4'")
    assert {r.condition: r.missing for r in SG.incomplete_conditions(df, built, ["k"], [c[0] for c in SG.CONDITIONS]).collect()} == {"blur_s1.0": 1, "noise_s4": 5}


def test_boxes_and_text(spark):
    df = spark.createDataFrame([("a\u200bb\n c", 10.0), ("https://x", -1.0), (" \u202e ", None), ("x" * 130, 45.0), (None, 9.9)], "t string, s double")
    shown = [r.v for r in df.select(S.display_safe(F.col("t")).alias("v")).collect()]
    assert shown == ["ab c", None, None, "x" * 120 + "…", None]
    assert [r.v for r in df.select(S.duration_bucket(F.col("s")).alias("v")).collect()] == ["10-20s", None, None, ">=45s", "<10s"]
    box = S.clipped(*S.expanded(*map(F.lit, (10.0, 10.0, 20.0, 40.0)), 0.5), F.lit(35.0), F.lit(100.0))
    assert [round(v, 6) for v in spark.range(1).select(*box).first()] == [0.0, 0.0, 35.0, 70.0]
