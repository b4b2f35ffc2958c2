"""Operators that SQL does not express, and edge cases, against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veraframe.operators import decisions as D
from veraframe.operators import manifests as M
from veraframe.operators import metrics as S
from veraframe.operators.graph import components
from veraframe.operators.near_duplicates import hamming_groups, hamming_pairs
from veraframe.operators.ordering import running


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a, b in ((rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)) if a != b] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_running_sums(spark):
    rows = [(i, (i * 37) % 101) for i in range(100)]
    out = running(spark.createDataFrame(rows, "k long, v long").repartition(5), [F.col("k")], {"s": F.col("v")}).collect()
    assert {r.k: r.s for r in out} == {k: sum(v for x, v in rows if x <= k) for k, _ in rows}


def test_temperature_fit(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-z / 1.7))).astype(int)
    t = S.fit_temperature(spark.createDataFrame(list(zip(map(int, y), map(float, z), strict=True)), "y int, z double"), "y", "z")
    loss = lambda t: float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z) / t))))
    assert loss(t) <= min(loss(math.exp(x)) for x in np.linspace(-2, 2, 2001)) + 1e-9


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.9)], "y int, s double")
    assert S.auroc(df, "y", "s").first().auroc is None
    assert S.conformal_quantile(df, "s", 0.01).first().q == 1.0


def test_gate_only_downgrades(spark):
    rng = random.Random(5)
    frames = spark.createDataFrame([(f"v{v}", s, rng.gauss(0, 2), rng.random() * 2, rng.random() * 2, rng.random() * 5) for v in range(30) for s in range(16)], "sample_id string, slot int, logit double, q1 double, q2 double, q3 double")
    stages = [D.Stage(4, 0.015, 0.8, 0.6, 0.5), D.Stage(8, 0.015, 0.7, 0.6, 0.5), D.Stage(16, 0.02, 0.6, 0.55, 0.45)]
    out = D.gated(frames, D.adaptive(D.stage_scores(frames, [4, 8, 16]), stages), stages, D.Gate(0.2, 0.2, 4.5), ["q1", "q2", "q3"])
    assert out.filter("verdict <> base_verdict AND verdict <> 'uncertain'").isEmpty()


def test_strict_manifest(spark):
    good = '{"sample_id":"a","dataset_name":"d","dataset_version":"1","media_type":"image","media_path":"p","label":"real","source_id":"s","extra":1}'
    assert M.read_manifest(spark.createDataFrame([(good,), (" ",)], "value string")).count() == 1
    with pytest.raises(ValueError):
        M.read_manifest(spark.createDataFrame([(good,), ("{",)], "value string"))


def test_leakage_groups(spark):
    rows = [("a", "s1", None, None, None), ("b", "s1", None, None, None), ("c", "s2", "p", None, None), ("d", "s3", "p", None, None), ("e", "s4", None, "d", None), ("f", "s5", "", None, "zz"), ("g", "s6", "", None, None)]
    df = spark.createDataFrame(rows, "sample_id string, source_id string, identity_id string, parent_sample_id string, paired_sample_id string")
    assert {r.sample_id: r.group_key for r in M.leakage_groups(df).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f", "g": "g"}


def test_weighted_draws(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, w double")
    got = M.weighted_draws(df, "k", F.col("w"), 2000, 1, 1).groupBy("k").count().collect()
    counts = {r.k: r["count"] for r in got}
    assert sum(counts.values()) == 2000 and abs(counts["b"] / 2000 - 0.75) < 0.05


def test_hamming_and_leaders(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = []
    for i, h in enumerate(base * 4):
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(64)
        hashes.append((i, h - (1 << 64) if h >> 63 else h))
    got = {(r.a, r.b): r.distance for r in hamming_pairs(spark.createDataFrame(hashes, "k long, h long"), "k", "h").collect()}
    distance = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    reps = {}
    for k, h in hashes:
        reps.setdefault(h, k)
    want = {(a, b): distance(x, y) for a, x in hashes for b, y in hashes if a < b and distance(x, y) <= 5 and ((reps[x] == a and reps[y] == b) or (x == y and reps[x] == a))}
    assert got == want
    groups = {r.key: r.leader for r in hamming_groups(spark.createDataFrame(hashes, "k long, h long"), "k", "h").collect()}
    leader = {}
    for k, h in hashes:
        leader.setdefault(k, next((j for j, g in hashes if j < k and leader[j] == j and distance(g, h) <= 5), k))
    sizes = collections.Counter(leader.values())
    assert groups == {k: v for k, v in leader.items() if sizes[v] > 1}


def test_copies_follow_their_first_key(spark):
    got = {r.key: r.leader for r in hamming_groups(spark.createDataFrame([(0, 0), (1, 1), (5, 1), (9, -1)], "k long, h long"), "k", "h").collect()}
    assert got == {0: 0, 1: 0, 5: 0}
