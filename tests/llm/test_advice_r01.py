"""Cases in which training-data operators once did less than the whole job."""

import collections
import hashlib

import pytest

from veraframe.llm import mixing


@pytest.fixture(scope="module")
def gapped(spark):
    """A source in which a text of half its words stands early in the order, and a fractional part of 4,000 of 10,000 words."""
    order = lambda i: hashlib.sha256(f"{mixing.SEED}:{i}".encode()).hexdigest()[:16]
    ids = sorted(range(501), key=order)
    rows = [(i, "w " * (5000 if at == 50 else 10), "a") for at, i in enumerate(ids)] + [(i, "w " * 100, "b") for i in range(1000, 1100)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()


def test_gap_is_filled(gapped):
    rows = mixing.mix(gapped, weights=(1, 4)).collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert len(rows) == gapped.count() and taken == {"a": 4000, "b": 16000}


def test_no_open_document_fits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r.source].append(r)
    for rows in by.values():
        gap = rows[0].target - sum(r.taken for r in rows)
        least = min(r.repeats for r in rows)
        assert gap >= -1e-6 and not any(0 < r["size"] <= gap for r in rows if r.repeats == least)
