"""The pipeline's stages against brute force on the smallest tables."""

import collections
import hashlib
import re

import public_tokenizers

import corpus_pipeline
from tests.llm.test_llm_operators import brute_groups, squeezed
from veraframe.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns and known.count() == sum(any(c.isalpha() for c in r.text) for r in docs.collect())

    exact = stages["exact_dedup"](spark, known, SF).cache()
    groups = collections.defaultdict(list)
    for r in known.collect():
        groups[squeezed(r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in exact.collect()} == {min(v)[1] for v in groups.values()}

    near = stages["near_dedup"](spark, exact, SF).cache()
    want = brute_groups([(r.doc_id, r.text) for r in exact.collect()], 5, 80, 100)
    assert {r.doc_id for r in near.collect()} == {c if n else i for i, (n, c) in want.items()} and near.columns == docs.columns

    mixed = stages["mixing"](spark, near, SF).cache()
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in near.collect()}

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in near.collect()}
    out = stages["byte_bpe"](spark, mixed, SF).collect()
    assert collections.Counter(r.doc_id for r in out) == times
    for r in out:
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
