"""Edge cases of the training-data operators: hot and null keys, clashing names, long texts, empty tables, damaged markup."""

import collections
import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veraframe.llm import bpe, common, exact_dedup, html_extract, jaccard_join, language_id, media_columns, mixing, sharding, token_counts, warc
from veraframe.sources.shared import new_path

SF = "/root/testdata/sf0.001"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "tie long, n_of_mix long, __repeats long, score double, lang_pred string, shares int, found int, letters int, cell int, digest string, n_chars_now int, row long"


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents, null and empty texts, null ids and sources, repeated rows, in columns that operators use themselves."""
    rows = [(i, f"some words of text {i} that are read by many people in the town", "en", f"s{i % 2}", 1) for i in range(12)]
    rows += [(i, f"einige worte {i} die viele leute in der stadt gern lesen und hören", "de", None, 1) for i in range(12, 20)]
    rows += [(20, None, "en", "s0", 0), (21, "", None, "s0", 0), (None, "a text without an id, of some words", "en", "s1", 1), (None, None, None, None, None), rows[0], rows[0], rows[15]]
    docs = spark.createDataFrame(rows, DOCS)
    extra = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CLASH.split(", "))]
    return docs.select("*", *extra).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(clashing):
    return clashing.limit(0)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_and_no_rows(spark, clashing, nothing, name, stage):
    out = stage(spark, clashing, SF)
    assert stage(spark, nothing, SF).collect() == []
    rows = out.collect()
    if name == "byte_bpe":
        assert len(rows) == clashing.count()
        return
    assert out.columns == clashing.columns
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "language_id":
        assert set(ids) == {*range(20), None} and ids[0] == 3 and ids[None] == 1
    if name == "exact_dedup":
        assert set(ids) == {*range(21), None} and max(ids.values()) == 1
    if name == "near_dedup":  # of documents without words all stay
        assert set(ids) == {*range(22), None} and ids[0] == 1 and ids[None] == 2
    if name == "mixing":
        assert not {20, 21} & set(ids)


def test_outputs_replace_columns_of_their_names(spark, clashing):
    names, table = language_id.train(clashing)
    out = language_id.identify(clashing, names, table)
    assert sorted(out.columns) == sorted(clashing.columns)
    assert {r.lang_pred for r in out.collect()} == {"de", "en", "und"}


def test_rows_kept_in_place_and_joined(spark, monkeypatch):
    rows = spark.range(500).select((F.col("id") % 100).alias("k"), F.lit(1).alias("cell"), F.lit("x").alias("text")).unionByName(spark.createDataFrame([(None, 1, "x")], "k long, cell int, text string"))
    keep = spark.createDataFrame([(k,) for k in [*range(0, 100, 3), None]], "id long")
    drop = spark.createDataFrame([(k,) for k in range(100) if k % 3], "id long")
    for cells in (1, 7, common.CELLS):  # all rows are joined, some, or few
        monkeypatch.setattr(common, "CELLS", cells)
        got = common.keep_rows(rows, keep, drop, {"k": "id"})
        assert got.columns == rows.columns and collections.Counter(r.k for r in got.collect()) == {None: 1, **{k: 5 for k in range(0, 100, 3)}}


def test_ring_with_null_and_equal_rows(spark):
    free = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text"), "id").alias("text"))
    equal = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    docs = free.unionByName(equal)
    rows = sharding.ring_shards(docs, 4).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == 1000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert sorted(map(str, sharding.ring_shards(docs.repartition(7), 4).collect())) == sorted(map(str, rows))


def test_many_partitions_merge_in_rounds(spark):
    docs = spark.range(0, 3000, 1, 11).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1000).cast("string")).alias("text"))
    for most in (1, 4, 8192):
        got = exact_dedup.exact_groups(docs, most_runs=most).collect()
        want = collections.Counter("hot" if i % 3 == 0 else str(i % 1000) for i in range(3000))
        assert len(got) == 3000 and sum(r.kept for r in got) == len(want)
        assert collections.Counter(r.group_size for r in got) == collections.Counter(n for n in want.values() for _ in range(n))


def test_two_texts_with_one_digest_fail(spark):
    runs = spark.createDataFrame([(0, 0, 1, 1, b"12345678", 5), (1, 1, 2, 1, b"12345678", 6)], "run int, row long, id long, n_chars long, digest binary, check long")
    with pytest.raises(Exception, match="one digest stands for two texts"):
        exact_dedup.merge_runs(runs)


def test_sets_are_compared_by_their_words(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f"), (3, "a b c d x"), (4, "a b"), (5, "a b")], "c long, words string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (1, 4)], "a long, b long")
    got = {(r.a, r.b) for r in jaccard_join.verify(pairs, texts, 4, 2, 3).collect()}
    assert got == {(1, 2), (4, 5)}


def test_suffix_counts_bound_the_distance(spark):
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = (rng.integers(0, 32, rng.integers(5, 700)) for _ in range(2))
        x, y = (jaccard_join.suffix_counts(v, np.array([2])) for v in (a, b))
        row = spark.createDataFrame([tuple(map(int, [*x[0], *y[0]]))], [f"x{i}" for i in range(4)] + [f"y{i}" for i in range(4)])
        got = row.select(jaccard_join.suffix_distance([f"x{i}" for i in range(4)], [f"y{i}" for i in range(4)]).alias("d")).first().d
        counts = [np.minimum(np.bincount(v[3:], minlength=32), 255) for v in (a, b)]
        assert got == np.abs(counts[0] - counts[1]).sum()


def test_text_longer_than_a_chunk(spark):
    texts = ["wort étre \n 12 " * 9000, "x" * 80_000, "ab " * 30_000 + "é" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = bpe.encoding(RANKS, PATTERN)
    for r in bpe.round_trip(docs, RANKS, PATTERN).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_empty_tables(spark, nothing):
    cache = new_path(spark, "cache")
    assert token_counts.token_counts(nothing, public_tokenizers.path("byte_bpe_50k.json"), cache).collect() == []
    assert exact_dedup.exact_groups(nothing).collect() == [] and exact_dedup.drop_exact_copies(nothing).collect() == []


def test_captions():
    ref = lambda c: f'<img src="sha256:{c * 64}">'
    items = lambda page: [(i["kind"], i["text"] or i["ref"][0], i["caption"]) for i in media_columns.parse_sequence(page)]
    assert items(f"<figure>{ref('a')}<figcaption>Cap</figure>after<p>more") == [("media", "a", "Cap"), ("text", "after", None), ("text", "more", None)]
    assert items(f"<figure>{ref('a')}</figure><figcaption>stray</figcaption>{ref('b')}") == [("media", "a", None), ("text", "stray", None), ("media", "b", None)]
    assert items(f"<figure>{ref('a')}<figcaption>One<figure>{ref('b')}<figcaption>Two") == [("media", "a", "One"), ("media", "b", "Two")]
    assert items("<figure><figcaption>No picture</figcaption></figure>") == [("text", "No picture", None)]


def test_pages_with_nulls_and_clashes(spark):
    rows = [(1, "u", None, 1, "d"), (1, "u", None, 1, "d"), (None, None, "<p>One</p>", 2, "e"), (None, "v", "<p>One</p>", 2, "e"), (3, "w", "<article><p>Two &amp; three</p></article>", 0, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, source int, sha1 string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "copy", "again", "of", "id", "content")})
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract_pages(pages, None).collect())
    assert got == [(0, "One", 3), (0, "One", 3), (1, "", 0), (1, "", 0), (3, "Two & three", 11)]
    read = warc.archive_round_trip(pages).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in read)
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (None, "response", None): 1, (None, "revisit", None): 1, (3, "response", None): 1}


def test_null_ids_are_mixed_in_the_order_of_their_texts(spark):
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), "id").alias("text"), F.lit("s").alias("source"))
    assert mixing.sized(docs, "doc_id", "text", "source").select("order").distinct().count() == 300
