"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows
from veraframe.llm import bpe, exact_dedup, html_extract, jaccard_join, language_id, media_columns, mixing, queries, sharding, token_counts, warc
from veraframe.sources.shared import new_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, run string"
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated texts, a null id, and columns whose names operators use themselves."""
    long = " ".join(f"wort{i % 977} étre" for i in range(3000))
    texts = [None, "", " \n\t", "a", "a ", "A", "x y z", "x  y z", "x\ty z w", long, long + " end", "<b>&amp; ü", "<|endoftext|> token", " nbsp", "123 !!!"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 0, "d", 1, "r") for i, t in enumerate(texts)]
    rows += [rows[9], rows[3], (None, "a b", "de", "t", 0, "d", 1, "r"), (None, "a b", "de", "t", 0, "d", 1, "r")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLES[name], SF)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_groups(odd):
    rows = odd.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[squeezed(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    got = exact_dedup.exact_groups(odd, most_runs=2).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    keep = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in got)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and sorted(squeezed(r.text) for r in kept.collect()) == sorted(groups)


def test_token_counts_and_cache(spark, odd):
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "cache")
    tok = Tokenizer.from_file(path)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False))) for r in odd.collect())
    for _ in range(2):
        got = token_counts.token_counts(odd, path, cache).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        stored = spark.read.parquet(cache)
        assert stored.select("digest").distinct().count() == len({r.text or "" for r in odd.collect()})
    before = spark.read.parquet(cache).count()
    token_counts.token_counts(odd, path, cache).collect()
    assert spark.read.parquet(cache).count() == before  # all found


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(jaccard_join._UPPER, jaccard_join._LOWER)))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_groups(rows, k, num, den):
    shingles = {i: sets(t, k) for i, t in rows}
    parent = {i: i for i in shingles}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = shingles[a], shingles[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(shingles[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_near_groups(spark, k, num):
    rng = random.Random(k)
    base, rows = [f"w{rng.randint(0, 60)}" for _ in range(70)], []
    for i in range(150):
        words = base[: rng.choice([2, 3, 5, 20, 70])]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"W{rng.randint(0, 60)}"
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a"), (1004, "A"), (1005, "ä"), (1006, "Ä")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(df, k=k, num=num, den=100).collect()}
    want = brute_groups(rows, k, num, 100)
    assert got == want
    kept = {r.doc_id for r in jaccard_join.drop_near_copies(df, k=k, num=num, den=100).collect()}
    assert kept == {c if n else i for i, (n, c) in want.items()}


def test_near_groups_of_odd_rows(odd, none):
    assert jaccard_join.near_groups(odd).count() == odd.count()
    assert jaccard_join.near_groups(none).collect() == []
    assert jaccard_join.drop_near_copies(odd).columns == odd.columns


def test_language_id(spark, odd, none):
    got = language_id.op3_language_id(spark, SF)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.95
    names, table = language_id.train(odd)
    out = language_id.identify(odd, names, table).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert language_id.identify(odd, *language_id.train(none)).filter("lang_pred <> 'und'").isEmpty()


def test_mixture_shares():
    rng = np.random.default_rng(0)
    a, b = (["".join(rng.choice(list(x), 6)) for _ in range(300)] for x in ("abcde", "vwxyz"))
    table = np.full((language_id.BUCKETS, 2), 0.01)
    for j, words in enumerate((a, b)):
        _, codes = language_id.trigrams(language_id.joined([" ".join(words).encode()])[0])
        np.add.at(table[:, j], codes, 1)
    table = np.log(table / table.sum(0)).astype(np.float32)
    pi, n = language_id.mixtures([" ".join(a[:150] + b[:50]).encode(), " ".join(a).encode(), b""], table)
    assert abs(pi[0, 0] - 0.75) < 0.02 and n[0] == 2 and pi[1, 0] > 0.99 and n[1] == 1 and pi[2].sum() == 0


def test_media(odd, none):
    def want(t):
        b = (t or "").encode()
        p = b + b"\0" * (max(1, -(-len(b) // 64)) * 64 - len(b))
        m = f"P5\n64 {len(p) // 64}\n255\n".encode() + p
        return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()

    got = media_columns.text_media(odd).collect()
    values = [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got]
    assert sorted(values) == sorted(want(r.text) for r in odd.collect())
    assert media_columns.text_media(none).collect() == []


def test_interleaved_sequences(spark):
    page = f'<p>one &amp; two</p><figure><img src="sha256:{"a" * 64}"><figcaption>A <b>cap</b></figcaption></figure><p>three<img alt="x" src="sha256:{"b" * 64}">four'
    docs = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    seq = media_columns.sequences(docs, "id", "html")
    items = {r.id: [(i.kind, i.text, i.caption) for i in r["items"]] for r in seq.collect()}
    assert items == {1: [("text", "one & two", None), ("media", None, "A cap"), ("text", "three", None), ("media", None, "x"), ("text", "four", None)], 2: []}
    store = spark.createDataFrame([("a" * 64, 7)], "ref string, size int")
    out = {r.id: [(m.position, m.found, m.size, m.caption) for m in r.media] for r in media_columns.resolve(seq, store, "id").collect()}
    assert out == {1: [(1, True, 7, "A cap"), (3, False, None, "x")], 2: []}


def test_ring(spark, odd, none):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    rows = sharding.ring_shards(df, 10).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(sizes) == 10
    assert max(sizes.values()) / min(sizes.values()) < 1.02
    assert sorted(sharding.ring_shards(df.repartition(7), 10).collect()) == sorted(rows)
    assert sharding.ring_shards(odd, 4).count() == odd.count() and sharding.ring_shards(none, 4).collect() == []


def test_round_trip(odd, none):
    enc = bpe.encoding(RANKS, PATTERN)
    texts = sorted(((r.text or "") for r in odd.collect()))
    for chunk, overlap in ((65_536, 4_096), (300, 40)):
        got = bpe.round_trip(odd, RANKS, PATTERN, chunk=chunk, overlap=overlap).collect()
        pack = lambda t: struct.pack(f"<{len(i := enc.encode_ordinary(t))}I", *i)
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((len(pack(t)) // 4, hashlib.sha256(pack(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert bpe.round_trip(none, RANKS, PATTERN).collect() == []


def test_chunks_that_never_meet(spark):
    text = "word " * 50 + "q" * 3000 + " tail" * 50
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    encoded = bpe.encode(df, RANKS, PATTERN, chunk=200, overlap=20)
    ids = bpe.encoding(RANKS, PATTERN).encode_ordinary(text)
    assert bytes(encoded.first().ids) == struct.pack(f"<{len(ids)}I", *ids)
    assert bytes(bpe.decode(encoded, RANKS, PATTERN).first().decoded).decode() == text


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.train(pages)
    for r in html_extract.extract_pages(pages, model, columns=("page_id", "html")).limit(20).collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html_extract.html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)
    plain = pages.first().html.replace("<article>", "<div>").replace("</article>", '<div class="comments"><p>Well said, I think so too.</p></div></div>').replace("<nav>", '<div class="menu">').replace("</nav>", "</div>")
    assert "Well said" not in html_extract.extract([plain], model)[0] and html_extract.extract([plain], model)[0]
    assert html_extract.extract(["", "<p>a", "x<y & z"], model) == ["", "a", "x<y & z"]
    assert html_extract.extract_pages(pages.limit(0), None).collect() == [] and html_extract.train(pages.limit(0)) is None


def test_no_contradiction():
    kept = html_extract.decode(np.array([0.0, -5, 9, -5, 1]), np.array([-1, 0, 1, 0, 3]))
    assert kept.tolist() == [True, True, True, False, False]


def test_mix(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6 and all(r.target <= 3 * r.source_size + 1e-9 for r in rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.repeats for r in rows if r.taken)
    assert mixing.mix(none).collect() == []


def test_warc(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, "u", None), (4, None, ""), (5, "u", "xWARC/1.1\r\nContent-Length: 5\r\n\r\nhello" + "é" * 50 + "WARC/1.1\r\n"), (6, "u", "WARC/1.1\r\n" * 200), (7, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (8, "u", "WARC/1.1\r")]
    rows += [(i, "u\r\n", "p" * i) for i in range(20, 40)]
    by = collections.defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    want = set()
    for i, _, h in rows:
        p, top = (h or "").encode(), max(by[h or ""])
        want.add((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many byte ranges a file
    try:
        got = [tuple(r) for r in warc.archive_round_trip(pages).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(got) == want and len(got) == len(rows)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
    twice = [tuple(r) for r in warc.archive_round_trip(pages.union(pages.filter("page_id = 2"))).collect()]
    assert len(twice) == len(rows) + 1 and sum(t[3] == "response" and t[0] == 2 for t in twice) == 1
