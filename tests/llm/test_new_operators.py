"""Resampling, chat formatting and the prefix trie against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veraframe.llm import chat_format, importance_resampling, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, example string, pos int"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(docs, target, buckets=10_000, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in set(s) | set(t)}
    out = []
    for k, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(sha(f"7:{'' if k is None else k}")[:8], 16)
        out.append([k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {id(x): i + 1 for i, x in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted(((*x[:4], rank.get(id(x))) for x in out), key=str)


@pytest.mark.parametrize("slice_bytes", [7, 1 << 20])
def test_resampling_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance_resampling, "SLICE_BYTES", slice_bytes)
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA7", "élan", "ÉA", "x_y", "9", "d-e", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "...!"), (None, "beta " * 40), (5, docs[5][1]), (400, "long élan " * 50_000)]
    target = ["alpha beta alpha beta", None, "élan élan 9"]
    got = importance_resampling.resample(spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, row int, score int").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"))
    found = [tuple(r) for r in got.collect()]
    ranks = lambda rows: sorted(r[4] for r in rows if r[4])
    want = resampled(docs, target)
    assert sorted((r[:4] for r in found), key=str) == sorted((r[:4] for r in want), key=str) and ranks(found) == ranks(want)
    assert sorted((r for r in found if r[0] != 5), key=str) == [r for r in want if r[0] != 5]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resampling.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[0:2] + tuple(r)[4:] for r in importance_resampling.resample(one, none).collect()] == [(1, 3, None)]


def test_quickselect_finds_every_place(spark):
    rng = random.Random(5)
    values = [(rng.randint(-3, 3), i) for i in range(200)]
    rows = spark.createDataFrame(values, "v long, i long")
    for k in (1, 2, 77, 199, 200):
        assert tuple(importance_resampling.kth_key(rows, [F.col("v"), F.col("i")], k, pivots=3)) == sorted(values)[k - 1]


def formatted(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.append((c, len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


CHATS = [
    (1, 0, "user", "a <|im_end|> b <\\|im_start|> <"), (1, 1, "assistant", "<|im_sep|>\\<|"), (1, 2, "user", "日本 $1 \\1 \\Q"), (1, 3, "assistant", ""), (1, 4, "assistant", "é\n\n"),
    (2, 0, "user", None), (3, 0, None, "x"), (3, None, "assistant", "first"), (4, 0, "sys<|im_sep|>\ntem", "s"), (4, 1, "assistant", "r"), (4, 2, "user", "left over"),
    (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"), (None, 0, "assistant", "no id"), (6, 0, "user", "long " * 100_000), (6, 1, "assistant", "<|" * 1000),
]


def test_chat_format_is_read_back_whole(spark):
    rows = spark.createDataFrame([(*r, "clash", 0) for r in CHATS], TURNS).repartition(5)
    got = sorted((tuple(r)[:5] for r in chat_format.read_back(chat_format.chat_examples(rows)).collect()), key=str)
    assert got == formatted(CHATS)
    assert chat_format.read_back(chat_format.chat_examples(rows.limit(0))).count() == 0


def test_examples_hold_their_context_and_mask_one_reply(spark):
    rows = spark.createDataFrame([(*r, "clash", 0) for r in CHATS if r[0] in (1, 4)], TURNS)
    got = {(r.conv_id, r.example): r for r in chat_format.chat_examples(rows).collect()}
    assert len(got) == 5 and [got[4, i].loss_start is None for i in (0, 1)] == [False, True]
    assert got[1, 2].formatted.startswith(got[1, 1].formatted) and got[1, 1].formatted.startswith(got[1, 0].formatted)
    masked = [got[1, i].formatted[got[1, i].loss_start : got[1, i].loss_end] for i in range(3)]
    assert masked == ["<\\|im_sep|>\\<\\|", "", "é\n\n"]
    assert got[1, 0].formatted.count("<|im_end|>") == 2 and got[1, 2].formatted.count("<|im_end|>") == 5


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)))) for p, m in members.items()), key=str)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_trie_equals_brute_force(spark, band):
    rng = random.Random(band)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", None, ""])) for c in range(-12, 60) if c % 7 for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in (100, 101, 102, 200) for t in range(45)] + [(3, None, "user", "first"), (3, None, "user", "first"), (None, 0, "user", "x")]
    turns = prefix_trie.turn_rows(spark.createDataFrame([(*r, "clash", 0) for r in rows], TURNS).repartition(5), "conv_id", "turn", "role", "text")
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns), band)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)


def test_trie_of_nothing(spark):
    turns = prefix_trie.turn_rows(spark.createDataFrame([], TURNS), "conv_id", "turn", "role", "text")
    assert prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns)).count() == 0


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_prefix_trie"])
def test_sql(spark, name):
    from tests.compare import duck_rows, spark_rows
    from veraframe.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(queries.ORACLES[name], sf_dir)


def test_resampling_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = resampled([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert sorted((tuple(r) for r in importance_resampling.op11_importance_resampling(spark, sf_dir).collect()), key=str) == want
