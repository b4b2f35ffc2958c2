"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams of lower-cased letter runs per language, over all labelled training documents; the
model has at most ``BUCKETS`` numbers a language. For a document, every word gets a likelihood under every language from
its trigrams. Expectation-maximisation then estimates the share of each language among the document's words; the
language set is chosen among the nested sets of the largest shares by likelihood less ``PENALTY * log(words)`` for each
further language, and shares are estimated again within every set until they settle. Sets of all sizes are tried; a
document leaves the search when a bound on the likelihood shows that no larger set can gain. The prediction is the
largest share.

Work is done on flat arrays over a slice of many documents at a time, so no document or batch is looped over by word, and
a worker holds the arrays of one slice (or of one document that is longer). Only the letters of a text go to Python.

Defined cases: an empty table gives no rows; a text that is null or has no letter is ``und`` with score 0; if there is
no labelled training document everything is ``und``; documents of any length are used whole; ties between languages go
to the first by code point; repeated rows are predicted alike (each counts in training); other columns pass through
:func:`identify` unchanged, but one that has the name of an output is replaced, as ``withColumn`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraframe.llm.common import fresh, give_back, small_batches

BUCKETS = 65_536
EM_ROUNDS = 8
PENALTY = 8.0
#: EM ends for a document when a round adds less than this to its log-likelihood, a word.
TOLERANCE = 1e-5
SMOOTHING = 0.5
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 256_000
UNKNOWN = "und"


def letters_only(text: str) -> Column:
    """Lower-cased letter runs, with blanks between them; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+", " "))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def trigrams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of letters' bytes, hash bucket of the trigram around each); ``buf`` begins and ends with a blank."""
    at = np.flatnonzero(buf != 32)
    code = np.zeros(len(at), np.uint32)
    for d, factor in ((-1, 0x9E3779B1), (0, 0x85EBCA6B), (1, 0xC2B2AE35)):
        code += buf[at + d] * np.uint32(factor)
    code ^= code >> np.uint32(15)
    return at, (code * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int32)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with blanks around them, where each text begins)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8), 1 + np.concatenate(([0], np.cumsum(sizes)[:-1]))


def byte_slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Index ranges of texts of about ``most`` bytes together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if texts:
        yield start, len(texts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of shape BUCKETS x languages) from rows with a language.

    Counts are summed by the cluster; what reaches the driver has at most BUCKETS rows a language.
    """

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in small_batches(batches, 0):
            texts, langs = [t.encode() for t in b.column(0).to_pylist()], np.array(b.column(1).to_pylist(), object)
            for lo, hi in byte_slices(texts):
                for name in set(langs[lo:hi]):
                    buf, _ = joined([texts[i] for i in range(lo, hi) if langs[i] == name])
                    got = np.bincount(trigrams(buf)[1], minlength=BUCKETS)
                    seen[name] = seen[name] + got if name in seen else got
        for name, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(letters_only(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    model = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(model["lang"].unique(), key=lambda x: x.encode())
    counts = np.zeros((BUCKETS, len(names)))
    counts[model["bucket"], [names.index(x) for x in model["lang"]]] = model["n"]
    used = max(1, int((counts.sum(1) > 0).sum()))
    return names, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * used)).astype(np.float32)


def shares(likely: np.ndarray, doc: np.ndarray, starts: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM: (shares per document, log-likelihood per document under them) from word likelihoods scaled to at most 1."""
    n = np.diff(np.append(starts, len(doc))).astype(np.float32)[:, None]
    for _ in range(rounds):
        r = likely * prior[doc]
        r /= r.sum(1, keepdims=True)
        prior = np.add.reduceat(r, starts, axis=0) / n
    return prior, np.add.reduceat(np.log((likely * prior[doc]).sum(1)).astype(float), starts)


def settled(likely: np.ndarray, doc: np.ndarray, live: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihoods of the documents ``live``, by EM until a round gains less than ``TOLERANCE`` a word."""
    out, fit = prior[live], np.full(len(live), -np.inf)
    todo = np.arange(len(live))
    place = np.full(len(prior), -1)
    while len(todo):
        place[:] = -1
        place[live[todo]] = np.arange(len(todo))
        mine = place[doc]
        rows, mine = likely[mine >= 0], mine[mine >= 0]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        words = np.diff(np.append(starts, len(mine)))
        going = np.ones(len(todo), bool)
        # Documents that have settled leave when they are at least half of those at work, so that rows are seldom copied.
        while 2 * going.sum() > len(todo):
            pi, ll = shares(rows, mine, starts, out[todo], 1)
            gains = ll - fit[todo]
            out[todo[going]], fit[todo[going]] = pi[going], ll[going]
            going &= gains >= TOLERANCE * words
        todo = todo[going]
    return out, fit


def mixtures(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language shares of every text (all 0 if it has no letter) and the number of languages chosen."""
    k = table.shape[1]
    out, chosen = np.zeros((len(texts), k), np.float32), np.zeros(len(texts), np.int64)
    buf, begins = joined(texts)
    at, codes = trigrams(buf)
    if not len(at):
        return out, chosen
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, among its letters' bytes
    words = np.add.reduceat(table[codes], first, axis=0)
    owner = np.searchsorted(begins, at[first], "right") - 1
    present, starts, doc = np.unique(owner, return_index=True, return_inverse=True)
    top = words.max(1, keepdims=True)
    likely = np.maximum(np.exp(words - top), np.float32(1e-12))
    n = np.diff(np.append(starts, len(doc)))
    prior, _ = shares(likely, doc, starts, np.full((len(present), k), 1 / k, np.float32), EM_ROUNDS)
    order = np.argsort(-prior, axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(likely), starts, axis=0, dtype=float)
    best, fit = np.eye(k, dtype=np.float32)[alone.argmax(1)], alone.max(1)
    count = np.ones(len(present), np.int64)
    _, ll = shares(likely, doc, starts, prior, 0)
    # No shares at all have a likelihood above this (log of a mean is at least the mean of logs).
    mixed = (likely * prior[doc]).sum(1)
    ratio = np.max([np.add.reduceat(likely[:, j] / mixed, starts, dtype=float) for j in range(k)], axis=0) / n
    most = ll + n * np.log(np.maximum(1, ratio))
    live = np.arange(len(present))
    for size in range(2, k + 1):
        cost = PENALTY * (size - 1) * np.log(n + 1)
        live = live[most[live] - cost[live] > fit[live]]  # others can't gain by this set or a larger one
        if not len(live):
            break
        within = np.where(rank < size, np.maximum(prior, 1e-6), 0).astype(np.float32)
        pi, ll = settled(likely, doc, live, within / within.sum(1, keepdims=True))
        ll = ll - cost[live]
        better = ll > fit[live]
        won = live[better]
        best[won], fit[won], count[won] = pi[better], ll[better], size
    out[present], chosen[present] = best, count
    return out, chosen


FOUND = T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.FloatType()))])


def found_in(docs: DataFrame, names: list[str], table: np.ndarray, text: str, maps: bool = True) -> Column:
    """Struct of the predicted language, its share and, with ``maps``, the shares of all chosen languages."""
    model = docs.sparkSession.sparkContext.broadcast((names, table))  # at most BUCKETS numbers a language

    @F.arrow_udf(returnType=FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, weights = model.value
        for b in batches:
            texts = b.cast(pa.binary()).to_pylist()
            pi = np.zeros((len(texts), max(1, len(langs))), np.float32)
            if langs:
                for lo, hi in byte_slices(texts):
                    pi[lo:hi] = mixtures(texts[lo:hi], weights)[0]
            top, known = pi.argmax(1), pi.sum(1) > 0
            found = pa.array([langs[i] if ok else UNKNOWN for i, ok in zip(top, known, strict=True)], pa.string())
            each = [[(langs[i], float(row[i])) for i in np.flatnonzero(row > 0)] for row in pi] if maps else [None] * len(pi)
            score = pa.array(np.clip(pi.max(1), 0, 1).astype(float), pa.float64())
            yield pa.StructArray.from_arrays([found, score, pa.array(each, pa.map_(pa.string(), pa.float32()))], names=FOUND.names)
        give_back()

    return run.asNondeterministic()(letters_only(text))  # so that it is evaluated once


def identify(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text", pred: str = "lang_pred", score: str = "score", share: str = "shares") -> DataFrame:
    """``docs`` with the predicted language, its share and the shares of all chosen languages (a map)."""
    out = fresh(docs, "found")
    found = docs.withColumn(out, found_in(docs, names, table, text))
    return found.withColumns({pred: F.col(f"{out}.pred"), score: F.col(f"{out}.score"), share: F.col(f"{out}.shares")}).drop(out)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """Documents whose language is known and makes up at least ``least`` of their words, with their own columns."""
    names, table = train(docs.filter(~held_out(key)), text, lang)
    out = fresh(docs, "found")
    found = docs.withColumn(out, found_in(docs, names, table, text, maps=False))
    return found.filter((F.col(f"{out}.pred") != UNKNOWN) & (F.col(f"{out}.score") >= least)).select(*docs.columns)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, table = train(docs.filter(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), names, table).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.map_keys("shares").alias("languages"))
