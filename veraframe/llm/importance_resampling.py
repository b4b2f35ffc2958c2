"""Resampling of documents towards a target distribution by importance weights.

Words and pairs of words are hashed into buckets. A bucket's gain compares how often the target and the corpus hold it; a
document's weight is the floored mean of its features' gains, looked up in an array with a number a bucket. Gumbel noise from a
digest of the id turns weights into scores whose largest are a weighted sample without replacement.

The k largest are found by a distributed quickselect over narrow rows: each round draws random pivot keys out of the open
range, counts all rows of that range below, at and above the pivots exactly, and keeps the range between the two pivots around the
k-th key. Keys (score, id, row number) are unique, so it ends at the k-th key itself. Only the winners are sorted, over
range partitions, and ranked.

Defined cases: an empty table gives no rows; null and empty texts have no features, weight 0 and no rank; a null id counts
as an empty one in the digest, and comes after all others in ties; repeated rows come out repeated, and rows that tie completely are ranked in
any order; an empty target gives every bucket the gain of t = T = 0; other columns are ignored. Texts are read in slices, so that
a long text needs little more memory than its bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.llm.common import materialise, small_batches
from veraframe.operators.ordering import running

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 7
SHARE = (25, 100)
PIVOTS = 32
SLICE_BYTES = 1 << 20
#: Letters A-Z as small ones; digits, small letters and bytes of other characters stay; all others part words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of features) of each slice of the text; pairs that cross a slice are in the later one."""
    data, at, before = (text or "").encode().translate(_BYTES), 0, None
    while at < len(data):
        stop = data.find(b" ", at + SLICE_BYTES)
        stop = len(data) if stop < 0 else stop
        words = data[at:stop].split()
        at = stop
        if not words:
            continue
        ones = [crc32(w) for w in words]
        firsts, seconds = (ones, words[1:]) if before is None else ([before, *ones], words)
        twos = [crc32(b" " + w, c) for c, w in zip(firsts, seconds, strict=False)]
        before = ones[-1]
        yield len(words), np.array(ones + twos, np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows each bucket has: a task gives its own counts, which Spark sums up; the answer has a number a bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for b in small_batches(batches, 0):
            for t in b.column(0):
                for _, found in feature_buckets(t.as_py(), buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, bucket by bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: object, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every row."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for b in small_batches(batches, 1):
            rows = []
            for k, t in zip(b.column(0), b.column(1), strict=True):
                words = features = total = 0
                for n, found in feature_buckets(t.as_py(), len(gain)):
                    words, features, total = words + n, features + len(found), total + int(gain[found].sum())
                weight = total // features if features else 0
                rows.append((features, words, weight, weight + noise(k.as_py(), seed)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long, score long")


def before(columns: list[Column], pivot: list, last: bool = False) -> Column:
    """Whether a row's key (ascending, by columns without nulls) comes before the pivot's, or with ``last`` is the pivot's."""
    out = F.lit(last)
    for c, v in reversed(list(zip(columns, pivot, strict=True))):
        out = (c < F.lit(v)) | ((c == F.lit(v)) & out)
    return out


def kth_key(rows: DataFrame, columns: list[Column], k: int, seed: int = SEED, pivots: int = PIVOTS) -> list:
    """The k-th (from 1) of the rows' keys, which must be unique and without nulls. ``rows`` is a narrow written table with at least k rows."""
    names = [f"k{i}" for i in range(len(columns))]
    keys = rows.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    cols, span, turn = [F.col(n) for n in names], F.lit(True), 0
    while True:
        opened = keys.filter(span)
        drawn = [list(r) for r in opened.orderBy(F.xxhash64(F.lit(seed), F.lit(turn), *cols), *cols).limit(pivots).collect()]  # PIVOTS rows
        drawn.sort()
        counts = opened.agg(*[F.count_if(before(cols, p)).alias(f"n{i}") for i, p in enumerate(drawn)]).first()
        low, high, done = None, None, 0
        for p, below in zip(drawn, counts, strict=True):
            if below == k - 1:
                return p
            if below >= k:
                high = p
                break
            low, done = p, below + 1
        span = span & (~before(cols, low, True) if low else F.lit(True)) & (before(cols, high) if high else F.lit(True))
        k, turn = k - done, turn + 1


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of ``docs``."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    rows = materialise(scored(docs, gain, key, text, seed).withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    fit = rows.filter(F.col("n_words") >= min_words)
    n = fit.count()
    k = share[0] * n // share[1]
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    kind = dict(rows.dtypes)["doc_id"]
    none = {"string": ""}.get(kind, 0)
    order = [-F.col("score"), F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(none).cast(kind)), F.col("row")]
    wins = before(order, kth_key(fit, order, k, seed), True) & (F.col("n_words") >= min_words)
    ranked = running(rows.filter(wins), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], {"rank": F.lit(1)})
    return ranked.select(*out, F.col("rank").cast("long").alias("rank")).unionByName(rows.filter(~wins).select(*out, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
