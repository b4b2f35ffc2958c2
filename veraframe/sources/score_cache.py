"""A score cache that is committed shard by shard.

Frames fall into shards by a hash of their keys. Below the cache's path, ``scores/tag=T/shard=S`` holds a shard's scores and
``commits/tag=T/shard=S`` its commit: the number of frames, two 64-bit digests over their keys and content hashes, the settings
of the scorer and the number of shards. Scores are written first, by replacing whole shards; a shard counts once its commit is there,
which is worked out from what was written. A run that dies between the two leaves shards without a commit; the next
one replaces them, so no retry doubles a row.

Defined cases: no frames give no rows and no shards; frames that repeat (same keys and hash) are one; null keys and hashes are values
like others; a shard whose frames or hashes are not those of its commit, other settings, another number of shards and a tag that the
cache does not have are refused with :class:`StaleScores`, as are scores that are missing, null or not finite.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraframe.sources.shared import materialise

SHARDS = 64


class StaleScores(ValueError):
    """The cache holds scores of other frames, of another scorer, or not all of them."""


def shard_of(keys: list[str], shards: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def shard_digests(frames: DataFrame, keys: list[str], content_hash: str, shards: int) -> DataFrame:
    """shard, n, low and high: a digest over the distinct (keys, hash) of each shard that does not depend on their order."""
    ids = frames.select(*keys, content_hash).distinct().withColumn("shard", shard_of(keys, shards))
    return ids.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, content_hash)).alias("low"), F.bit_xor(F.xxhash64(F.lit(1), content_hash, *keys)).alias("high"))


def verified(frames: DataFrame, content: str, content_hash: str) -> DataFrame:
    """``frames``, whose job fails at the first one whose bytes do not have the SHA-256 that it states."""
    same = F.sha2(F.col(content), 256).eqNullSafe(F.col(content_hash))
    wrong = F.raise_error(F.concat(F.lit("content does not match its hash "), F.coalesce(F.col(content_hash), F.lit("null"))))
    return frames.withColumn(content, F.when(same, F.col(content)).otherwise(wrong.cast(frames.schema[content].dataType)))


def _stored(spark: SparkSession, path: str, tag: str) -> DataFrame | None:
    """The table's rows under ``tag``; None where the table is not there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name not in ("tag", "shard")]).add("tag", T.StringType()).add("shard", T.IntegerType())
    return spark.read.schema(schema).parquet(path).filter(F.col("tag") == tag)


def _replace(rows: DataFrame, path: str, tag: str) -> None:
    """Writes ``rows`` below ``path``; of the partitions there, those that ``rows`` has are replaced and all others stay."""
    rows.withColumn("tag", F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag", "shard").parquet(path)


def _compared(expected: DataFrame, path: str, tag: str, settings: str, shards: int) -> DataFrame:
    """``expected`` (a row a shard) with ``done``; fails where a commit is not of these frames, settings or shards."""
    commits = _stored(expected.sparkSession, f"{path}/commits", tag)
    if commits is None:
        return expected.withColumn("done", F.lit(False))
    other = commits.filter((F.col("settings") != settings) | (F.col("shards") != shards)).first()
    if other:
        raise StaleScores(f"{tag} was scored with settings {other.settings} in {other.shards} shards, not with {settings} in {shards}")
    held = commits.select("shard", F.struct("n", "low", "high").alias("held"))
    both = materialise(expected.withColumn("found", F.struct("n", "low", "high")).join(held, "shard", "full"), "shards")
    stale = both.filter(F.col("held").isNotNull() & ~F.col("held").eqNullSafe(F.col("found"))).agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("first")).first()
    if stale.n:
        raise StaleScores(f"{stale.n} shards of {tag}, the first {stale.first}, were scored for other frames or contents")
    return both.select(*expected.columns, F.col("held").isNotNull().alias("done"))


def write_shards(frames: DataFrame, keys: list[str], content_hash: str, path: str, tag: str, score: Callable[[DataFrame], DataFrame], shards: int = SHARDS) -> None:
    """Scores ``frames`` and replaces their shards, without a commit. ``score`` returns keys, hash and score columns."""
    scored = score(frames.dropDuplicates([*keys, content_hash])).withColumn("shard", shard_of(keys, shards))
    _replace(scored.hint("rebalance", "shard"), f"{path}/scores", tag)


def fill(frames: DataFrame, keys: list[str], content_hash: str, path: str, tag: str, settings: str, score: Callable[[DataFrame], DataFrame], shards: int = SHARDS) -> dict[str, int]:
    """Scores the shards of ``frames`` that have no commit under ``tag`` and commits them; how many there are, were resumed and computed."""
    spark = frames.sparkSession
    expected = materialise(shard_digests(frames, keys, content_hash, shards), "shard-digests")
    state = materialise(_compared(expected, path, tag, settings, shards), "shard-states")
    total, done = state.agg(F.count(F.lit(1)), F.count_if("done")).first()
    counts = {"shards": total, "resumed": done, "computed": total - done}
    if total == done:
        return counts
    todo = F.broadcast(state.filter(~F.col("done")).select("shard"))  # at most ``shards`` rows
    part = frames.withColumn("shard", shard_of(keys, shards)).join(todo, "shard", "left_semi").drop("shard")
    write_shards(part, keys, content_hash, path, tag, score, shards)
    written = _stored(spark, f"{path}/scores", tag).join(todo, "shard", "left_semi")
    numbers = [f.name for f in written.schema if f.name not in (*keys, content_hash, "tag", "shard") and isinstance(f.dataType, T.NumericType)]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.col(c).isNull() | F.col(c).cast("double").isin(float("nan"), float("inf"), float("-inf"))
    rows = written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
    found = materialise(shard_digests(written, keys, content_hash, shards).join(rows, "shard"), "shards-written")
    right = found.join(state, ["shard", "n", "low", "high"]).filter((F.col("rows") == F.col("n")) & (F.col("bad") == 0))
    _replace(right.select("shard", "n", "low", "high", F.lit(settings).alias("settings"), F.lit(shards).alias("shards")).coalesce(1), f"{path}/commits", tag)
    lost = total - done - right.count()
    if lost:
        raise StaleScores(f"the scorer gave missing, repeated or malformed scores in {lost} shards of {tag}; they are not committed")
    return counts


def consolidated(frames: DataFrame, keys: list[str], content_hash: str, order: list[str], path: str, tag: str, settings: str, shards: int = SHARDS) -> DataFrame:
    """``keys``, the hash, ``order`` and the scores of all ``frames``, in the order of ``order``; refuses an incomplete cache."""
    expected = materialise(shard_digests(frames, keys, content_hash, shards), "shard-digests")
    missing = _compared(expected, path, tag, settings, shards).filter(~F.col("done")).count()
    if missing:
        raise StaleScores(f"{missing} shards of {tag} have no commit")
    ids = [*keys, content_hash]
    rows = frames.select(*dict.fromkeys([*ids, *order])).dropDuplicates(ids)
    scores = _stored(frames.sparkSession, f"{path}/scores", tag)
    if scores is None:
        return rows
    on = F.lit(True)
    for c in ids:
        on = on & rows[c].eqNullSafe(scores[c])
    values = [scores[c] for c in scores.columns if c not in (*ids, "tag", "shard")]
    return rows.join(scores, on).select(*[rows[c] for c in rows.columns], *values).orderBy(*order)
