"""Event-time monitoring in append mode, and scores of new rows with a state that the watermark bounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veraframe.sources.shared import materialise, new_path
from veraframe.streaming.jobs import timed


def closed_windows(log: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and latency by verdict of windows that the watermark has passed; each comes out once and never changes.

    For a stream in append mode. The watermark is ``late`` before the latest time of earlier runs or batches. A row whose
    window has ended by then is late and is dropped; a row before the watermark whose window is open still counts. Rows without a
    time belong to no window.
    """
    grouped = timed(log).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "verdict")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("total_ms").alias("sum_ms"), F.max("total_ms").alias("max_ms")).select("w", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "verdict", "n", "sum_ms", "max_ms")


def rolled_up(windows: DataFrame, window: str = "1 day") -> DataFrame:
    """Longer windows over those of :func:`closed_windows`, chained in one stream: what was late there is in neither."""
    grouped = windows.groupBy(F.window("w", window).alias("longer"))
    return grouped.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows"), F.sum("sum_ms").alias("sum_ms"), F.max("max_ms").alias("max_ms")).select(F.col("longer.start").alias("start"), F.col("longer.end").alias("end"), "n", "windows", "sum_ms", "max_ms")


def counters(query: StreamingQuery) -> dict[str, int]:
    """What an ended run says of its state: groups dropped as late (rows that share a window and key are one) and rows held at the end."""
    steps = [[(op.numRowsDroppedByWatermark, op.numRowsTotal) for op in p.stateOperators] for p in query.recentProgress]
    return {"dropped": sum(d for s in steps for d, _ in s), "held": sum(t for _, t in steps[-1]) if steps else 0}


def in_turns(rows: DataFrame, turn: str, run: Callable[[DataFrame], StreamingQuery]) -> list[dict[str, int]]:
    """Feeds ``rows`` to a stream of files turn by turn (there are few), each in a run that starts from the last one's checkpoint.

    ``run`` starts a query over the stream that it is given, always with the same checkpoint; the answer has a run's :func:`counters`.
    """
    spark, source, out = rows.sparkSession, new_path(rows.sparkSession, "arrivals"), []
    written = materialise(rows, "turns")
    for (t,) in written.select(turn).distinct().orderBy(turn).collect():  # turns
        part = written.filter(F.col(turn) == t).drop(turn)
        part.write.mode("append").parquet(source)
        query = run(spark.readStream.schema(part.schema).parquet(source))
        query.awaitTermination()
        out.append(counters(query))
    return out


def appended(spark: SparkSession, job: Callable[[DataFrame], DataFrame], rows: DataFrame, turn: str) -> tuple[DataFrame, list[dict[str, int]]]:
    """What ``job`` has emitted in append mode after all turns, as a table in the shared folder, and each turn's counters."""
    out, schemas = new_path(spark, "stream"), []

    def run(stream: DataFrame) -> StreamingQuery:
        done = job(stream)
        schemas.append(done.schema)
        return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()

    reports = in_turns(rows, turn, run)
    return spark.read.schema(schemas[-1]).parquet(out), reports


def scores_within(frames: DataFrame, score: Callable[[DataFrame], DataFrame], keys: list[str], out: str, checkpoint: str, within: str = "1 day") -> StreamingQuery:
    """Scores of a stream's new rows: a key that comes again within ``within`` of its first row is not scored again.

    Nothing that is stored is read: what tells new keys is the state, which holds the keys of the last ``within`` alone, so a
    batch costs what its rows and that state cost, however much is stored. Keys that come later than that may be scored again;
    :func:`first_scores` reads the first. A batch is a partition of its own, which a retry writes anew. Rows without a time
    are left out, as are rows not after the watermark, which starts at 1970-01-01 00:00:00 UTC.
    """
    new = timed(frames).filter("ts IS NOT NULL").withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_scores(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Each key's score of the earliest batch that has one, and ``times``, how often it was scored."""
    stored = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    values = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(F.min_by(F.struct(*values), "batch").alias("first"), F.count(F.lit(1)).alias("times")).select(*keys, "first.*", "times")
