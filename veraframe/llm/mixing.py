"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets: all sources start on their weighted share of the total; a source whose share exceeds ``max_epochs`` times its
size is clamped there, and what it cannot take is shared again among the others by weight, until no share exceeds its
cap. A round needs two sums over the sources only.

Repetitions: a source with target ``t`` and size ``s`` repeats every document ``floor(t / s)`` times, and a seeded
sample of its documents once more. Documents are put in the order of a seeded hash; the sample is the longest run of
that order that does not pass the fractional words. Then comes, in rounds, the largest document that still fits, and
from round ``FILL_ROUNDS`` on also the longest run of those that fit after it, until none fits: at least half of the gap
closes in such a round, so there are at most as many as the gap has bits. The order is cut through ``BUCKETS`` hash buckets per source: sizes are summed per
bucket, so only the bucket in which a run ends is looked into row by row, and a source that holds most rows is never
brought to one task. The query op8 is held to its SQL, which ends after ``FILL_ROUNDS`` single documents.

Defined cases: an empty table gives no rows; a null or empty text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; rows with the same id tie in the order and are told apart by size and text; rows with
a null id are put in order by their texts;
repeated rows are interchangeable; other columns are ignored by :func:`mix` and passed through by :func:`mixed_documents`.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veraframe.llm.common import WORD_CLASS, fresh, materialise

SEED = "mix-1"
BUCKETS = 65_536
FILL_ROUNDS = 3


def water_fill(sources: DataFrame, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (source, source_size) with weight and target (double).

    Sources are ordered by code point (null last) and weigh ``weights``, repeating.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    rank = F.row_number().over(in_order)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    table = materialise(sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs), "mix-sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level_words, level_weight = total, None
    clamped = F.lit(False)
    while True:
        # Clamped sources have their caps; the rest shares what is left by weight.
        taken, free = table.agg(F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0))).first()
        if (total - taken, free) == (level_words, level_weight) or not free:
            break
        level_words, level_weight = total - taken, free
        clamped = F.col("cap") * F.lit(level_weight) <= F.lit(level_words) * F.col("weight")
    share = F.lit(float(level_words)) * F.col("weight") / F.lit(float(level_weight or 1))
    return table.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(share))


def sized(docs: DataFrame, key: str, text: str, source: str, seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words, and the seeded order of every row."""
    # Rows without an id are put in order by their text, so that they do not all stand at one place.
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.coalesce(F.sha2(text, 256), F.lit(""))))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), known), 256)
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long").alias("size"),
        F.substring(order, 1, 16).alias("order"),
        F.xxhash64(text).alias("tie"),
    )


def bucket_of_order() -> Column:
    return F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("long") * BUCKETS / 65_536)


def longest_run(rows: DataFrame, cells: DataFrame, limits: DataFrame) -> DataFrame:
    """Written table of ``rows`` with limits' columns but ``of``, and extra: whether a row is in its source's run.

    ``cells`` are the words of rows by source and bucket; ``limits`` has a row a source, with of and part.
    """
    # Buckets wholly in the run, and the one in which it ends. Sums run over 256 buckets, and over groups of them.
    coarse = F.floor(F.col("bucket") / 256)
    groups = cells.groupBy("source", coarse.alias("coarse")).agg(F.sum("words").alias("words"))
    groups = groups.select(F.col("source").alias("g_source"), F.col("coarse").alias("g_coarse"), F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups_before"))
    fine = cells.withColumn("coarse", coarse).withColumn("within", F.coalesce(F.sum("words").over(Window.partitionBy("source", "coarse").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = fine.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("coarse") == F.col("g_coarse")))
    placed = placed.select("source", "bucket", "words", (F.col("within") + F.col("groups_before")).alias("earlier"))
    state = placed.join(limits, F.col("source").eqNullSafe(F.col("of")))
    state = state.withColumn("ends", (F.col("earlier") + F.col("words") > F.col("part")) & (F.col("earlier") <= F.col("part")))
    state = state.select(*limits.columns, "bucket", "earlier", "ends", (F.col("earlier") + F.col("words") <= F.col("part")).alias("in"))
    state = materialise(state, "mix-buckets").withColumnRenamed("bucket", "in_bucket")
    joined = rows.withColumn("bucket", bucket_of_order()).join(state, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket"))).drop("of", "in_bucket")
    joined = materialise(joined, "mix-joined")

    in_end = Window.partitionBy("source").orderBy("order", "doc_id", "size", "tie", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = joined.filter("ends").withColumn("extra", F.col("earlier") + F.sum("size").over(in_end) <= F.col("part"))
    rest = joined.filter("not ends").withColumn("extra", F.col("in"))
    return materialise(end.unionByName(rest).drop("earlier", "ends", "in", "bucket"), "mix-chosen")


def largest(open_rows: DataFrame) -> DataFrame:
    """of, row and size of each source's largest row, the first in order of those."""
    best = F.min(F.struct((-F.col("size")).alias("larger"), "order", "doc_id", "tie", "row")).alias("best")
    return materialise(open_rows.groupBy(F.col("source").alias("of")).agg(best).select("of", F.col("best.row").alias("best_row"), (-F.col("best.larger")).alias("best_size")), "mix-fill")


def fill(chosen: DataFrame, rounds: int | None) -> DataFrame:
    """``chosen`` with extra for the rows that fit the gap besides.

    They are found in rounds until no row fits, or one row a source in each of ``rounds`` rounds. Without ``rounds``,
    what the first ``FILL_ROUNDS`` rows leave open is closed by runs.
    """
    taken = F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))
    gaps = materialise(chosen.groupBy(F.col("source").alias("of")).agg((F.first("part") - taken).alias("part")), "mix-gaps")  # one row a source
    open_rows = chosen.filter(~F.col("extra") & (F.col("size") > 0)).select("doc_id", "source", "size", "order", "tie", "row")
    picked = []
    while rounds is None or len(picked) < rounds:
        fits = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") <= F.col("part"))
        open_rows = materialise(open_rows.join(gaps, fits).drop("of", "part"), "mix-open")
        best = largest(open_rows)
        if best.isEmpty():
            break
        picks = best.select("best_row")
        left = gaps.join(best.withColumnRenamed("of", "best_of"), F.col("of").eqNullSafe(F.col("best_of")))
        gaps = materialise(left.select("of", (F.col("part") - F.col("best_size")).alias("part")), "mix-gaps")
        # The row number is unique, so this equi-join has no skew.
        open_rows = open_rows.join(best.select(F.col("best_row").alias("row")), "row", "left_anti")
        if rounds is None and len(picked) + 1 >= FILL_ROUNDS:
            open_rows = materialise(open_rows.join(gaps, fits).drop("of", "part"), "mix-open")
            run = longest_run(open_rows, words_by_bucket(open_rows), gaps)
            picks = picks.union(run.filter("extra").select("row"))
            used = run.groupBy(F.col("source").alias("of")).agg((F.first("part") - taken).alias("part"))
            gaps, open_rows = materialise(used, "mix-gaps"), run.filter("not extra").drop("part", "extra")
        picked.append(picks)
    if not picked:
        return chosen
    added = functools.reduce(DataFrame.union, picked)
    return materialise(chosen.join(added, F.col("row") == F.col("best_row"), "left").withColumn("extra", F.col("extra") | F.col("best_row").isNotNull()).drop("best_row"), "mix-chosen")


def words_by_bucket(rows: DataFrame) -> DataFrame:
    """Written table of the words by source and bucket of the order."""
    return materialise(rows.groupBy("source", bucket_of_order().alias("bucket")).agg(F.sum("size").alias("words")), "mix-cells")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, fill_rounds: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and repeats of every row, and tie (a hash of its text).

    With ``fill_rounds``, at most so many documents a source come after the run.
    """
    rows = materialise(sized(docs, key, text, source, seed).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    cells = words_by_bucket(rows)
    sources = water_fill(cells.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs, weights)
    whole = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))
    whole = F.coalesce(F.when(F.col("source_size") > 0, whole), F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialise(sources, "mix-targets").withColumnRenamed("source", "of").select("of", "source_size", "target", "whole", "part")
    chosen = fill(longest_run(rows, cells, sources), fill_rounds)
    repeats = F.col("whole") + F.when(F.col("extra") & (F.col("whole") < max_epochs), 1).otherwise(0)
    return chosen.withColumn("repeats", repeats).withColumn("taken", F.col("repeats") * F.col("size")).drop("whole", "part", "extra", "order", "row")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns. Rows of size 0 are not taken."""
    plan = mix(docs, key, text, source, max_epochs, weights).filter("taken > 0")
    # Rows that tie in id and text are one entry with the sum of their repetitions, kept by one of them.
    plan = materialise(plan.groupBy("doc_id", "tie").agg(F.sum("repeats").alias("repeats"), F.count(F.lit(1)).alias("rows")), "mix-plan")
    names = {}
    for c in ("tie", "n_of_mix", "plan_id", "plan_tie", "plan_repeats", "plan_rows"):
        names[c] = fresh(docs, c)
    tie, n, repeats, rows = names["tie"], names["n_of_mix"], names["plan_repeats"], names["plan_rows"]
    tied = docs.withColumn(tie, F.xxhash64(text))
    small = plan.select(F.col("doc_id").alias(names["plan_id"]), F.col("tie").alias(names["plan_tie"]), F.col("repeats").alias(repeats), F.col("rows").alias(rows))
    joined = tied.join(small, tied[key].eqNullSafe(small[names["plan_id"]]) & tied[tie].eqNullSafe(small[names["plan_tie"]]))
    if not plan.filter("rows > 1").isEmpty():
        single = joined.filter(F.col(rows) == 1)
        joined = single.unionByName(joined.filter(F.col(rows) > 1).dropDuplicates([key, tie]))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, fill_rounds=FILL_ROUNDS).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def oracle(max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED) -> str:
    """DuckDB SQL for op8: clamping as the smallest set of sources, ordered by cap per weight, and the same sample."""
    fills = "".join(
        f"""
, g{i} AS (SELECT *, part - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c{i})
, c{i + 1} AS (
  SELECT doc_id, source, size, ord, source_size, target, whole, part,
         extra OR (size > 0 AND size <= gap AND row_number() OVER (PARTITION BY source, NOT extra AND size > 0 AND size <= gap ORDER BY size DESC, ord, doc_id) = 1) AS extra
  FROM g{i})"""
        for i in range(FILL_ROUNDS)
    )
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(sha256('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 16) AS ord FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST({list(weights)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS INT) + 1] AS BIGINT) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, source_size * {max_epochs} AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size * {max_epochs}) OVER (ORDER BY source_size * {max_epochs} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
         CAST(sum(weight) OVER (ORDER BY source_size * {max_epochs} / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS above
  FROM s
), f AS (SELECT *, cap * above <= (total - below) * weight AS clamped FROM o
), l AS (
  SELECT CAST(max(total) - coalesce(sum(cap) FILTER (WHERE clamped), 0) AS DOUBLE) AS words, CAST(sum(weight) FILTER (WHERE NOT clamped) AS DOUBLE) AS weights FROM f
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE words * weight / weights END AS target FROM f, l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), {max_epochs}) AS BIGINT) ELSE 0 END AS whole FROM t
), c0 AS (
  SELECT doc_id, d.source, size, ord, source_size, target, whole, target - whole * source_size AS part,
         sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) <= target - whole * source_size AS extra
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
){fills}
SELECT doc_id, size, source_size, target, (whole + CASE WHEN extra AND whole < {max_epochs} THEN 1 ELSE 0 END) * size AS taken,
       source, whole + CASE WHEN extra AND whole < {max_epochs} THEN 1 ELSE 0 END AS repeats
FROM c{FILL_ROUNDS}
"""
