"""Exact de-duplication by a tree merge of sorted digest runs.

Every scan partition is first reduced to a sorted run with one entry per digest (so a group of copies of any size leaves
at most one entry a run). Runs then meet in binomial rounds. In round ``k``, runs whose numbers differ in bit ``k`` alone
exchange halves: one of them gets both runs' entries whose digest has that bit unset, the other those with it set. Each
sorts and merges what it has received, keeps the smallest identifier of every digest and adds up the copies. After
``log2(runs)`` rounds, run ``r`` holds the entries of all partitions whose digests end in the bits of ``r``, so the merged
run is spread evenly, and no task ever had more than its share of the digests. The answer goes back to each partition's
entry of a digest and from there to its rows, so a large group of copies is met in pieces, one a partition.

Only DataFrame functions are used. Texts are equal when identical after deleting all characters of
``[\\x20\\x09-\\x0D]``; a null text counts as empty. The SHA-256 of that form is the digest; a second, independent
64-bit hash travels along and is verified at every level: a digest that stands for two texts fails the job.

Defined cases: an empty table gives no rows; empty and null texts form one group; of equal texts the longest original
(code points) stays, then the smallest id (a null id is largest), and among rows that repeat both exactly one stays.
Other columns of the input are ignored by :func:`exact_groups` and passed through by :func:`drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.llm.common import BLANKS, fresh, keep_rows, materialise, same

#: Runs of more scan partitions than this begin together, which bounds the blocks of an exchange.
MOST_RUNS = 8192


def squeezed(text: str) -> Column:
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def text_digest(text: str) -> Column:
    return F.unhex(F.sha2(squeezed(text), 256))


def digest_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One narrow row per document, written to the shared folder: run, row number, id, length, digest and check hash."""
    return materialise(
        docs.select(
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
            F.col(key).alias("id"),
            F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
            text_digest(text).alias("digest"),
            F.xxhash64(squeezed(text)).alias("check"),
        ),
        "digest-runs",
    )


def merged(entries: DataFrame, partitions: int, n: Column) -> DataFrame:
    """Entries sent to the partitions of their runs, sorted by digest and merged: one entry per run and digest.

    It has the best row, the sum of ``n`` and the check hash, of which an entry can have but one.
    """
    # The count that every later level needs is the one that is verified, so that no level's check can be left out.
    verified = F.when(F.min("check") == F.max("check"), F.sum(n)).otherwise(F.raise_error(F.lit("one digest stands for two texts")).cast("long"))
    in_order = entries.repartitionById(partitions, "run").sortWithinPartitions("run", "digest")
    return in_order.groupBy("run", "digest").agg(F.min("best").alias("best"), verified.alias("n"), F.min("check").alias("check"))


def merge_runs(runs: DataFrame, most_runs: int = MOST_RUNS) -> tuple[DataFrame, DataFrame]:
    """(leaves, root): the entries of every scan partition, and those of all, spread over runs by digest.

    A root entry has ``best`` (the row that stays) and ``n`` (rows of the group).
    """
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "row")
    parts = (runs.agg(F.max("run")).first()[0] or 0) + 1
    rounds = (min(parts, most_runs) - 1).bit_length()
    count = 1 << rounds
    leaves = materialise(merged(runs.select("run", "digest", best.alias("best"), "check"), count, F.lit(1)), "digest-leaves")
    bits = F.conv(F.hex(F.substring("digest", -4, 4)), 16, 10).cast("long")  # the end of a digest says where it belongs
    level = leaves.withColumn("run", F.col("run") % count)
    if parts > count:
        level = merged(level, count, F.col("n"))
    for k in range(rounds):
        bit = 1 << k
        to = F.col("run").bitwiseAND((count - 1) ^ bit) + bits.bitwiseAND(bit).cast("int")
        level = merged(level.withColumn("run", to), count, F.col("n"))
    return leaves, materialise(level.select("digest", "best", "n"), "digest-root")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", most_runs: int = MOST_RUNS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, and n_chars, digest, row for joins."""
    runs = digest_runs(docs, key, text)
    leaves, root = merge_runs(runs, most_runs)
    answer = leaves.select("run", "digest").join(root, "digest")
    return runs.join(answer, ["run", "digest"]).select(
        "id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
        "digest",
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and nothing else."""
    groups = materialise(exact_groups(docs, key, text).select("id", "n_chars", "digest", "kept"), "exact-groups")
    kept = groups.filter("kept").drop("kept")
    spare = groups.filter("not kept").drop("kept")
    # Rows that repeat a kept row in id and length can only be told apart by dropping repeats.
    twins = materialise(spare.join(kept, same(spare, kept, {"id": "id", "n_chars": "n_chars", "digest": "digest"}), "left_semi").distinct(), "exact-twins")
    drop = materialise(spare.join(twins, same(spare, twins, {"id": "id", "n_chars": "n_chars", "digest": "digest"}), "left_anti"), "exact-drop")
    digest, n = fresh(docs, "digest"), fresh(docs, "n_chars_now")
    wide = docs.withColumn(digest, text_digest(text)).withColumn(n, F.coalesce(F.length(text), F.lit(0)).cast("long"))
    columns = {key: "id", n: "n_chars", digest: "digest"}
    single = keep_rows(wide, kept, drop, columns)
    if twins.isEmpty():
        return single.select(*docs.columns)
    once = single.join(twins, same(single, twins, columns), "left_anti")
    repeated = single.join(twins, same(single, twins, columns), "left_semi").dropDuplicates([key, digest])
    return once.unionByName(repeated).select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
