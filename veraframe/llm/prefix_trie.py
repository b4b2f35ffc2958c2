"""A prefix trie of conversations whose subtree sums are rolled up by bands of depth.

A node is a distinct sequence of first turns. Its key is made of its depth and of two running sums of digests of its turns
(each with its position), so keys come from running sums over the cluster and no conversation is chained turn by turn.
Nodes are counted from the members' rows. Sums over subtrees go by bands of ``BAND`` depths: a node adds to its ancestors
inside its band only, which are at most ``BAND`` keys out of the path of its smallest member. The roots of bands form
a tree that is ``BAND`` times flatter and is summed up in the same way; a band root's completed total is then added to the
ancestors of its parent inside their band. So a trie of depth d takes log(d) / log(BAND) levels, and a row is multiplied by at most
``BAND`` twice a level.

Defined cases: an empty table gives no rows; null roles and texts are empty; null turns come first, and equal turns of a
conversation are ordered by the digest of role and text; rows without a conv_id belong to no conversation; repeated
rows are turns of their own; other columns are ignored. SHA-256 of a list of ids is sequential, so the ids that end at one
node pass one task, sorted, in Arrow batches; nothing else of a node is brought together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.llm.common import materialise
from veraframe.operators.ordering import running

BAND = 16
WIDE = "decimal(38,0)"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def part_of_digest(digest: Column, first: int) -> Column:
    """56 bits of a hexadecimal digest as a decimal, whose running sums don't overflow."""
    return F.conv(F.substring(digest, first, 14), 16, 10).cast("decimal(17,0)")


def node_key(depth: Column, a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, a.cast(WIDE), b.cast(WIDE))))


def turn_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, digest, bytes and pos (from 0) of every turn; texts themselves are not moved."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role_), F.lit(":"), role_, text_), 256)
    turns = rows.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
    return running(turns, [F.col("turn").asc_nulls_first(), F.col("digest")], {"nth": F.lit(1)}, ["conv_id"]).select("conv_id", "digest", "bytes", (F.col("nth") - 1).alias("pos"))


def with_shared_heads(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where c begins with the first h turns of c - c % group, h being the CRC-32 of c modulo ``most``."""
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = materialise(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "trie-convs")
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    sized = convs.select("conv_id", "own", base.alias("base"), head.alias("h"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    sized = materialise(sized.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))), "trie-heads")
    # A conversation is the base of at most 2 * group - 1 others, and gives each at most ``most`` turns.
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    heads = sized.select("conv_id", "base", "taken").join(first, "base").filter(F.col("pos") < F.col("taken")).select("conv_id", "pos", "digest", "bytes")
    own = turns.join(sized.select("conv_id", "h", "taken"), "conv_id").filter(F.col("pos") >= F.col("h"))
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    return convs.select("conv_id"), heads.unionByName(own)


def member_rows(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, bytes and ends of every conversation at every depth, the root included."""
    mark = F.sha2(F.concat_ws(":", "pos", "digest"), 256)
    marked = turns.withColumn("mark", mark).select("conv_id", "pos", "bytes", part_of_digest(F.col("mark"), 1).alias("a"), part_of_digest(F.col("mark"), 15).alias("b"))
    summed = running(marked, [F.col("pos")], {"sum_a": F.col("a"), "sum_b": F.col("b")}, ["conv_id"])
    depth = (F.col("pos") + 1).cast("long")
    nodes = summed.select("conv_id", depth.alias("depth"), node_key(depth, F.col("sum_a"), F.col("sum_b")).alias("key"), node_key(F.col("pos").cast("long"), F.col("sum_a") - F.col("a"), F.col("sum_b") - F.col("b")).alias("parent"), "bytes")
    zero = F.lit(0)
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), node_key(F.lit(0).cast("long"), zero, zero).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    rows = materialise(nodes.unionByName(roots), "trie-rows")
    last = rows.groupBy("conv_id").agg(F.max("depth").alias("last"))
    return materialise(rows.join(last, "conv_id").withColumn("ends", F.col("depth") == F.col("last")).drop("last"), "trie-members")


def band_paths(path: DataFrame, step: int, band: int) -> DataFrame:
    """(conv_id, band_no, keys): the keys, with depths, of a conversation's nodes at multiples of ``step`` in a band; at most ``band`` of them."""
    some = path.filter(F.col("depth") % step == 0).withColumn("band_no", F.floor(F.col("depth") / (step * band)))
    return some.groupBy("conv_id", "band_no").agg(F.collect_list(F.struct("depth", "key")).alias("keys"))


def roll_up(nodes: DataFrame, path: DataFrame, sums: list[str], deepest: int, band: int = BAND, step: int = 1) -> DataFrame:
    """(key, *sums): each node's ``sums`` over its subtree. ``nodes`` has conv_id (a member), depth, key and ``sums``.

    ``path`` holds conv_id, depth and key of members' rows; depths here are multiples of ``step``.
    """
    paths = materialise(band_paths(path, step, band), "trie-paths")
    add = [F.sum(c).alias(c) for c in sums]
    band_no = F.floor(F.col("depth") / (step * band))

    def to_ancestors(rows: DataFrame) -> DataFrame:
        keys = F.filter("keys", lambda k: k.depth <= F.col("upto"))
        hit = rows.join(paths, ["conv_id", "band_no"]).select(F.explode(keys).alias("k"), *sums)
        return hit.select(F.col("k.key").alias("key"), *sums).groupBy("key").agg(*add)

    inside = to_ancestors(nodes.withColumn("band_no", band_no).withColumn("upto", F.col("depth")))
    if deepest < step * band:
        return inside
    inside = materialise(inside, "trie-inside")
    roots = nodes.filter(F.col("depth") % (step * band) == 0).select("conv_id", "depth", "key")
    roots = materialise(roots.join(inside, "key"), "trie-roots")
    done = materialise(roll_up(roots, path, sums, deepest, band, step * band), "trie-done")
    below = roots.select("conv_id", "depth", "key").filter(F.col("depth") > 0).join(done, "key")
    passed = to_ancestors(below.withColumn("band_no", band_no - 1).withColumn("upto", F.col("depth")))
    return inside.unionByName(passed).groupBy("key").agg(*add)


def ends_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end: ids in order pass a running SHA-256."""

    def run(batches):
        key, digest = None, None
        for b in batches:
            keys, shas = [], []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != key:
                    if digest is not None:
                        keys.append(key)
                        shas.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256(str(c).encode())
                else:
                    digest.update(b",%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    ends = members.filter("ends").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return ends.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, band: int = BAND) -> DataFrame:
    """A row per node of the trie of ``convs`` (conv_id) with ``turns`` (conv_id, pos from 0, digest, bytes)."""
    members = member_rows(convs, turns)
    nodes = materialise(members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    children = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    own = materialise(own, "trie-own")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    # Only paths of conversations that are the smallest member of a node are asked for.
    path = members.select("conv_id", "depth", "key").join(own.select("conv_id").distinct(), "conv_id", "left_semi")
    sums = ["n_leaves", "saved_tokens"]
    totals = materialise(roll_up(own.select("conv_id", "depth", "key", *sums), path, sums, deepest, band), "trie-totals")
    named = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = materialise(ends_digests(members), "trie-ends")
    out = own.drop(*sums).join(totals, "key").join(ends, "key", "left").join(named, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = materialise(turn_rows(rows, "conv_id", "turn", "role", "text"), "trie-turns")
    return prefix_trie(*with_shared_heads(turns))


#: CRC-32 of a decimal number, bit by bit (CRC's polynomial is a fixed value).
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {CRC_SQL.format("conv_id::VARCHAR")} % 9 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS own, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h
      UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h),
q AS (SELECT conv_id, list(sha256(strlen(role) || ':' || role || text) ORDER BY own, pos) AS turns, list(strlen(text) ORDER BY own, pos) AS bytes FROM r GROUP BY 1),
f AS (SELECT c.conv_id, coalesce(q.turns, []) AS turns, coalesce(q.bytes, []) AS bytes FROM c LEFT JOIN q ON q.conv_id = c.conv_id),
m AS (SELECT conv_id, d AS depth, turns[1:d] AS key, turns[1:d - 1] AS up, CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS bytes, len(turns) = d AS ends
      FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM f)),
n AS (SELECT key, depth, CASE WHEN depth > 0 THEN any_value(up) END AS up, min(conv_id) AS conv_id, max(bytes) AS bytes, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, depth),
k AS (SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.key = n.key),
s AS (SELECT key[1:a] AS key, a AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS a FROM w) GROUP BY 1, 2)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.key = w.key AND s.depth = w.depth LEFT JOIN n p ON p.key = w.up AND p.depth = w.depth - 1"""
