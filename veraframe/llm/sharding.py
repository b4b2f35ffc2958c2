"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; a document's id, size and CRC hash to a cell (so that neither null nor frequent ids
share one), and each shard owns the cells up to each of its virtual nodes. More than ``TIE_ROWS`` rows that are equal in
all three are numbered and take a cell for each such number of rows. Loads are summed per cell, so all further work is on a table whose size is fixed by ``CELLS`` whatever the
input. In each round every unplaced cell asks the next virtual node clockwise whose shard is not full; a shard takes its
largest askers that fit under ``(1 + slack) * mean``, and the rest goes on clockwise. Once rounds place little, a shard
takes askers as long as it is below the bound, so a round that leaves cells over fills a shard: the rounds end, and no
shard ends above the bound by more than one cell. Cells that are all larger than the bound go that way from the first round. The few cells that overflow move, all others stay with the owner that plain consistent hashing gives them.
A row's slot is the number of rows in earlier cells of its shard plus its place within its cell.

Only DataFrame functions are used. Defined cases: an empty table gives no rows; a null text has size ``ROW_BYTES``
and the CRC of no bytes; equal, repeated and null ids are spread like others, and repeated rows get slots of their own
(rows that tie completely are interchangeable); other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veraframe.llm.common import materialise

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VIRTUAL_NODES = 256
SLACK = 0.0
ROW_BYTES = 16
TIE_ROWS = 32


def cell_of(*columns) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - CELL_BITS).cast("int")


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(at, shard): the virtual nodes' cells; of nodes in one cell the one with the smallest hash stays."""
    nodes = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    nodes = nodes.select("shard", cell_of(F.lit("node"), "shard", "copy").alias("at"), F.xxhash64("shard", "copy").alias("order"))
    return nodes.groupBy("at").agg(F.min_by("shard", "order").alias("shard"))


def clockwise(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """``cells`` (cell, from) with the node at or after ``from``: to (its cell, counted on past a full turn) and shard.

    Both tables have at most ``CELLS`` rows (nodes are laid out twice to close the ring).
    """
    laid = nodes.select("at", "shard").unionByName(nodes.select((F.col("at") + CELLS).alias("at"), "shard"))
    # A node covers the cells after its predecessor: its arc is spelled out, so that cells meet it in an equi-join.
    arcs = laid.withColumn("before", F.coalesce(F.lag("at").over(Window.orderBy("at")), F.lit(-1)))
    spelled = arcs.select("shard", F.col("at").alias("to"), F.explode(F.sequence(F.col("before") + 1, F.col("at"))).alias("from"))
    return cells.join(spelled.filter(F.col("from") < CELLS), "from")


def place(loads: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """(cell, load, n, shard, turns) for ``loads`` (cell, load, n); turns counts how often the cell went on clockwise.

    While turns still place much, a shard takes only what fits under the bound; then what is left may pass it by a cell.
    """
    spark = loads.sparkSession
    total, left, least = loads.agg(F.coalesce(F.sum("load"), F.lit(0)), F.count(F.lit(1)), F.min("load")).first()
    bound = -(-total * (1 + slack) // shards)
    nodes = materialise(ring(spark, shards, virtual_nodes), "ring")
    room = {s: bound for s in range(shards)}  # one number a shard
    asking, placed, fits = loads.withColumn("from", F.col("cell")), [], left > 0 and bound >= least
    for turn in range(4 * shards):
        if not left:
            break
        room_of = F.element_at(F.create_map(*[F.lit(x) for s, r in room.items() if r >= (least if fits else 1) for x in (s, float(r))]), F.col("shard"))
        # Nodes of full shards leave the ring.
        asked = clockwise(asking, nodes.filter(room_of.isNotNull())).withColumn("room", room_of)
        asked = asked.withColumn("counts", F.col("load") <= F.col("room") if fits else F.lit(True))
        by_size = Window.partitionBy("shard").orderBy(F.col("load").desc(), "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.sum(F.when(F.col("counts"), F.col("load")).otherwise(0)).over(by_size)
        taken = F.col("counts") & (upto <= F.col("room") if fits else upto - F.col("load") < F.col("room"))
        asked = materialise(asked.withColumn("taken", taken), "ring-turn")
        placed.append(asked.filter("taken").select("cell", "load", "n", "shard", F.lit(turn).alias("turns")))
        sums = asked.filter("taken").groupBy("shard").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n")).collect()  # a row a shard at most
        for r in sums:
            room[r.shard] -= r.load
        now = sum(r.n for r in sums)
        fits = fits and 10 * now > left
        left -= now
        asking = asked.filter("not taken").select("cell", "load", "n", ((F.col("to") + 1) % CELLS).alias("from"))
        least = asking.agg(F.min("load")).first()[0]
        fits = fits and left > 0 and max(room.values()) >= least
    if left:
        raise RuntimeError(f"{left} cells were not placed on the ring")
    return reduce(DataFrame.unionByName, placed) if placed else loads.withColumns({"shard": F.lit(0), "turns": F.lit(0)})


def with_cells(rows: DataFrame) -> DataFrame:
    """``rows`` (written: doc_id, size, text_crc32) with their cells."""
    tie = ["doc_id", "size", "text_crc32"]
    part = F.spark_partition_id()
    counts = rows.groupBy(*tie).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TIE_ROWS)
    hot = materialise(counts.select(*[F.col(c).alias(f"hot_{c}") for c in tie]), "ring-ties")  # a row for at least TIE_ROWS rows
    if hot.isEmpty():
        return rows.withColumn("cell", cell_of(F.lit("key"), *tie))
    of_tie = lambda df, names: reduce(lambda x, y: x & y, [df[c].eqNullSafe(hot[h]) for c, h in zip(names, hot.columns, strict=True)])
    calm = rows.join(hot, of_tie(rows, tie), "left_anti").withColumn("cell", cell_of(F.lit("key"), *tie))
    many = rows.join(hot, of_tie(rows, tie), "left_semi").withColumn("part", part)
    many = materialise(many, "ring-tied")
    # Numbered within a tie and partition, after the rows of earlier partitions: which row gets a number does not matter.
    earlier = Window.partitionBy(*tie).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = many.groupBy(*tie, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"o_{c}") for c in [*tie, "part"]], "offset")
    nth = F.row_number().over(Window.partitionBy(*tie, "part").orderBy("part")) - 1
    placed = many.withColumn("nth", nth)
    placed = placed.join(offsets, reduce(lambda x, y: x & y, [placed[c].eqNullSafe(offsets[f"o_{c}"]) for c in [*tie, "part"]]))
    salt = F.floor((F.col("nth") + F.col("offset")) / TIE_ROWS)
    return calm.unionByName(placed.withColumn("cell", cell_of(F.lit("key"), *tie, salt)).select(*calm.columns))


def ring_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and turns of every row."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    rows = materialise(with_cells(materialise(rows, "ring-rows")), "ring-cells")
    placed = place(rows.groupBy("cell").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")), shards, virtual_nodes, slack)
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = materialise(placed.select("cell", "shard", "turns", earlier.alias("offset")), "ring-placed")
    in_cell = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "size", "text_crc32")) - 1
    # At most CELLS rows, whatever the input, so this side is always small.
    return rows.withColumn("place", in_cell).join(F.broadcast(placed), "cell").select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("slot"), "turns")


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ring_shards(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "turns")
