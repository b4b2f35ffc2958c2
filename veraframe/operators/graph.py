"""Connected components by hooking to smaller neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.sources.shared import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Null ends are ignored.

    In a round every node hooks to its smallest neighbour if that is smaller than itself, and pointer jumping takes all
    nodes to the roots of the trees that this makes, in the logarithm of their depth. Edges are renamed by roots, and
    loops and repeats drop out, so the next round has at most half of the nodes. Rounds' maps, which shrink as well, are
    put together at the end. A node's neighbours meet only in partial aggregates, so a hub does no harm.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = materialise(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    maps = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).union(left.select("b", "a"))
        up = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")), "graph-parents")
        while True:
            of_root = up.select(F.col("node").alias("root"), F.col("root").alias("then"))
            jumped = materialise(up.join(of_root, "root").select("node", F.col("root").alias("was"), F.col("then").alias("root")), "graph-parents")
            up = jumped.select("node", "root")
            if jumped.filter("was <> root").isEmpty():
                break
        maps.append(up)
        of = lambda x: up.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: E731, B023
        renamed = left.join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b")
        left = materialise(renamed.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "graph-edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        last = out.select(F.col("node").alias("root"), F.col("root").alias("then"))
        out = earlier.join(last, "root", "left").select("node", F.coalesce("then", "root").alias("root"))
    return materialise(out.select("node", F.col("root").alias("component")), "graph-labels")
