"""Running sums over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veraframe.sources.shared import materialise


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with inclusive running sums in the order, anew for each group of ``by``.

    Rows are range-partitioned by group and order, so that a large group lies in several partitions. Sums run within
    partitions and get the totals of the same group's partitions before, of which there is one row a partition and group.
    ``order`` should be total; rows that tie are summed in any order.
    """
    values = df.withColumns({f"__{k}": v for k, v in sums.items()})
    parts = materialise(values.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id()), "ordered")
    upto = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part", *by).agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    offsets = totals.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__by_{c}") for c in by], *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}_before") for k in sums])
    here = F.col("__part") == F.col("__of")
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    offsets = offsets if by else F.broadcast(offsets)  # one row a partition
    out = parts.join(offsets, here).withColumns({k: F.sum(f"__{k}").over(upto) + F.col(f"__{k}_before") for k in sums})
    return out.drop("__part", "__of", *[f"__by_{c}" for c in by], *[f"__{k}" for k in sums], *[f"__{k}_before" for k in sums])


def percentiles(df: DataFrame, value: str, at: dict[str, float], by: list[str] = [], nearest: bool = False) -> DataFrame:  # noqa: B006
    """A row per group with the exact percentiles ``at`` (name: fraction) of non-null values, and n.

    They are interpolated between the two nearest ranks, or, with ``nearest``, the value at the rank rounded half to
    even. Values are counted, and the counts summed up in order over the cluster, so no group is gathered anywhere.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = running(counts, [F.col("__v")], {"__upto": F.col("__c")}, by)
    sizes = counts.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.sum("__c").alias("n"))
    here = F.lit(True)
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    rows = upto.join(sizes if by else F.broadcast(sizes), here)
    covers = lambda rank: (F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto"))
    aggs, out = [F.max("n").alias("n")], {}
    for name, q in at.items():
        place = F.lit(q) * (F.col("n") - 1)
        ranks = {"r": F.bround(place)} if nearest else {"l": F.floor(place), "h": F.ceil(place)}
        aggs += [F.max(F.when(covers(rank), F.col("__v"))).alias(f"__{name}_{k}") for k, rank in ranks.items()]
        low, high = F.col(f"__{name}_l"), F.col(f"__{name}_h")
        out[name] = F.col(f"__{name}_r") if nearest else low + (high - low) * (place - F.floor(place))
    return rows.groupBy(*by).agg(*aggs).select(*by, "n", *[v.alias(k) for k, v in out.items()])
