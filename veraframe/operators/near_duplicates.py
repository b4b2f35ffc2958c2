"""Near duplicates by Hamming distance of 64-bit hashes, and leader groups in input order."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veraframe.sources.shared import materialise


def hash_classes(hashes: DataFrame, key: str, bits: str) -> DataFrame:
    """(h, rep): every distinct hash with its smallest key."""
    return hashes.groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("rep"))


def class_pairs(classes: DataFrame, most: int = 5, together: int = 3) -> DataFrame:
    """(a, b, distance) for representatives whose 64-bit hashes differ in at most ``most`` bits, a < b.

    The 64 bits are cut into ``most + together`` bands. Hashes that differ in at most ``most`` bits agree in ``together``
    bands at least, so equi-joins by every choice of so many bands lose nothing. With 3 of 8 bands a key has 24 bits, and
    two unrelated hashes seldom meet.
    """
    bands = most + together
    width = [64 // bands + (i < 64 % bands) for i in range(bands)]
    starts = [sum(width[:i]) for i in range(bands)]
    part = [F.shiftrightunsigned(F.col("h"), s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, width, strict=True)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(bands), together)):
        value = F.lit(n).cast("long")
        for i in chosen:
            value = F.shiftleft(value, width[i]).bitwiseOR(part[i])
        keys.append(value)
    banded = materialise(classes.select("h", "rep", F.explode(F.array(*keys)).alias("part")), "hamming-bands")
    other = banded.select(F.col("h").alias("h2"), F.col("rep").alias("rep2"), "part")
    distance = F.bit_count(F.col("h").bitwiseXOR(F.col("h2")))
    near = banded.join(other, "part").filter((F.col("rep") < F.col("rep2")) & (distance <= most))
    return near.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), distance.alias("distance")).distinct()


def hamming_pairs(hashes: DataFrame, key: str, bits: str, most: int = 5) -> DataFrame:
    """(a, b, distance) of class representatives within ``most`` bits, and of every other key with its representative."""
    classes = materialise(hash_classes(hashes, key, bits), "hamming-classes")
    copies = hashes.select(F.col(key).alias("b"), F.col(bits).alias("h")).join(classes, "h").filter(F.col("b") != F.col("rep"))
    return class_pairs(classes, most).unionByName(copies.select(F.col("rep").alias("a"), "b", F.lit(0).alias("distance")))


def hamming_groups(hashes: DataFrame, key: str, bits: str, most: int = 5) -> DataFrame:
    """(key, leader) of every key that is in a group of two or more.

    In the order of keys, a key that has no leader yet leads all later ones without a leader within ``most`` bits. Copies
    of a hash go where its first key goes: what leads that one is as near to them and comes before them.
    """
    classes = materialise(hash_classes(hashes, key, bits), "hamming-classes")
    leaders = leader_groups(class_pairs(classes, most))
    of_class = classes.join(leaders, F.col("rep") == F.col("key"), "left").select("h", F.coalesce("leader", "rep").alias("leader"))
    out = materialise(hashes.select(F.col(key).alias("key"), F.col(bits).alias("h")).join(of_class, "h").select("key", "leader"), "hamming-groups")
    several = out.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("leader")
    return out.join(several, "leader", "left_semi").select("key", "leader")


def leader_groups(pairs: DataFrame) -> DataFrame:
    """(key, leader): in the order of keys, a key joins its smallest earlier leader, or else becomes one.

    In a round, keys without undecided or leading earlier neighbours become leaders, and neighbours of leaders whose
    earlier neighbours are all decided join them.
    """
    edges = materialise(pairs.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct(), "leader-edges")
    keys = edges.select(F.col("early").alias("key")).union(edges.select("late")).distinct()
    state = materialise(keys.withColumn("leader", F.lit(None).cast(dict(keys.dtypes)["key"])), "leader-state")
    while not state.filter("leader IS NULL").isEmpty():
        early = edges.join(state.select(F.col("key").alias("early"), F.col("leader").alias("early_leader")), "early")
        seen = early.groupBy(F.col("late").alias("key")).agg(
            F.count_if(F.col("early_leader").isNull()).alias("open"),
            F.min(F.when(F.col("early_leader") == F.col("early"), F.col("early"))).alias("first"),
        )
        joined = state.join(seen, "key", "left")
        decided = F.when(F.col("leader").isNull() & (F.coalesce("open", F.lit(0)) == 0), F.coalesce("first", "key")).otherwise(F.col("leader"))
        state = materialise(joined.select("key", decided.alias("leader")), "leader-state")
    return state
