"""Exact set algebra over keys and over (party, key) memberships, and deterministic generators of key sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symdiff.functions.hashing import portable
from symdiff.plans.tables import settled


def key_set(df: DataFrame, column: str = "key") -> DataFrame:
    """The distinct non-null keys: sketches XOR keys, so a key must be there once."""
    return df.select(F.col(column).cast("long").alias("key")).where("key is not null").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "key", "left_anti").distinct()


def sided_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, key) of the symmetric difference, in one shuffle of both sets."""
    both = a.select("key", F.lit(1).alias("s")).unionByName(b.select("key", F.lit(2).alias("s")))
    sides = both.groupBy("key").agg(F.bit_or("s").alias("s")).where("s < 3")
    return sides.select(F.when(F.col("s") == 1, "A").otherwise("B").alias("side"), "key")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return sided_difference(a, b).select("key")


def union_of_parties(memberships: DataFrame) -> DataFrame:
    return memberships.select("key").distinct()


def multiplicities(memberships: DataFrame) -> DataFrame:
    """(key, n): how many parties have it."""
    return memberships.groupBy("key").agg(F.countDistinct("party").alias("n"))


def in_all(memberships: DataFrame, parties: int) -> DataFrame:
    return multiplicities(memberships).where(F.col("n") == parties).select("key")


def union_minus_intersection(memberships: DataFrame, parties: int) -> DataFrame:
    """(key, n) of the keys that some but not all parties have."""
    return multiplicities(memberships).where(F.col("n") < parties)


def parties_of(memberships: DataFrame) -> DataFrame:
    """(key, parties): sorted lists."""
    return memberships.groupBy("key").agg(F.array_sort(F.collect_set("party")).alias("parties"))


def partial_parties(memberships: DataFrame, parties: int) -> DataFrame:
    """parties_of the keys that not all parties have."""
    return parties_of(memberships).where(F.size("parties") < parties)


def by_party(lists: DataFrame) -> DataFrame:
    """(party, key) from (key, parties)."""
    return lists.select(F.explode("parties").alias("party"), "key")


def chance(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) for the parts, whatever the partitioning."""
    return portable(F.concat_ws("/", *(p.cast("string") for p in parts)), seed) / F.lit(float(1 << 60))


def assign(keys: DataFrame, parties: int, probability: float, seed: int = 0) -> DataFrame:
    """(party, key): each party has each key with the probability."""
    every = keys.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parties - 1).cast("long"))).alias("party"))
    return every.where(chance(seed, F.col("key"), F.col("party")) < probability).select("party", "key")


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with the rank from 0 of each row in its group, whatever the groups' sizes: rows are dealt by range, so that a large group
    is spread, ranked within their part, and moved on by the number of the group's rows in the parts before."""
    parts = settled(df.repartitionByRange(*groups, *order).withColumn("part", F.spark_partition_id()))
    held = parts.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*groups, "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy(*groups, "part").orderBy(*order))
    return parts.withColumn("own", own).join(offsets, [*groups, "part"]).withColumn(name, (F.col("offset") + F.col("own") - 1).cast("long")).drop("part", "own", "offset")


def shared_and_distinct(numbered: DataFrame, shared: int, distinct: int, parties: int) -> DataFrame:
    """(party, key) from numbered keys (number, key), from 0 on: the first `shared` belong to all, the next ones to one
    party each, `distinct` to each."""
    n = F.col("number")
    own = numbered.where((n >= shared) & (n < shared + distinct * parties))
    every = numbered.where(n < shared).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parties - 1).cast("long"))).alias("party"), "key")
    return every.unionByName(own.select(F.floor((n - shared) / distinct).cast("long").alias("party"), "key"))


def key_to_node(numbered: DataFrame) -> DataFrame:
    """(party, key): key number i belongs to node i."""
    return numbered.select(F.col("number").alias("party"), "key")


def distinct_keys(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n distinct keys: numbers through an invertible mix of 62 bits."""
    mask = (1 << 31) - 1
    left, right = F.shiftright("id", 31), F.col("id").bitwiseAND(F.lit(mask))
    for k in range(4):  # a Feistel network is a permutation
        left, right = right, left.bitwiseXOR(portable(right, seed + k).bitwiseAND(F.lit(mask)))
    return spark.range(n).select((left * (1 << 31) + right).alias("key"))


def random_text(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, byte) of a random text over the 63 letters, digits and the blank."""
    # Fixed value: the alphabet.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 "
    return spark.range(n).select(F.col("id").alias("pos"), F.substring(F.lit(letters), (portable(F.col("id"), seed) % len(letters) + 1).cast("int"), F.lit(1)).alias("byte"))
