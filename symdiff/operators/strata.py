"""Strata estimator of the size of a symmetric difference: one small table per number of trailing zeroes of a key's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import murmur64a, murmur64a_binary, trailing_zeroes
from symdiff.functions.unsigned import wrapping
from symdiff.operators import iblt
from symdiff.plans.tables import settled

# The shape of each stratum's table.
STRATUM = iblt.Spec(80, 4)
STRATA = 64
#: Keys up to which a theta sketch of Spark's default size is exact.
THETA_KEYS = 4096


def assigned(keys: DataFrame) -> DataFrame:
    """(stratum, key): the inserted key is the key's hash."""
    with wrapping(keys.sparkSession):
        hashed = keys.select(*(c for c in keys.columns if c != "key"), murmur64a(F.col("key")).alias("key"))
        return hashed.withColumn("stratum", F.least(trailing_zeroes(F.col("key"), STRATA), F.lit(STRATA - 1)))


def assigned_bytes(keys: DataFrame) -> DataFrame:
    """(stratum, key) of byte strings (key BINARY): the inserted key is the whole string's hash."""
    hashed = keys.select(*(c for c in keys.columns if c != "key"), murmur64a_binary("key").alias("key"))
    return hashed.withColumn("stratum", F.least(trailing_zeroes(F.col("key"), STRATA), F.lit(STRATA - 1)))


def to_wire(cells: DataFrame) -> DataFrame:
    """One row: an estimator as the list of its strata's tables."""
    return iblt.to_wire(cells, "stratum").agg(F.array_sort(F.collect_list(F.struct("stratum", "sub", "cell", *iblt.SUMS))).alias("strata"))


def from_wire(wire: DataFrame) -> DataFrame:
    return iblt.from_wire(wire.select(F.explode("strata").alias("s")).select("s.*"), "stratum")


def build(keys: DataFrame) -> DataFrame:
    """Of keys (key) or (key, sign): the cells of all strata."""
    return iblt.build(assigned(keys), STRATUM, "stratum")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return iblt.add(a, b, "stratum")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return iblt.subtract(a, b, "stratum")


def size_in_bits() -> int:
    return STRATA * STRATUM.size_in_bits()


def estimate_difference(difference: DataFrame) -> int:
    """From a subtracted estimator: strata are decoded each by itself (at most 64 small groups); from the top one down,
    the first that fails scales what was decoded above it."""
    peeled = iblt.peel_each(difference, STRATUM, "stratum").groupBy("stratum").agg(F.min("ok").alias("ok"), F.count("key").alias("n"))
    rows = {r.stratum: r for r in peeled.collect()}
    total = 0
    for i in range(STRATA - 1, -1, -1):
        if i in rows:
            if not rows[i].ok:
                return (1 << (i + 1)) * total
            total += rows[i].n
    return total


def estimate(a: DataFrame, b: DataFrame) -> int:
    """Of |A without B| + |B without A| for key sets, of numbers or byte strings, under one aggregation."""
    keys = a.select("key", F.lit(1).alias("sign")).unionByName(b.select("key", F.lit(-1).alias("sign")))
    return estimate_difference(iblt.build(assigned_bytes(keys), STRATUM, "stratum") if dict(keys.dtypes)["key"] == "binary" else build(keys))


def theta_difference(a: DataFrame, b: DataFrame, parts: int | None = None) -> DataFrame:
    """(n): the same number from theta sketches, which can't give the keys back. A sketch is exact up to THETA_KEYS keys, so keys are dealt by a
    hash to `parts` pairs of sketches (by default, as many as the number of keys asks for), and to twice as many if one gets more."""
    both = settled(a.select("key", F.lit(1).alias("side")).unionByName(b.select("key", F.lit(2).alias("side"))).where("key is not null").distinct())
    parts = parts or 1 + 2 * both.count() // THETA_KEYS
    while True:
        own = lambda side: F.when(F.col("side") == side, F.col("key"))
        sized = [F.count(own(s)).alias(f"n{s}") for s in (1, 2)]
        sketches = [F.theta_sketch_agg(own(s)).alias(f"s{s}") for s in (1, 2)]
        pairs = settled(both.groupBy(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(parts)).alias("part")).agg(*sized, *sketches))
        if pairs.where(F.greatest("n1", "n2") > THETA_KEYS).isEmpty():
            break
        parts *= 2
    only = lambda x, y: F.theta_sketch_estimate(F.theta_difference(x, y))
    return pairs.select((only("s1", "s2") + only("s2", "s1")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
