"""Digests and sketches of multisets of rows: they don't depend on the rows' order, and add up.

A row is known by 60 bits of a hash of its columns as text. A table's digest is its number of rows and two sums over them; a table's parts
add up to the whole's digest, and equal tables have equal ones. A sketch holds such sums by cell: count, sum of keys and
sum of checksums, each times how often the row occurs. A cell whose count divides both sums into a key and its checksum holds one row,
so the difference of two sketches gives back which rows one table has more often than the other, and by how much,
without a join of the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import portable
from symdiff.operators import iblt
from symdiff.plans.tables import settled

SUMS = ("cnt", "key_sum", "check_sum")
EXACT = "decimal(38,0)"
#: Cells of the least sketch, and how many times more the next one has if that isn't enough.
FIRST_CELLS, MORE = 1 << 10, 8
#: An estimate of how many rows differ counts those of one in so many keys, by a hash.
SHARE = 64
#: Keys and checksums have two halves of so many bits, whose sums are plain numbers for up to 2^33 rows.
HALF = 30


def row_key(*columns: str) -> Column:
    """60 bits of the columns as text, each with its length before it; null isn't the same as any text."""
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.conv(F.substring(F.md5(F.concat(*map(text, columns))), 1, 15), 16, 10).cast("long")


def digest(rows: DataFrame) -> DataFrame:
    """(n, first, second) of rows (key); second sums up another hash of the keys."""
    total = lambda c: F.coalesce(F.sum(c.cast(EXACT)), F.lit(0)).cast(EXACT)
    return rows.agg(F.count("key").alias("n"), total(F.col("key")).alias("first"), total(portable(F.col("key"), 0)).alias("second"))


def signed_rows(rows: DataFrame, spec: iblt.Spec) -> DataFrame:
    """The cell rows of rows (key, times), not yet added up."""
    check = portable(F.col("key"), 0)
    wide = rows.select(F.col("times").cast(EXACT).alias("cnt"), (F.col("key").cast(EXACT) * F.col("times")).cast(EXACT).alias("key_sum"), (check.cast(EXACT) * F.col("times")).cast(EXACT).alias("check_sum"), F.explode(iblt.cells_of(F.col("key"), spec)).alias("at"))
    return wide.select("at.sub", "at.cell", *SUMS)


def summed(rows: DataFrame) -> DataFrame:
    total = rows.groupBy("sub", "cell").agg(*(F.sum(c).cast(EXACT).alias(c) for c in SUMS))
    return total.where(" or ".join(f"{c} <> 0" for c in SUMS))


def build(rows: DataFrame, spec: iblt.Spec) -> DataFrame:
    """Of rows (key) or (key, times); a row may occur any number of times."""
    return summed(signed_rows(rows if "times" in rows.columns else rows.withColumn("times", F.lit(1)), spec))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return summed(a.unionByName(b))


def negated(cells: DataFrame) -> DataFrame:
    return cells.withColumns({c: -F.col(c) for c in SUMS})


def pure(cells: DataFrame) -> DataFrame:
    """(key, times) of the cells that hold one row."""
    divides = cells.where("cnt <> 0 and key_sum % cnt = 0 and check_sum % cnt = 0").withColumn("key", F.expr("key_sum div cnt"))
    return divides.where((F.col("key") >= 0) & (portable(F.col("key"), 0) == F.expr("check_sum div cnt"))).select("key", F.col("cnt").cast("long").alias("times"))


def peel(cells: DataFrame, spec: iblt.Spec) -> tuple[DataFrame, bool]:
    """((key, times), whether nothing is left), in rounds over the cluster."""
    cells, parts = settled(cells), []
    while True:
        new = pure(cells).groupBy("key").agg(F.max("times").alias("times"))
        for before in parts:
            new = new.join(before, "key", "left_anti")
        new = settled(new)
        if new.isEmpty():
            return reduce(DataFrame.unionByName, parts, new), cells.isEmpty()
        parts.append(new)
        cells = settled(summed(cells.unionByName(signed_rows(new.withColumn("times", -F.col("times")), spec))))


def counted(rows: DataFrame, spec: iblt.Spec) -> DataFrame:
    """build() of rows (key, times) whose times are 1 or -1: halves of keys and checksums are added up as long numbers, and put together at the end."""
    half = lambda x: (F.shiftright(x, HALF), x.bitwiseAND(F.lit((1 << HALF) - 1)))
    times, names = F.col("times").cast("long"), ("key_high", "key_low", "check_high", "check_low")
    keyed = rows.select("key", times.alias("times"), portable(F.col("key"), 0).alias("check"), F.explode(iblt.cells_of(F.col("key"), spec)).alias("at"))
    parts = [(x * times).alias(n) for n, x in zip(names, (*half(F.col("key")), *half(F.col("check"))), strict=True)]
    total = keyed.select("at.sub", "at.cell", times.alias("cnt"), *parts).groupBy("sub", "cell").agg(*(F.sum(c).alias(c) for c in ("cnt", *names)))
    joined = lambda c: (F.col(f"{c}_high").cast("decimal(20,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + F.col(f"{c}_low").cast("decimal(20,0)")).cast(EXACT).alias(f"{c}_sum")
    return total.select("sub", "cell", F.col("cnt").cast(EXACT).alias("cnt"), joined("key"), joined("check")).where(" or ".join(f"{c} <> 0" for c in SUMS))


def cells_for(signed: DataFrame) -> int:
    """Cells for the keys of (key, times) whose times don't add up to 0, by an exact count of those in a SHARE-th of all hashes."""
    some = signed.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(SHARE)) == 0)
    n = some.groupBy("key").agg(F.sum("times").alias("times")).where("times <> 0").count()
    return max(FIRST_CELLS, int(2 * SHARE * (n + 2 * n**0.5)))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, times): how much more often (less, if negative) a has a row than b, for rows (key) of both, by a sketch sized by an estimate; one that
    fails is made again with MORE times the cells."""
    signed = settled(a.select("key", F.lit(1).alias("times")).unionByName(b.select("key", F.lit(-1).alias("times"))).where("key is not null"))
    cells = cells_for(signed)
    while True:
        spec = iblt.Spec(cells, 4, "portable")
        found, complete = peel(counted(signed, spec), spec)
        if complete:
            return found
        cells *= MORE
