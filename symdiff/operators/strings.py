"""Two-party lookup tables whose keys are byte strings of one fixed width, decoded by rounds over the cluster.

A cell is one row (sub, cell, lanes..., check, cnt): the keys' bytes are XORed in lanes of LANE_BYTES, checksums and
counts are added up as in tables of numbers. So building is one aggregation, and subtracting a union of signed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import portable
from symdiff.operators import iblt, strata
from symdiff.plans.tables import settled

LANE_BYTES = 4
#: Small differences need more cells than twice their size.
LEAST_CELLS = 80


def number_of(key: Column) -> Column:
    """60 bits that name a byte string."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def lanes(width: int) -> list[str]:
    if width % LANE_BYTES:
        raise ValueError(f"the width must be a multiple of {LANE_BYTES}")
    return [f"lane{i}" for i in range(width // LANE_BYTES)]


def joined_lanes(width: int) -> Column:
    """The byte string in the lanes."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c), 2 * LANE_BYTES, "0") for c in lanes(width))))


def signed_rows(keys: DataFrame, spec: iblt.Spec, width: int) -> DataFrame:
    """The cell rows of keys (key BINARY, sign), not yet added up."""
    part = lambda i: F.conv(F.hex(F.substring("key", i * LANE_BYTES + 1, LANE_BYTES)), 16, 10).cast("long")
    named = keys.select(number_of(F.col("key")).alias("number"), F.col("sign").cast("long").alias("cnt"), *(part(i).alias(c) for i, c in enumerate(lanes(width))))
    at = F.array(*(F.struct(F.lit(i).alias("sub"), (portable(F.col("number"), i + 1) % spec.per_sub).cast("int").alias("cell")) for i in range(spec.k)))
    rows = named.select(*lanes(width), portable(F.col("number"), 0).alias("check"), "cnt", F.explode(at).alias("at"))
    return rows.select("at.sub", "at.cell", *lanes(width), "check", "cnt")


def summed(rows: DataFrame, width: int) -> DataFrame:
    xored = [*lanes(width), "check"]
    total = rows.groupBy("sub", "cell").agg(*(F.bit_xor(c).alias(c) for c in xored), F.sum("cnt").alias("cnt"))
    return total.where(" or ".join(f"{c} <> 0" for c in [*xored, "cnt"]))


def build(keys: DataFrame, spec: iblt.Spec, width: int) -> DataFrame:
    """Of distinct keys (key) or (key, sign)."""
    return summed(signed_rows(keys if "sign" in keys.columns else keys.withColumn("sign", F.lit(1)), spec, width), width)


def decode(cells: DataFrame, spec: iblt.Spec, width: int) -> tuple[DataFrame, bool]:
    """((key, sign), whether nothing is left): every round takes all cells of one key and subtracts these keys."""
    cells, found = settled(cells), None
    while True:
        one = cells.where("abs(cnt) = 1").select(joined_lanes(width).alias("key"), "check", F.col("cnt").alias("sign"))
        new = one.where(portable(number_of(F.col("key")), 0) == F.col("check")).groupBy("key").agg(F.min("sign").alias("sign"))
        new = settled(new if found is None else new.join(found, "key", "left_anti"))
        if new.isEmpty():
            return (new if found is None else found), cells.isEmpty()
        found = settled(new if found is None else found.unionByName(new))
        cells = settled(summed(cells.unionByName(signed_rows(new.withColumn("sign", -F.col("sign")), spec, width)), width))


def reconcile(a: DataFrame, b: DataFrame, width: int, cells: int | None = None) -> DataFrame:
    """(side, key) of two sets of strings, through a table sized by an estimate of their difference, or of so many cells; one that
    fails is made again with twice the cells."""
    cells = cells or max(2 * strata.estimate(a, b), LEAST_CELLS)
    keys = settled(a.select("key", F.lit(1).alias("sign")).unionByName(b.select("key", F.lit(-1).alias("sign"))))
    while True:
        spec = iblt.Spec(cells, 4)
        found, complete = decode(build(keys, spec, width), spec, width)
        if complete:
            return found.select(F.when(F.col("sign") > 0, "A").otherwise("B").alias("side"), "key")
        cells *= 2
