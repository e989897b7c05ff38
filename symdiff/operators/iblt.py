"""Invertible Bloom lookup tables as DataFrames.

A table is sparse rows (groups..., sub, cell, key_sum, hash_sum, cnt); a missing cell is empty. Building is a linear map:
each key goes to one cell in each of `k` sub-tables, where keys and checksums are XORed and counts added. So adding,
subtracting and decoding are unions of signed rows under one aggregation, which Spark does partly before the shuffle;
the shuffled rows are bounded by the number of cells and tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import SEEDS, family, family_modulo, murmur64a_numpy
from symdiff.functions.unsigned import wrapping
from symdiff.plans.tables import settled

SUMS = ("key_sum", "hash_sum", "cnt")
#: Tables of up to so many cells are decoded in one task each, larger ones by rounds over the cluster.
LOCAL_CELLS = 1 << 20


@dataclass(frozen=True)
class Spec:
    """m cells (raised to a multiple of k, at least one each) in k sub-tables; keys of 8 bytes; a hash family."""

    m: int
    k: int = 4
    hash: str = "murmur"

    def __post_init__(self):
        if not 1 <= self.k < len(SEEDS):
            raise ValueError(f"k must be from 1 to {len(SEEDS) - 1}")
        object.__setattr__(self, "m", max(1, -(-self.m // self.k)) * self.k)

    @property
    def per_sub(self) -> int:
        return self.m // self.k

    def size_in_bits(self, key_bits: int = 64, hash_bits: int = 64, count_bits: int = 32) -> int:
        return self.m * (key_bits + hash_bits + count_bits)


def same_shape(a: Spec, b: Spec) -> None:
    if a != b:
        raise ValueError(f"tables differ in shape: {a} and {b}")


def cells_of(key: Column, spec: Spec) -> Column:
    h = family(spec.hash)
    return F.array(*(F.struct(F.lit(i).alias("sub"), family_modulo(spec.hash, h(key, i + 1), spec.per_sub).cast("int").alias("cell")) for i in range(spec.k)))


def summed(rows: DataFrame, *groups: str) -> DataFrame:
    """One row per cell, of rows that share cells; empty cells go."""
    total = rows.groupBy(*groups, "sub", "cell").agg(F.bit_xor("key_sum").alias("key_sum"), F.bit_xor("hash_sum").alias("hash_sum"), F.sum("cnt").cast("long").alias("cnt"))
    return total.where("key_sum <> 0 or hash_sum <> 0 or cnt <> 0")


def signed_rows(keys: DataFrame, spec: Spec, *groups: str) -> DataFrame:
    """The cell rows of keys (groups..., key, sign), not yet added up."""
    with wrapping(keys.sparkSession):
        check = family(spec.hash)(F.col("key"), 0)
        wide = keys.select(*groups, F.col("key").alias("key_sum"), check.alias("hash_sum"), F.col("sign").cast("long").alias("cnt"), F.explode(cells_of(F.col("key"), spec)).alias("at"))
        return wide.select(*groups, "at.sub", "at.cell", *SUMS)


def build(keys: DataFrame, spec: Spec, *groups: str) -> DataFrame:
    """The table of keys (groups..., key), or with a column `sign` of 1 for inserted and -1 for removed keys."""
    keys = keys if "sign" in keys.columns else keys.withColumn("sign", F.lit(1))
    return summed(signed_rows(keys, spec, *groups), *groups)


def negated(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cnt", -F.col("cnt"))


def add(a: DataFrame, b: DataFrame, *groups: str) -> DataFrame:
    return summed(a.unionByName(b), *groups)


def subtract(a: DataFrame, b: DataFrame, *groups: str) -> DataFrame:
    return add(a, negated(b), *groups)


def difference_table(a: DataFrame, b: DataFrame, spec: Spec) -> DataFrame:
    """subtract(build(a), build(b)) under one aggregation: one shuffle."""
    keys = a.select("key", F.lit(1).alias("sign")).unionByName(b.select("key", F.lit(-1).alias("sign")))
    return build(keys, spec)


def pure(cells: DataFrame, spec: Spec) -> DataFrame:
    """The cells that hold one key: a count of 1 or -1 and a checksum that fits."""
    with wrapping(cells.sparkSession):
        check = family(spec.hash)(F.col("key_sum"), 0)
        return cells.where((F.abs("cnt") == 1) & (check == F.col("hash_sum")))


def is_empty(cells: DataFrame) -> bool:
    return cells.isEmpty()


def to_wire(cells: DataFrame, *groups: str) -> DataFrame:
    """One row per table: parallel arrays in the order of cells."""
    rows = F.array_sort(F.collect_list(F.struct("sub", "cell", *SUMS)))
    one = cells.groupBy(*groups).agg(rows.alias("r"))
    return one.select(*groups, *(F.col(f"r.{c}").alias(c) for c in ("sub", "cell", *SUMS)))


def from_wire(wire: DataFrame, *groups: str) -> DataFrame:
    each = wire.select(*groups, F.explode(F.arrays_zip("sub", "cell", *SUMS)).alias("r"))
    return each.select(*groups, "r.*")


def wire_bits(key_bits: int = 64, hash_bits: int = 64, count_bits: int = 32) -> Column:
    return F.size("key_sum").cast("long") * (key_bits + hash_bits + count_bits)


# Decoding


def places(keys: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(position of each key in each sub-table, checksums) of unsigned keys; `murmur` tables only."""
    at = [i * spec.per_sub + (murmur64a_numpy(keys, SEEDS[i + 1]) % np.uint64(spec.per_sub)).astype(np.int64) for i in range(spec.k)]
    return np.array(at).reshape(spec.k, -1), murmur64a_numpy(keys, SEEDS[0])


def peeled(sub: np.ndarray, cell: np.ndarray, key: np.ndarray, check: np.ndarray, count: np.ndarray, spec: Spec) -> tuple[dict[int, int], bool]:
    """({key: sign}, whether nothing is left) of one table, in rounds over all its cells; `murmur` tables only."""
    keys, checks, counts = (np.zeros(spec.m, dtype=t) for t in (np.uint64, np.uint64, np.int64))
    at = sub.astype(np.int64) * spec.per_sub + cell
    keys[at], checks[at], counts[at] = key.astype(np.int64).view(np.uint64), check.astype(np.int64).view(np.uint64), count
    found: dict[int, int] = {}
    while True:
        hit = np.flatnonzero((np.abs(counts) == 1) & (murmur64a_numpy(keys, SEEDS[0]) == checks))
        new, first = np.unique(keys[hit], return_index=True)
        signs = counts[hit][first]
        fresh = np.array([int(k) not in found for k in new], dtype=bool)
        if not fresh.any():  # also ends the rounds if a false checksum match came back
            break
        new, signs = new[fresh], signs[fresh]
        found.update(zip(new.tolist(), signs.tolist(), strict=True))
        check_of = murmur64a_numpy(new, SEEDS[0])
        for i in range(spec.k):
            to = i * spec.per_sub + (murmur64a_numpy(new, SEEDS[i + 1]) % np.uint64(spec.per_sub)).astype(np.int64)
            np.bitwise_xor.at(keys, to, new)
            np.bitwise_xor.at(checks, to, check_of)
            np.subtract.at(counts, to, signs)
    return found, not (keys.any() or checks.any() or counts.any())


def peel_each(cells: DataFrame, spec: Spec, group: str) -> DataFrame:
    """(group, key, sign, ok) of many tables, each decoded in one task: the rows of a table are bounded by its cells.
    A table that gave no key still gives a row, with a null key."""
    kind = dict(cells.dtypes)[group]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        found, ok = peeled(*(rows[c].to_numpy() for c in ("sub", "cell", *SUMS)), spec)
        signed = np.array(list(found), dtype=np.uint64).view(np.int64).tolist() or [None]
        out = pd.DataFrame({group: rows[group].iloc[0], "key": pd.array(signed, dtype="Int64"), "sign": pd.array(list(found.values()) or [None], dtype="Int64")})
        return out.assign(ok=ok)

    return cells.select(group, "sub", "cell", *SUMS).groupBy(group).applyInPandas(work, f"{group} {kind}, key long, sign long, ok boolean")


def peel_rounds(cells: DataFrame, spec: Spec) -> tuple[DataFrame, bool]:
    """((key, sign), whether nothing is left) of one large table, in rounds over the cluster: every round takes all pure
    cells, subtracts their keys and adds up again. A round without new keys ends it."""
    cells = settled(cells)
    found = None
    while True:
        new = pure(cells, spec).select(F.col("key_sum").alias("key"), F.col("cnt").alias("sign")).groupBy("key").agg(F.min("sign").alias("sign"))
        new = settled(new if found is None else new.join(found, "key", "left_anti"))
        if new.isEmpty():
            return (new if found is None else found), cells.isEmpty()
        found = settled(new if found is None else found.unionByName(new))
        rows = signed_rows(new.select("key", (-F.col("sign")).alias("sign")), spec)
        cells = settled(summed(cells.unionByName(rows)))


def decode(cells: DataFrame, spec: Spec) -> tuple[DataFrame, bool]:
    """((side, key), complete) of a difference table; side A for inserted keys, B for removed ones."""
    if spec.m <= LOCAL_CELLS and spec.hash == "murmur":
        rows = settled(peel_each(cells.withColumn("one", F.lit(1)), spec, "one"))
        keys, ok = rows.where("key is not null").select("key", "sign"), rows.where("not ok").isEmpty()
    else:
        keys, ok = peel_rounds(cells, spec)
    return keys.select(F.when(F.col("sign") > 0, "A").otherwise("B").alias("side"), "key"), ok
