"""Invertible lookup tables for n parties: sums of key and checksum bits modulo n (or a prime).

Rows are (groups..., sub, cell, kind, nit, v): `kind` is 'key', 'hash' or 'count', `nit` a bit's number, `v` the sum of
the coefficients of the keys in the cell that have the bit, modulo the field's size; zeros are left out. Adding the
tables of all n parties cancels the keys that all of them have.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.functions.hashing import SEEDS, family, low_bits, murmur64a_numpy
from symdiff.functions.unsigned import wrapping
from symdiff.operators import iblt
from symdiff.plans.tables import settled

HASH_BITS = 32


def set_bits(value: Column, bits: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(value, i) == 1)


def nits_of(key: Column, check: Column, key_bits: int) -> Column:
    named = lambda kind, bits: F.transform(bits, lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("nit")))
    return F.concat(named("key", set_bits(key, key_bits)), named("hash", set_bits(check, HASH_BITS)), F.array(F.struct(F.lit("count").alias("kind"), F.lit(0).alias("nit"))))


def summed(rows: DataFrame, modulus: int, *groups: str) -> DataFrame:
    total = rows.groupBy(*groups, "sub", "cell", "kind", "nit").agg(F.sum("v").alias("v"))
    return total.withColumn("v", F.pmod("v", F.lit(modulus))).where("v <> 0")


def build(memberships: DataFrame, spec: iblt.Spec, modulus: int, key_bits: int = 32, *groups: str) -> DataFrame:
    """The sum of the tables of memberships (groups..., key) or (groups..., key, coefficient)."""
    if "coefficient" not in memberships.columns:
        memberships = memberships.withColumn("coefficient", F.lit(1).cast("long"))
    with wrapping(memberships.sparkSession):
        check = low_bits(family(spec.hash)(F.col("key"), 0), HASH_BITS)
        placed = memberships.select(*groups, "key", check.alias("check"), F.col("coefficient").alias("v"), F.explode(iblt.cells_of(F.col("key"), spec)).alias("at"))
        rows = placed.select(*groups, "at.sub", "at.cell", "v", F.explode(nits_of(F.col("key"), F.col("check"), key_bits)).alias("n"))
        return summed(rows.select(*groups, "sub", "cell", "n.kind", "n.nit", "v"), modulus, *groups)


def add(a: DataFrame, b: DataFrame, modulus: int, *groups: str) -> DataFrame:
    return summed(a.unionByName(b), modulus, *groups)


def scale(table: DataFrame, factor: int, modulus: int) -> DataFrame:
    return table.withColumn("v", F.pmod(F.col("v") * factor, F.lit(modulus))).where("v <> 0")


def subtract(a: DataFrame, b: DataFrame, modulus: int, *groups: str) -> DataFrame:
    return add(a, scale(b, modulus - 1, modulus), modulus, *groups)


def divisible(table: DataFrame, *groups: str) -> DataFrame:
    """(groups..., sub, cell, key, check, c) of the cells all of whose sums are 0 or the count c: they may hold one key."""
    of = lambda kind: F.coalesce(F.bit_or(F.when(F.col("kind") == kind, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("nit")))), F.lit(0).cast("long"))
    cells = table.groupBy(*groups, "sub", "cell").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.when(F.col("kind") == "count", F.col("v"))).alias("c"), of("key").alias("key"), of("hash").alias("check")
    )
    return cells.where("c is not null and low = c and high = c").drop("low", "high")


def pure(table: DataFrame, spec: iblt.Spec, *groups: str) -> DataFrame:
    with wrapping(table.sparkSession):
        return divisible(table, *groups).where(low_bits(family(spec.hash)(F.col("key"), 0), HASH_BITS) == F.col("check"))


def party_bits(memberships: DataFrame, spec: iblt.Spec) -> DataFrame:
    """(sub, cell, party_bits): each cell's parties, a bit per party, XORed over its keys."""
    with wrapping(memberships.sparkSession):
        placed = memberships.select(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("party").cast("int")).alias("bit"), F.explode(iblt.cells_of(F.col("key"), spec)).alias("at"))
        return placed.groupBy("at.sub", "at.cell").agg(F.bit_xor("bit").alias("party_bits"))


def at_party(bits: Column, party: int) -> Column:
    """A single bucket's bit 0 as the bit of a party."""
    return F.shiftleft(bits.bitwiseAND(F.lit(1)), party)


def to_wire(table: DataFrame, *groups: str) -> DataFrame:
    """One row per table: its sums in the order of cells."""
    rows = F.array_sort(F.collect_list(F.struct("sub", "cell", "kind", "nit", "v")))
    return table.groupBy(*groups).agg(rows.alias("sums"))


def from_wire(wire: DataFrame, *groups: str) -> DataFrame:
    return wire.select(*groups, F.explode("sums").alias("s")).select(*groups, "s.*")


def extended_to_wire(bits: DataFrame, parties: int) -> DataFrame:
    """(sub, cell, has_key ARRAY<BOOLEAN>) of party_bits: an entry for each party."""
    return bits.select("sub", "cell", F.transform(F.sequence(F.lit(0), F.lit(parties - 1)), lambda i: F.getbit("party_bits", i) == 1).alias("has_key"))


def extended_from_wire(wire: DataFrame) -> DataFrame:
    power = lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    return wire.select("sub", "cell", F.aggregate(F.transform("has_key", power), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("party_bits"))


def peeled(sub: np.ndarray, cell: np.ndarray, column: np.ndarray, v: np.ndarray, spec: iblt.Spec, modulus: int, key_bits: int) -> tuple[dict[int, int], bool]:
    """({key: coefficient}, whether nothing is left); column: a sum's place, count first, then key bits, then hash bits."""
    width = 1 + key_bits + HASH_BITS
    table = np.zeros((spec.m, width), dtype=np.int64)
    table[sub.astype(np.int64) * spec.per_sub + cell, column] = v
    weights = np.uint64(1) << np.arange(max(key_bits, HASH_BITS), dtype=np.uint64)
    found: dict[int, int] = {}
    while True:
        c = table[:, :1]
        hit = np.flatnonzero((c[:, 0] != 0) & ((table == 0) | (table == c)).all(axis=1))
        bits = (table[hit] != 0).astype(np.uint64)
        keys = (bits[:, 1 : 1 + key_bits] * weights[:key_bits]).sum(axis=1, dtype=np.uint64)
        checks = (bits[:, 1 + key_bits :] * weights[:HASH_BITS]).sum(axis=1, dtype=np.uint64)
        fits = (murmur64a_numpy(keys, SEEDS[0]) & np.uint64((1 << HASH_BITS) - 1)) == checks
        new, first = np.unique(keys[fits], return_index=True)
        rows = hit[fits][first]
        fresh = np.array([int(k) not in found for k in new], dtype=bool)
        if not fresh.any():
            return found, not table.any()
        new, values = new[fresh], table[rows[fresh]].copy()
        found.update(zip(new.tolist(), values[:, 0].tolist(), strict=True))
        for i in range(spec.k):
            to = i * spec.per_sub + (murmur64a_numpy(new, SEEDS[i + 1]) % np.uint64(spec.per_sub)).astype(np.int64)
            np.subtract.at(table, to, values)
        table %= modulus


def decode(table: DataFrame, spec: iblt.Spec, modulus: int, key_bits: int = 32, group: str | None = None) -> DataFrame:
    """(group, key, coefficient, ok): what each table holds; a task's rows are bounded by a table's cells."""
    group = group or "one"
    table = table if group in table.columns else table.withColumn(group, F.lit(0))
    kind = dict(table.dtypes)[group]
    at = F.when(F.col("kind") == "count", 0).when(F.col("kind") == "key", F.col("nit") + 1).otherwise(F.col("nit") + 1 + key_bits)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        found, ok = peeled(*(rows[c].to_numpy() for c in ("sub", "cell", "at", "v")), spec, modulus, key_bits)
        out = pd.DataFrame({group: rows[group].iloc[0], "key": pd.array(list(found) or [None], dtype="Int64"), "coefficient": pd.array(list(found.values()) or [None], dtype="Int64")})
        return out.assign(ok=ok)

    return table.select(group, "sub", "cell", at.alias("at"), "v").groupBy(group).applyInPandas(work, f"{group} {kind}, key long, coefficient long, ok boolean")


#: Cells of a segment's table at first: what one task decodes. Rows of 65 sums take 2 MB.
SEGMENT_CELLS = 1 << 12


def reconcile(memberships: DataFrame, modulus: int, cells: int, key_bits: int = 32) -> DataFrame:
    """(key, coefficient) of the keys whose coefficients don't cancel, through so many cells. Keys are dealt by a hash to segments with a table
    each, so that what a task decodes doesn't grow with the number of keys; segments that fail are made again with twice the cells."""
    segments = max(1, -(-cells // SEGMENT_CELLS))
    dealt = memberships.withColumn("segment", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(segments)).cast("int"))
    parts, each = [], -(-cells // segments)
    while True:
        spec = iblt.Spec(each, 4)
        found = settled(decode(build(dealt, spec, modulus, key_bits, "segment"), spec, modulus, key_bits, "segment"))
        parts.append(found.where("ok and key is not null").select("key", "coefficient"))
        failed = found.where("not ok").select("segment").distinct()
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        dealt, each = dealt.join(F.broadcast(failed), "segment", "left_semi"), 2 * each


LANE_BYTES = 4


def string_lanes(keys: DataFrame, spec: iblt.Spec, width: int) -> DataFrame:
    """(sub, cell, lane, v) of fixed-width byte strings (key BINARY of `width` bytes): XOR lane by lane of 4 bytes."""
    number = F.conv(F.substring(F.md5("key"), 1, 15), 16, 10).cast("long")
    lanes = F.array(*(F.struct(F.lit(i).alias("lane"), F.conv(F.hex(F.substring("key", i * LANE_BYTES + 1, LANE_BYTES)), 16, 10).cast("long").alias("v")) for i in range(width // LANE_BYTES)))
    with wrapping(keys.sparkSession):
        placed = keys.select(F.explode(iblt.cells_of(number, spec)).alias("at"), lanes.alias("lanes"))
        rows = placed.select("at.sub", "at.cell", F.explode("lanes").alias("l"))
        return rows.groupBy("sub", "cell", "l.lane").agg(F.bit_xor("l.v").alias("v"))
