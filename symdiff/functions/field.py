"""Arithmetic modulo n: residues as BIGINT columns, and vectors of residues (one per bit of a key) as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def residue(x: Column, n: int) -> Column:
    return F.pmod(x, F.lit(n))


def scaled(x: Column, factor: int | Column, n: int) -> Column:
    """For n up to 10^9 + 7, whose products stay within BIGINT."""
    return F.pmod(x * factor, F.lit(n))


def nits(key: Column, bits: int) -> Column:
    """A key's bits, from the lowest, as a vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(key, i).cast("long"))


def added(a: Column, b: Column, n: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(n)))


def removed(a: Column, b: Column, n: int) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(n)))


def multiplied(a: Column, factor: int | Column, n: int) -> Column:
    return F.transform(a, lambda x: F.pmod(x * factor, F.lit(n)))


def is_empty(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def holds_only(a: Column, c: Column) -> Column:
    """Whether every entry is 0 or c: what a multiple c of one key looks like."""
    return F.forall(a, lambda x: (x == 0) | (x == c))


def key_of(a: Column) -> Column:
    """The key whose bits are the entries that aren't 0."""
    bits = F.transform(a, lambda x, i: F.when(x != 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
