"""Unsigned 64-bit values in BIGINT columns: the bit pattern is kept, order, modulo and display are mapped.

Also `wrapping`: under ANSI mode a product of BIGINTs that overflows is an error; inside the context, expressions are
built with wrapping arithmetic. The mode is fixed when a DataFrame is made, so build it inside and use it anywhere. The
setting belongs to the session: don't build other plans of one session in other threads meanwhile.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@contextmanager
def wrapping(spark: SparkSession):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def signed(value: int) -> int:
    """The BIGINT with the bits of an unsigned value."""
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def order_key(c: Column) -> Column:
    """Sorts as the unsigned value does."""
    return c.bitwiseXOR(F.lit(signed(1 << 63)))


def modulo(c: Column, m: int) -> Column:
    """Of the unsigned value, for m below 2^62."""
    return ((F.shiftrightunsigned(c, 1) % m) * 2 + c.bitwiseAND(F.lit(1))) % m


def as_decimal(c: Column) -> Column:
    """The unsigned value as DECIMAL(20, 0)."""
    return F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
