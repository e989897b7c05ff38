"""What the training-data operators share: reading and writing tables, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.functions.arrow import BATCH_BYTES, BATCH_ROWS, in_small_batches, release, slices
from symdiff.plans.tables import settled, table

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Memory", "free_name", "in_small_batches", "release", "releasing", "slices", "spread_join", "table", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df as a table in the folder named by spark.checkpoint.dir, which all executors share. It cuts the lineage, survives
    lost executors, and later reads take the columns they need.

    Unlike a checkpoint's, its plan carries no constraints over from the one that made it; in loops of joins these grow
    until the driver's memory is full.
    """
    return settled(df, *parts)


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work (an Arrow function), giving memory back when it has ended and all that it held is gone: `slices` does so while its caller still
    holds what it remembers, which the worker would then keep through later stages."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


#: Keys up to this many are sent to every executor.
BROADCAST_KEYS = 500_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, block: int, heavy: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """rows joined with a table of one row for each key, where a key of many rows is dealt to a task for every `block` of them, each with a copy of
    the key's row in the table. heavy: (key, count) of keys of more than `block` rows, if they are known; by: the column that rows are dealt by,
    instead of all."""
    if heavy is None:
        heavy = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > block))
    n = heavy.count()
    if not n:
        return rows.join(table, key)
    parts = heavy.select(key, F.ceil(F.col("count") / block).cast("int").alias("parts_"))
    parts = F.broadcast(parts) if n <= BROADCAST_KEYS else parts
    dealt = rows.join(parts, key, "left").withColumn("part_", F.pmod(F.xxhash64(*([by] if by else rows.columns)), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    copies = table.join(parts, key, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return dealt.join(copies, [key, "part_"]).drop("part_")


class Memory:
    """What was computed for at most about `most` keys: `new` holds all keys asked for last; when it is half full, it
    becomes the old generation, of which only keys that are asked for again live on."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that have to be put into `new` now; the others are there."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        out = keys.difference(self.new)
        again = {k: self.old[k] for k in out if k in self.old}
        self.new.update(again)
        return out.difference(again)
