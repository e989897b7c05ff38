"""Reconciling two streams of events window by window, with late events, a watermark and state.

Events of both sides go into one table of cells for each window, A's keys with 1 and B's with -1. A key counts once for each side and
window (duplicates are dropped while the window is open), late events are added until the watermark passes the
window's end, and then its cells go to a decoder: Spark adds cells up before and after the shuffle, so a window's decoder gets no more rows than
the table has cells, however many events the window has. The decoder keeps what it couldn't decode yet as state, one
value for each window, and goes on from there if more cells of the window come.

A window's keys may be dealt to several segments by a hash, each with a table and a decoder of its own, so that what a decoder holds doesn't
grow with the window. `all_differences` streams windows whose tables were too full again, with more segments, until all are decoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BinaryType, StructField, StructType

from symdiff.operators import codec, iblt

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a window that starts so many microseconds after 1970: a key that only one side has, or, with a null side and key,
#: whether all is decoded so far.
DECODED = "start long, side string, key long, complete boolean"


#: Segments are made so many times more if windows couldn't be decoded.
MORE = 4
#: Cells for each key that differs; four hashes need 1.3.
CELLS_PER_KEY = 1.5


def merged(cells: pd.DataFrame) -> pd.DataFrame:
    """One row per cell, in their order; empty ones go."""
    if cells.empty:
        return cells
    rows = cells.sort_values("at", kind="stable")
    at = rows["at"].to_numpy()
    first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
    sums = {c: f.reduceat(rows[c].to_numpy(), first) for c, f in zip(iblt.SUMS, (np.bitwise_xor, np.bitwise_xor, np.add), strict=True)}
    both = pd.DataFrame({"at": at[first], **sums})
    return both[(both[list(iblt.SUMS)] != 0).any(axis=1)]


class WindowDecoder(StatefulProcessor):
    """Peels a window's cells; what is left of them is its state."""

    def __init__(self, spec: iblt.Spec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", StructType([StructField("octets", BinaryType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [x.assign(at=x["sub"].astype(np.int64) * self.spec.per_sub + x["cell"])[["at", *iblt.SUMS]] for x in rows]
        if self.left.exists():
            at, *sums = codec.unpack_cells(bytes(self.left.get()[0]))
            parts.append(pd.DataFrame({"at": at, **{c: x.view(np.int64) for c, x in zip(iblt.SUMS, sums, strict=True)}}))
        cells = merged(pd.concat(parts))
        at = cells["at"].to_numpy()
        found, complete = iblt.peeled(at // self.spec.per_sub, at % self.spec.per_sub, *(cells[c].to_numpy() for c in iblt.SUMS), self.spec)
        if complete:
            self.left.clear()
        else:
            self.left.update((self.remaining(cells, found),))
        keys = np.array(list(found), dtype=np.uint64).view(np.int64)
        sides = ["A" if s > 0 else "B" for s in found.values()]
        yield pd.DataFrame({"start": [key[0]] * (len(keys) + 1), "side": [*sides, None], "key": pd.array([*keys.tolist(), None], dtype="Int64"), "complete": complete})

    def remaining(self, cells: pd.DataFrame, found: dict[int, int]) -> bytes:
        """The cells without the keys that were found."""
        keys, signs = np.array(list(found), dtype=np.uint64), np.array(list(found.values()), dtype=np.int64)
        at, check = iblt.places(keys, self.spec)
        taken = pd.DataFrame({"at": at.ravel(), "key_sum": np.tile(keys.view(np.int64), self.spec.k), "hash_sum": np.tile(check.view(np.int64), self.spec.k), "cnt": np.tile(-signs, self.spec.k)})
        rest = merged(pd.concat([cells, taken])).sort_values("at")
        return codec.pack_cells(*(rest[c].to_numpy() for c in ("at", *iblt.SUMS)))

    def close(self) -> None:
        pass


def segments_for(keys: int, spec: iblt.Spec) -> int:
    """Segments whose tables have room for so many keys of a window."""
    return max(1, -(-int(CELLS_PER_KEY * keys) // spec.m))


def window_differences(events: DataFrame, spec: iblt.Spec, time: str, width: str, lateness: str, segments: int = 1, only: DataFrame | None = None) -> DataFrame:
    """DECODED rows of a stream of events (key, side 'A' or 'B', time column), in tumbling windows; a row about completeness is of one
    of a window's segments. only: the `start`s of the windows that are wanted, if not all; the watermark follows all events."""
    if spec.hash != "murmur":
        raise ValueError("windows are decoded with the murmur family")
    known = events.where("key is not null and side in ('A', 'B')").withWatermark(time, lateness)
    wanted = known.select(F.window(time, width).alias("window"), "key", "side")
    if only is not None:
        wanted = wanted.withColumn("start", F.unix_micros("window.start")).join(F.broadcast(only.select("start").distinct()), "start").drop("start")
    once = wanted.dropDuplicates(["window", "side", "key"])
    segment = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(segments)).cast("int").alias("segment")
    rows = iblt.signed_rows(once.select("window", segment, "key", F.when(F.col("side") == "A", 1).otherwise(-1).alias("sign")), spec, "window", "segment")
    cells = rows.groupBy("window", "segment", "sub", "cell").agg(F.bit_xor("key_sum").alias("key_sum"), F.bit_xor("hash_sum").alias("hash_sum"), F.sum("cnt").cast("long").alias("cnt"))
    starts = cells.select(F.unix_micros("window.start").alias("start"), "segment", "sub", "cell", *iblt.SUMS)
    return starts.groupBy("start", "segment").transformWithStateInPandas(WindowDecoder(spec), DECODED, "Append", "None")


def start(decoded: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes what windows gave to Parquet files in `folder`. The session's state store is RocksDB for this query only."""
    spark, name = decoded.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        writer = decoded.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", folder)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def all_differences(events: Callable[[], DataFrame], spec: iblt.Spec, time: str, width: str, lateness: str, folder: str, segments: int = 1) -> DataFrame:
    """DECODED rows of the windows that the stream has passed so far, each of them complete. events: gives the stream from its beginning, as
    windows that couldn't be decoded are streamed again with more segments. folder: where rows and states go."""
    parts, only = [], None
    while True:
        run = f"{folder}/{uuid.uuid4().hex}"
        start(window_differences(events(), spec, time, width, lateness, segments, only), f"{run}/rows", f"{run}/checkpoint", once=True).awaitTermination()
        rows = events().sparkSession.read.schema(DECODED).parquet(f"{run}/rows")
        failed = rows.where("not complete").select("start").distinct()
        parts.append(rows.join(F.broadcast(failed), "start", "left_anti"))
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        only, segments = failed, MORE * segments
