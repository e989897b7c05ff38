"""Sketches over streams: windows of events become tables of cells that can be merged, subtracted and decoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symdiff.operators import iblt


def windowed_cells(events: DataFrame, spec: iblt.Spec, time: str, width: str, lateness: str) -> DataFrame:
    """(window, sub, cell, sums) of events (key, sign, time column) in tumbling windows; sign -1 takes a key out again.

    Of a stream, late events are added until the watermark passes a window; the state is bounded by cells and open windows.
    """
    if events.isStreaming:
        events = events.withWatermark(time, lateness)
    rows = iblt.signed_rows(events.withColumn("window", F.window(time, width)), spec, "window")
    return rows.groupBy("window", "sub", "cell").agg(F.bit_xor("key_sum").alias("key_sum"), F.bit_xor("hash_sum").alias("hash_sum"), F.sum("cnt").cast("long").alias("cnt"))


def start(cells: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs windowed cells into `sink`, which gets finished windows and may decode them."""
    writer = cells.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()
