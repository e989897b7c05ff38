"""Arrow batches between Spark and Python: their limits, slices of texts, and giving memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: Rows and bytes of an Arrow batch between Spark and Python: whole texts may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's limits of Arrow batches to ours if they are higher; they hold for later plans too."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def release() -> None:
    """Gives freed memory back to the system: Python workers live on and serve other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in slices of about `most` bytes of text, so that memory follows the slice and not the batch."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start), [x or b"" for x in column.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start), [x or b"" for x in column.slice(start).to_pylist()]
    release()
