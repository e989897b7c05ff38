"""Streamed reconciliation, with late events, duplicates, several batches and a table that is too small."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest

from symdiff.operators import codec, iblt
from symdiff.streaming import reconcile

START = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, key long, side string"


def run(spark, folder, batches, spec):
    """Each batch is a file; files are read in order, one a time. (rows, whether the session's state store is as it was)."""
    source = folder / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(START + dt.timedelta(minutes=m), k, s) for m, k, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(1.1)  # the order of files is that of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    decoded = reconcile.window_differences(stream, spec, "ts", "1 hour", "30 minutes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    reconcile.start(decoded, str(folder / "out"), str(folder / "cp"), once=True).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    return spark.read.schema(reconcile.DECODED).parquet(str(folder / "out")).collect()


def hour(row):
    return int((row.start / 1e6 - START.replace(tzinfo=dt.timezone.utc).timestamp()) // 3600)


def test_late_events_and_duplicates(spark, tmp_path):
    first = [(m, m % 23, "A" if m % 3 else "B") for m in range(0, 70)] + [(5, None, "A"), (6, 99, None), (7, 98, "C")]
    second = [(50, 500, "B"), (50, 500, "B"), (130, 7, "A")]  # late, but the first hour is still open: the watermark is at 0:39
    third, fourth = [(200, 1, "B")], [(10, 900, "A")]  # too late, as the first hour was closed at 1:40
    rows = run(spark, tmp_path, [first, second, third, fourth], iblt.Spec(200, 4))
    sides = {(h, s): {k for m, k, x in [*first, *second] if k is not None and x == s and m // 60 == h} for h in (0, 1) for s in "AB"}
    want = {(h, s, k) for h in (0, 1) for s, o in ("AB", "BA") for k in sides[h, s] - sides[h, o]}
    assert {(hour(r), r.side, r.key) for r in rows if r.key is not None} == want and (0, "B", 500) in want and (0, "A", 900) not in want
    assert sum(r.key is not None for r in rows) == len(want)
    assert all(r.complete for r in rows) and sorted(hour(r) for r in rows if r.key is None) == [0, 1]


def test_a_table_that_is_too_small_is_reported(spark, tmp_path):
    rng = random.Random(1)
    rows = run(spark, tmp_path, [[(rng.randrange(60), k, "A") for k in range(300)], [(300, 1, "A")]], iblt.Spec(80, 4))
    assert [r.complete for r in rows if r.key is None] == [False]
    assert {r.side for r in rows if r.key is not None} <= {"A"} and all(r.key < 300 for r in rows if r.key is not None)


def test_what_is_left_goes_on_with_more_cells():
    """State after a first part plus the rest of the window's cells gives the same as all cells at once."""
    spec, keys = iblt.Spec(120, 4), np.arange(1, 91, dtype=np.uint64) * np.uint64(7919)
    at, check = iblt.places(keys, spec)
    table = lambda some: reconcile.merged(pd.DataFrame({"at": at[:, some].ravel(), "key_sum": np.tile(keys[some].view(np.int64), 4), "hash_sum": np.tile(check[some].view(np.int64), 4), "cnt": 1}))
    first, whole = table(slice(0, 40)), table(slice(0, 90))
    decoder = reconcile.WindowDecoder(spec)
    found, complete = iblt.peeled(first["at"].to_numpy() // 30, first["at"].to_numpy() % 30, *(first[c].to_numpy() for c in iblt.SUMS), spec)
    assert complete and len(found) == 40
    left = codec.unpack_cells(decoder.remaining(whole, found))
    rest = table(slice(40, 90)).sort_values("at")
    assert [x.astype(np.int64).tolist() for x in left] == [rest[c].tolist() for c in ("at", *iblt.SUMS)]


def test_only_the_family_that_tasks_can_peel(spark):
    with pytest.raises(ValueError):
        reconcile.window_differences(spark.createDataFrame([], SCHEMA), iblt.Spec(80, 4, "portable"), "ts", "1 hour", "0 seconds")


def test_windows_that_need_more_segments_are_streamed_again(spark, tmp_path):
    """1,000 keys differ in the first hour and 20 in the second, by tables of 80 cells; the first hour has late events."""
    rng = random.Random(2)
    first = [(rng.randrange(60), k, "A" if k % 3 else "B") for k in range(1000)] + [(rng.randrange(60), k, s) for k in range(2000, 2500) for s in "AB"]
    second = [(60 + rng.randrange(60), k, "B") for k in range(20)] + [(300, 1, "A")]
    source = str(tmp_path / "in")
    spark.createDataFrame([(START + dt.timedelta(minutes=m), k, s) for m, k, s in [*second, *first]], SCHEMA).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    rows = reconcile.all_differences(stream, iblt.Spec(80, 4), "ts", "1 hour", "30 minutes", str(tmp_path / "out"), 4).collect()
    got = [(hour(r), r.side, r.key) for r in rows if r.key is not None]
    assert sorted(got) == sorted([(0, "A" if k % 3 else "B", k) for k in range(1000)] + [(1, "B", k) for k in range(20)])
    assert all(r.complete for r in rows)


def test_segments_have_room_for_their_keys():
    spec = iblt.Spec(1 << 14, 4)
    assert [reconcile.segments_for(n, spec) for n in (0, 1, 10_000, 90_000)] == [1, 1, 1, 9]
