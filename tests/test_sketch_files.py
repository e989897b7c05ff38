"""Sketch files as a data source."""

import glob

import pytest
from pyspark.sql import functions as F

from symdiff.operators import codec, iblt, strata
from symdiff.sources import sketches

SPEC = iblt.Spec(400, 4, "portable")


@pytest.fixture(scope="module")
def session(spark):
    sketches.register(spark)
    return spark


def tables(spark):
    keys = spark.range(600).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, "eß'\"").alias("name"), (F.col("id") * 7919).alias("key"), F.when(F.col("id") % 7 == 0, -1).otherwise(1).alias("sign"))
    return iblt.build(keys, SPEC, "g", "name")


def save(df, path, mode="append", spec=SPEC):
    df.write.format("sketch").option("m", spec.m).option("k", spec.k).option("hash", spec.hash).mode(mode).save(path)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_round_trip_with_groups(session, tmp_path, monkeypatch):
    cells = tables(session).repartition(5)
    save(cells, path := str(tmp_path / "t"))
    back = session.read.format("sketch").load(path)
    assert rows(back) == rows(cells) and dict(back.dtypes) == dict(cells.dtypes)
    assert back.rdd.getNumPartitions() == len(glob.glob(f"{path}/*.sketch")) == 5
    assert not glob.glob(f"{path}/*.part")
    assert rows(back.where("g = 1")) == rows(cells.where("g = 1"))
    save(cells.where("g = 2"), path, "overwrite")
    assert rows(session.read.format("sketch").load(f"file://{path}")) == rows(cells.where("g = 2"))
    save(cells.where("g < 2"), path)
    assert rows(session.read.format("sketch").load(path)) == rows(cells)


def test_merged_tables_decode(session, tmp_path):
    """Two parties write their tables into one folder; what is read adds up to the difference."""
    spec = iblt.Spec(200, 4)
    for keys, sign in ((range(0, 500), 1), (range(20, 510), -1)):
        save(iblt.build(session.createDataFrame([(k, sign) for k in keys], "key long, sign int"), spec), str(tmp_path / "d"), spec=spec)
    found, complete = iblt.decode(iblt.summed(session.read.format("sketch").load(str(tmp_path / "d"))), spec)
    assert complete and {(r.side, r.key) for r in found.collect()} == {*(("A", k) for k in range(20)), *(("B", k) for k in range(500, 510))}


def test_estimators_and_small_segments(session, tmp_path, monkeypatch):
    cells = strata.build(session.range(3000).select(F.col("id").alias("key")))
    save(cells, str(tmp_path / "s"), spec=strata.STRATUM)
    assert rows(session.read.format("sketch").load(str(tmp_path / "s"))) == rows(cells)


def test_repeated_cells_and_empty_tables(session, tmp_path):
    cells = tables(session).drop("name")
    both = cells.unionByName(cells).coalesce(1)
    save(both, str(tmp_path / "r"))
    assert rows(session.read.format("sketch").load(str(tmp_path / "r"))) == rows(both)
    save(cells.where("false").coalesce(1), str(tmp_path / "e"))
    empty = session.read.format("sketch").load(str(tmp_path / "e"))
    assert empty.count() == 0 and empty.columns == ["g", "sub", "cell", "key_sum", "hash_sum", "cnt"]


def test_errors(session, tmp_path):
    for df, options in ((session.range(3), {"m": 400}), (tables(session), {}), (tables(session).withColumn("x", F.lit(1.5)), {"m": 400})):
        with pytest.raises(Exception, match="tables of cells and the option m"):
            df.write.format("sketch").options(**options).mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="no sketch files"):
        (tmp_path / "none").mkdir()
        session.read.format("sketch").load(str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.sketch").write_bytes(b"something else")
    with pytest.raises(Exception, match="is no sketch file"):
        session.read.format("sketch").load(str(tmp_path / "bad"))
    assert list(codec.parts_of(codec.framed([b"", b"x" * 200]))) == [b"", b"x" * 200]
