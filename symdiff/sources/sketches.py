"""Sketch files as a Spark data source, `spark.read.format("sketch").load(folder)` after `register(spark)`.

A folder holds tables of cells (groups..., [stratum,] sub, cell, key_sum, hash_sum, cnt); group columns are whole numbers or strings.
A file begins with MAGIC and a header: the tables' shape (options m, k and hash when they are written) and the columns. Then follow
messages, each its group's values and the segment and octets of `codec`, all behind their lengths. Tasks write
files of their own, whatever cells they get, with at most a segment's worth in memory; the driver renames them when all
are done, so lost tasks leave nothing that is read. Reading is one task a file, message by message. Cells that several messages
hold are several rows, as in any union of tables: `iblt.summed` adds them up.

The folder must be one that all executors reach through pyarrow's file systems: a shared mount, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from symdiff.operators import codec, iblt

MAGIC, SUFFIX = b"SKETCH1\n", ".sketch"
CELLS = ["sub", "cell", *iblt.SUMS]
KINDS = {"int": IntegerType(), "bigint": LongType(), "string": StringType()}
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    system, folder = opened(path)
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(SUFFIX))


@dataclass
class Header:
    m: int
    k: int
    hash: str
    groups: list[tuple[str, str]]
    strata: bool

    @property
    def spec(self) -> iblt.Spec:
        return iblt.Spec(self.m, self.k, self.hash)

    @property
    def schema(self) -> StructType:
        fields = [*self.groups, *([("stratum", "int")] if self.strata else []), ("sub", "int"), ("cell", "int"), *((c, "bigint") for c in iblt.SUMS)]
        return StructType([StructField(c, KINDS[t]) for c, t in fields])

    def written(self) -> bytes:
        return MAGIC + codec.framed([json.dumps(self.__dict__).encode()])

    @classmethod
    def of(cls, schema: StructType, options: dict[str, str]) -> Header:
        missing = [c for c in CELLS if c not in schema.names]
        groups = [(f.name, f.dataType.simpleString()) for f in schema.fields if f.name not in (*CELLS, "stratum")]
        odd = [c for c, t in groups if t not in KINDS]
        if missing or odd or "m" not in options:
            raise ValueError(f"tables of cells and the option m are needed; missing: {missing}, group columns of other types: {odd}")
        return cls(int(options["m"]), int(options.get("k", 4)), options.get("hash", "murmur"), groups, "stratum" in schema.names)


def next_part(f: pa.NativeFile) -> bytes | None:
    """The next part of a file, without what stands before and after it."""
    length = f.read(1)
    while length and length[-1] & 0x80:
        length += f.read(1)
    if not length:
        return None
    n = int(codec.integers(length)[0])
    part = f.read(n)
    if len(part) < n:
        raise ValueError("the file ends within a part")
    return part


def header_of(f: pa.NativeFile, path: str) -> Header:
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError(f"{path} is no sketch file")
    header = Header(**json.loads(next_part(f)))
    header.groups = [tuple(x) for x in header.groups]
    return header


def read_header(path: str) -> Header:
    system, name = opened(path)
    with system.open_input_stream(name) as f:
        return header_of(f, path)


class SketchFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sketch"

    def schema(self) -> StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no sketch files in {self.options['path']}")
        return read_header(files[0]).schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return SketchReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SketchWriter(self.options["path"], Header.of(schema, dict(self.options)), schema.names, overwrite)


class SketchReader(DataSourceReader):
    """Conditions column = value on group columns leave out messages before they are unpacked."""

    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        groups = {c for c, _ in read_header(files_of(self.path)[0]).groups}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in groups:
                self.wanted[f.attribute[0]] = f.value
            yield f  # Spark checks them once more, so a message may be left in

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in files_of(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, name = opened(partition.value)
        with system.open_input_stream(name, buffer_size=1 << 20) as f:
            header = header_of(f, partition.value)
            while (message := next_part(f)) is not None:
                values, octets = json.loads(message), next_part(f)
                if all(values[c] == v for c, v in self.wanted.items()):
                    yield self.cells(header, values, octets)

    def cells(self, header: Header, values: dict, octets: bytes) -> pa.RecordBatch:
        at, keys, checks, counts = codec.unpack_cells(octets)
        at, spec = at + values["segment"] * codec.SEGMENT, header.spec
        within = at % spec.m if header.strata else at
        columns = {c: pa.array([values[c]] * len(at), ARROW[t]) for c, t in header.groups}
        if header.strata:
            columns["stratum"] = pa.array((at // spec.m).astype(np.int32))
        columns |= {c: pa.array(x.astype(np.int32)) for c, x in (("sub", within // spec.per_sub), ("cell", within % spec.per_sub))}
        columns |= {"key_sum": pa.array(keys.view(np.int64)), "hash_sum": pa.array(checks.view(np.int64)), "cnt": pa.array(counts)}
        return pa.RecordBatch.from_pydict(columns)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class SketchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, header: Header, names: list[str], overwrite: bool):
        self.path, self.header, self.names, self.overwrite = path, header, names, overwrite

    def messages(self, rows: pa.Table) -> Iterator[bytes]:
        """Of some cells, by group and segment."""
        spec, groups = self.header.spec, [c for c, _ in self.header.groups]
        at = rows.column("sub").to_numpy().astype(np.int64) * spec.per_sub + rows.column("cell").to_numpy()
        if self.header.strata:
            at += rows.column("stratum").to_numpy().astype(np.int64) * spec.m
        rows = rows.append_column("at", pa.array(at)).append_column("segment", pa.array(at // codec.SEGMENT)).sort_by([(c, "ascending") for c in (*groups, "at")])
        named = rows.select([*groups, "segment"]).to_pylist()
        at, *sums = (rows.column(c).to_numpy() for c in ("at", *iblt.SUMS))
        if (rows.column("cell").null_count or rows.column("sub").null_count) or (len(at) and (at < 0).any()):
            raise ValueError("cells need their place")
        bounds = [0, *(i for i in range(1, len(named)) if named[i] != named[i - 1] or at[i] == at[i - 1]), len(named)]
        for i, j in zip(bounds, bounds[1:], strict=False):
            if i < j:
                yield codec.framed([json.dumps(named[i]).encode(), codec.pack_cells(at[i:j] - named[i]["segment"] * codec.SEGMENT, *(x[i:j] for x in sums))])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        name, held, size = f"{folder.rstrip('/')}/{uuid.uuid4().hex}", [], 0
        with system.open_output_stream(f"{name}.part") as f:
            f.write(self.header.written())
            for batch in iterator:
                held.append(batch)
                size += batch.num_rows
                if size >= codec.SEGMENT:
                    f.write(b"".join(self.messages(pa.Table.from_batches(held))))
                    held, size = [], 0
            if size:
                f.write(b"".join(self.messages(pa.Table.from_batches(held))))
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        before = files_of(self.path) if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{name}.part", f"{name}{SUFFIX}")
        for old in before:
            system.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.delete_file(f"{name}.part")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets its Python sources see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SketchFiles)
