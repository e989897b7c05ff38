"""Command line: what two versions differ in, and what synchronising them takes.

    python -m symdiff files OLD NEW [--block-size N]        two files, or two folders whose files are paired by path
    python -m symdiff folders MINE THEIRS                   a plan of renamed, modified, new and deleted files
    python -m symdiff corrupt --error-prob P | --num-changes N --change-size S  [--file-len N] [--block-size N]
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdiff.operators import filesync, protocol, sets
from symdiff.plans.tables import settled
from symdiff.sources.files import read_directory


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="symdiff", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    files = commands.add_parser("files")
    files.add_argument("old")
    files.add_argument("new")
    folders = commands.add_parser("folders")
    folders.add_argument("mine")
    folders.add_argument("theirs")
    corrupt = commands.add_parser("corrupt")
    corrupt.add_argument("--file-len", type=int, default=100_000)
    corrupt.add_argument("--error-prob", type=float)
    corrupt.add_argument("--num-changes", type=int, default=5)
    corrupt.add_argument("--change-size", type=int, default=5)
    corrupt.add_argument("--seed", type=int, default=0)
    for each in (files, corrupt):
        each.add_argument("--block-size", type=int)
    return parser.parse_args(argv)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a file, as the path '', or of a folder."""
    path = os.path.abspath(path)
    if os.path.isdir(path):
        return read_directory(spark, path)
    return spark.read.format("binaryFile").load(path).select(F.lit("").alias("path"), "content")


def costs(files: DataFrame) -> DataFrame:
    """The protocol's bits for each of files (doc_id, old, new, block, overlap), and whether the receiver got it right."""
    files = settled(files)
    told = settled(protocol.exchanged(files, octets=True))
    said = protocol.received(protocol.encoded(told))
    return protocol.totals(files, told).join(protocol.rebuilt(files, said).select("doc_id", "ok"), "doc_id")


def synchronised(spark: SparkSession, old: str, new: str, average: int | None) -> DataFrame:
    a, b = contents(spark, old), contents(spark, new)
    named = b.join(a.select("path", F.col("content").alias("before")), "path", "left").select(F.xxhash64("path").alias("doc_id"), "path", "before", F.col("content").alias("after"))
    pairs = protocol.agreed(named.select("doc_id", F.coalesce("before", F.lit(b"")).alias("old"), F.col("after").alias("new")), average)
    return costs(pairs).join(named.select("doc_id", "path"), "doc_id").drop("doc_id")


def corrupted(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    letters = sets.random_text(spark, args.file_len, args.seed).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "byte"))), lambda x: x["byte"]), "").alias("text"))
    old = settled(letters.select(F.lit(1).cast("long").alias("doc_id"), "text"))
    changed = filesync.similar_files(old, args.error_prob, args.seed) if args.error_prob is not None else filesync.block_changed_files(old, args.num_changes, args.change_size, args.seed)
    pairs = old.select("doc_id", F.encode("text", "utf-8").alias("old")).join(changed.select("doc_id", F.col("content").alias("new")), "doc_id")
    return costs(protocol.agreed(pairs, args.block_size))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    """Prints a JSON object a row and returns them."""
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("symdiff").getOrCreate()
    if args.command == "files":
        out = synchronised(spark, args.old, args.new, args.block_size)
    elif args.command == "folders":
        out = filesync.directory_plan(*(filesync.manifest(contents(spark, x)) for x in (args.mine, args.theirs)))
    else:
        out = corrupted(spark, args)
    rows = [json.loads(x) for x in out.toJSON().collect()]
    print("\n".join(map(json.dumps, rows)))
    return rows


if __name__ == "__main__":
    main()
