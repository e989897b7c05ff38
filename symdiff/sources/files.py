"""Files and run records: binary files, directories, concatenated JSON objects, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length, sha1 BINARY) of a file or of all files that a pattern names; a missing file is an error."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", "length", F.unhex(F.sha1("content")).alias("sha1"))


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, content): all files below root by relative path, but those whose relative path starts with a dot."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/+", "/")
    relative = F.substring(plain, F.instr(plain, F.lit(start)) + len(start), F.length(plain))
    return files.select(relative.alias("path"), "content").where(~F.col("path").startswith("."))


def write_files(chunks: DataFrame, path: str) -> None:
    """(doc_id, chunk_no, data) to one row of whole bytes per document, as parquet."""
    parts = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    parts.select("doc_id", whole.alias("content")).write.mode("overwrite").parquet(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Run records: files of JSON objects that follow one another, each over several lines.

    A file is split where a line closes an object and the next one opens another; a file is held by one task, as run
    logs are small.
    """
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.split("value", r"(?<=\})\s*(?=\{\s*\n?)")).alias("value")).where("trim(value) <> ''")
    return each.select(F.from_json("value", schema).alias("r")).select("r.*")


def to_records(df: DataFrame) -> DataFrame:
    """(value): each row as a pretty JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))


def write_records(df: DataFrame, path: str) -> None:
    to_records(df).write.mode("overwrite").text(path)
