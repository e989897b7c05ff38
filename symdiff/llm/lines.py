"""Line de-duplication with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z lower-cased; it is known by 128 bits of its digest. Keys of
at least `min_chars` code points that at least `min_docs` documents hold lose all their lines except in the largest id.

Documents come in batches. A batch's keys are added up to one row each (how many of its documents hold the key, the
largest of them) before they are shuffled, and merge-anti-joined with the runs: keys that no run holds make a new run of
level 0, the others are noted as repeats. So a key is in one run only. A run is a table bucketed and sorted by key, so
the merge joins move the batch's rows alone. When a level has FANOUT runs, they are compacted into one of the next level. In the end the
repeats are added to the runs' counts, which gives the keys to drop; a key that one third of all documents hold is one
row in each run. Documents meet their dropped keys in one shuffle by id.

Defined results: a null or empty text is one empty line; rows with one id are one document, whose texts all stay or lose
a key's lines; a key that is repeated within the largest id stays there each time; a row with a null id keeps all its
lines and is counted nowhere; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdiff.llm.common import in_small_batches, slices, written
from symdiff.plans.tables import shared_folder

# What is stripped from lines.
WHITE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Runs of a level that are compacted into one of the next.
FANOUT = 3
#: Parts that a whole table is dealt into by document, each added as a batch.
BATCHES = 4
KEY = ["h1", "h2"]
CONTINUATION = bytes(range(0x80, 0xC0))


def digest(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.translate(None, CONTINUATION)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """The state between batches: levels of runs (h1, h2, n, owner), and repeats in the same form."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.repeats: list[DataFrame] = []

    def sorted_run(self, rows: DataFrame, *parts: str) -> DataFrame:
        name = f"runs_{uuid.uuid4().hex}"
        out = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        (out.partitionBy(*parts) if parts else out).option("path", f"{shared_folder(self.spark)}/tables/{name}").saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> None:
        """A batch of (h1, h2, id), one row for each key of each document; no document is in two batches."""
        rows = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner")).withColumn("seen", F.lit(False))
        for run in self.runs():
            held = run.select(*KEY, F.lit(True).alias("here")).hint("merge")
            rows = rows.join(held, KEY, "left").select(*KEY, "n", "owner", (F.col("seen") | F.coalesce("here", F.lit(False))).alias("seen"))
        table = self.sorted_run(rows, "seen")
        self.levels[0].append(table.where("not seen").drop("seen"))
        self.repeats.append(table.where("seen").drop("seen"))
        self.compact()

    def compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                merged = level[0]
                for run in level[1:]:
                    merged = merged.unionByName(run)
                self.levels[i] = []
                self.levels[i + 1].append(self.sorted_run(merged))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, owner) of the keys that so many documents hold."""
        again = self.repeats[0]
        for more in self.repeats[1:]:
            again = again.unionByName(more)
        again = written(again.groupBy(*KEY).agg(F.sum("n").alias("more"), F.max("owner").alias("other")))
        out = None
        for run in self.runs():
            total = run.join(again, KEY, "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= min_docs).select(*KEY, F.greatest("owner", "other").alias("owner"))
            out = total if out is None else out.unionByName(total)
        return out


def line_keys(df: DataFrame, min_chars: int) -> DataFrame:
    """(id, text) -> (id, h1, h2): a row's distinct keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = [list({d for line in t.split(b"\n") if (d := digest(line, min_chars))}) for t in texts]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            keys = np.frombuffer(b"".join([d for x in found for d in x]), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["id", *KEY])

    return df.where("id is not null and text is not null").mapInArrow(work, "id long, h1 long, h2 long")


def without(text: bytes, dropped: bytes, min_chars: int) -> tuple[bytes, int, int]:
    """(what stays, lines, dropped lines) of a text; dropped: 16 bytes a key."""
    lines = text.split(b"\n")
    if not dropped:
        return text, len(lines), 0
    keys = {dropped[k : k + 16] for k in range(0, len(dropped), 16)}
    kept = [line for line in lines if digest(line, min_chars) not in keys]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """One row per row of df: id, text (what stays), n_lines, n_dropped."""
    docs = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    repeated = not docs.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    keys = line_keys(docs, min_chars)
    keys = written((keys.dropDuplicates() if repeated else keys).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "batch")
    runs = LineRuns(df.sparkSession)
    for k in range(batches):
        runs.add(keys.where(F.col("batch") == k).drop("batch"))
    frequent = written(runs.frequent(min_docs))
    hit = keys.join(frequent, KEY).where("id < owner")
    dropped = hit.groupBy("id").agg(F.collect_list("h1").alias("first"), F.collect_list("h2").alias("second"))

    # Rows with a null id are spread by a second key that only they have.
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
    met = docs.withColumn("place", place).join(dropped.withColumn("place", F.lit(0).cast("long")).hint("shuffle_hash"), ["id", "place"], "left")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(parts, "text"):
            bare = []
            for k, t in enumerate(texts):
                h = [batch.column(c)[k].values for c in (2, 3)]
                pairs = np.stack([x.to_numpy() for x in h], axis=1).astype("<i8").tobytes() if h[0] is not None else b""
                bare.append(without(t, pairs, min_chars))
            columns = [pa.array([x[0] for x in bare], pa.binary()).cast(pa.string()), *(pa.array([x[k] for x in bare], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "text", "n_lines", "n_dropped"])

    out = met.select("id", "text", "first", "second").mapInArrow(work, "id long, text string, n_lines long, n_dropped long")
    return out.withColumnRenamed("id", id_col)


#: The same in SQL, for the query.
LINES_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
),
frequent AS (SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT r, doc_id, i, line, coalesce(doc_id < owner, false) AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
