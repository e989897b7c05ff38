"""Hard-negative mining by a full sort of scores for each anchor.

A component x becomes floor(256 * x); a score is the integer inner product with the anchor. Rows and anchors are dealt
into a grid: a cell holds up to about ANCHORS anchors and ROWS rows, and each anchor meets each row in one cell. There, all of
an anchor's scores are lexsorted by score and id, which gives

1. its first rows of the same label: a cell's few best, then the best of these over all cells;
2. for each of these positives, by binary search, the first place at or below the upper limit and the last one at or
   above the lower limit; between them the first rows of other labels are read, again a few from each cell, and the best
   of these stay.

So a task holds one cell's rows and a slice of its scores, whatever the number of rows, and what is shuffled after the grid are
`positives` and `negatives` rows an anchor and cell at most. Rows are copied once for each ANCHORS anchors.

Defined results: rows with a null id, label or vector, or any null or non-finite component take no part; vectors of
different lengths never meet, empty ones score 0; rows that repeat an id are rows of their own, but never their namesake
anchor's positives or negatives, and each anchor among them has its result; components beyond a double's range and
scores beyond a long's are cut off at its ends; an anchor without a
positive, or a positive without a negative, gives no row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symdiff.llm.common import in_small_batches, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: What a cell of the grid holds.
ANCHORS, ROWS = 1 << 13, 1 << 13
#: Scores that a task holds at once.
SCORES = 1 << 21
#: Shuffle partitions of the grid at most.
MOST_PARTITIONS = 1 << 13
LONG = (1 << 63) - 1
#: Components beyond are cut off: the largest double.
MOST = np.finfo(np.float64).max


def scaled(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    """floor(SCALE * x) by row, as doubles that hold whole numbers; infinite where it leaves a double's range."""
    if not n:
        return np.zeros((0, 0))
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.floor(flat.reshape(n, len(flat) // n) * float(SCALE))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all of b, exact and cut off at a long's ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    small_a, small_b = (np.abs(m).max(axis=1) <= (2**53 / m.shape[1]) ** 0.5 for m in (a, b))
    out[np.ix_(small_a, small_b)] = (a[small_a] @ b[small_b].T).astype(np.int64)
    for some, others in ((~small_a, np.full(len(b), True)), (small_a, ~small_b)):  # the pairs that doubles may not hold
        if some.any() and others.any():
            whole = [[[int(x) for x in r] for r in np.clip(m, -MOST, MOST).tolist()] for m in (a[some], b[others])]
            cut = [[min(max(sum(x * y for x, y in zip(p, q, strict=True)), -LONG - 1), LONG) for q in whole[1]] for p in whole[0]]
            out[np.ix_(some, others)] = np.array(cut, dtype=np.int64)
    return out


class Cell:
    """The anchors and rows that meet in a task."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("id", "label"))
        self.names, self.anchor_ids, self.anchor_labels = (anchors.column(c).to_numpy() for c in ("row", "id", "label"))
        self.of_anchors, self.of_rows = scaled(anchors.column("vector"), len(anchors)), scaled(rows.column("vector"), len(rows))

    def ranked(self):
        """For each anchor: (its number, its scores, the order of all rows by score and id)."""
        step = max(1, SCORES // max(1, len(self.ids)))
        for at in range(0, len(self.names), step):
            for k, s in enumerate(scores(self.of_anchors[at : at + step], self.of_rows)):
                yield at + k, s, np.lexsort((self.ids, ~s))  # ~s falls as s rises, for every long

    def positives(self, most: int) -> pa.Table:
        out = []
        for k, s, order in self.ranked():
            first = order[(self.labels[order] == self.anchor_labels[k]) & (self.ids[order] != self.anchor_ids[k])][:most]
            out.append((np.full(len(first), self.names[k]), self.ids[first], s[first]))
        return table_of(["row", "id", "score"], out)

    def negatives(self, positives: list, most: int, low: int, high: int) -> pa.Table:
        """positives: of each anchor, its list of {no, score}."""
        out = []
        for k, s, order in self.ranked():
            order = order[(self.labels[order] != self.anchor_labels[k]) & (self.ids[order] != self.anchor_ids[k])]
            falling = ~s[order]
            for p in positives[k]:
                upper, lower = min(high * p["score"] // 100, LONG), max(-(-low * p["score"] // 100), -LONG - 1)
                begin = np.searchsorted(falling, ~upper, "left")
                end = min(np.searchsorted(falling, ~lower, "right"), begin + most)
                some = order[begin:end]
                out.append((np.full(len(some), self.names[k]), np.full(len(some), p["no"]), self.ids[some], s[some]))
        return table_of(["row", "no", "negative_id", "negative_score"], out)


def table_of(names: list[str], parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
    return pa.table(dict(zip(names, columns, strict=True)))


def mine_hard_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the rows that is_anchor tells, the
    first `positives` other rows of their label, and for each of them the first `negatives` rows of other labels with
    low_percent * positive_score <= 100 * score <= high_percent * positive_score."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    chosen = in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), df[vector_col].cast("array<double>").alias("vector"), is_anchor.alias("anchor"))
    rows = chosen.where("id is not null and label is not null and vector is not null").where(finite).withColumn("size", F.size("vector"))
    anchors = written(rows.where("anchor").drop("anchor").withColumn("row", F.monotonically_increasing_id()))
    rows, counts = rows.drop("anchor"), rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    across, down = max(1, -(-counts["anchors"] // ANCHORS)), max(1, -(-counts["rows"] // ROWS))
    partitions = min(4 * across * down, MOST_PARTITIONS)
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["size", "g", "h"]
    dealt_rows = rows.withColumn("h", spread("id", down)).withColumn("g", every(across)).repartition(partitions, *cell).groupBy(*cell)

    def dealt(table: DataFrame):
        return table.withColumn("g", spread("row", across)).withColumn("h", every(down)).repartition(partitions, *cell).groupBy(*cell)

    def best_positives(some: pa.Table, others: pa.Table) -> pa.Table:
        return Cell(some, others).positives(positives)

    def best_negatives(some: pa.Table, others: pa.Table) -> pa.Table:
        return Cell(some, others).negatives(some.column("best").to_pylist(), negatives, low_percent, high_percent)

    found = dealt(anchors).cogroup(dealt_rows).applyInArrow(best_positives, "row long, id long, score long")
    first = found.withColumn("no", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))).where(F.col("no") <= positives)
    first = written(first.select("row", "no", F.col("id").alias("positive_id"), "score"))
    with_best = anchors.join(first.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "score"))).alias("best")), "row")
    found = dealt(with_best).cogroup(dealt_rows).applyInArrow(best_negatives, "row long, no long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "no").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = ranked.join(first, ["row", "no"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


#: The query's rows in SQL; scores stay exact in doubles below 2^53.
NEGATIVES_SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM valid a JOIN valid r ON a.vec_id % 100 = 0 AND len(a.v) = len(r.v) AND a.vec_id <> r.vec_id
),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
