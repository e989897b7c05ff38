"""Toxicity by maximum-scoring segments over token log-odds.

Lexicon: words and word beginnings (PREFIXES characters, which stand for their inflections) get the log-odds of toxic
against other training documents, with an informative Dirichlet prior: a token's weight is its share of all training
text, the whole prior weighs PRIOR times the smaller class. A token as frequent in both classes has log-odds 0, one
that only toxic texts hold at least ln(1 + 1 / PRIOR), whatever the classes' sizes. Tokens LEAST_Z standard deviations and
LEAST_ODDS above zero are kept. A word of a text scores its greatest log-odds, or -DRIFT when it has none.

Passages: the maximal scoring segments of a text's word scores, found in one pass (linear time). Calibration: under the
word score distribution of other documents, a random text's best segment follows an extreme-value law with the rate
`scale`; a passage counts by scale * score - ln(number of words), if that is above zero. A document's sum of these, on a
logarithmic scale, goes through a logistic curve, fitted on training documents scored with lexicons that were learned
without them (FOLDS). There, each class weighs as much as it has labels, however many of them the sample holds.

Training rows are a bounded sample of the labelled ones (PER_CLASS of each class, by hash of the id, found by a
pre-aggregated min; ids whose hash falls on the same place leave one, also below the bound). Every document is scored over its whole text, row by row: no shuffle. The driver gets the lexicon,
all tokens of that sample that are significant, a histogram of scores and a number for each training document.

Defined results: a null or empty text has no passages and the curve's score for none; without labels of both classes
nothing is toxic (score 0); a row with a null id is scored, not held out and never learned from; if a label table
repeats an id, the greatest label counts, and so for equal texts of the sample; repeated rows are each scored; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import Memory, in_small_batches, release, releasing, slices, written

PER_CLASS = 4096
FOLDS = 5
PREFIXES = range(3, 7)
#: Weight of the prior, in parts of the smaller class's tokens.
PRIOR = 0.25
LEAST_Z = 3.0
LEAST_ODDS = math.log(2)
DRIFT = 0.25
#: Least share of background words that are taken to score, so that a lexicon that never met one keeps a finite scale.
RARE = 1e-5
CACHE = 1 << 17
WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> list[str]:
    w = word.lower()
    return [w, *(f"{w[:k]}-" for k in PREFIXES if k < len(w))]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    intercept: float = -math.inf
    slope: float = 0.0

    def probability(self, evidence: float) -> float:
        return 0.0 if self.intercept == -math.inf else 1 / (1 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * math.log1p(evidence)))))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, Memory(CACHE)

    def scores(self, words: list[str]) -> list[float]:
        """Of each word; 0 for those that the lexicon doesn't have."""
        get = self.model.lexicon.get
        missing = self.known.missing(set(words))
        self.known.new.update((w, max(get(t, 0.0) for t in tokens(w))) for w in missing)
        return [self.known.new[w] for w in words]

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], float, int]:
        """Significant passages (first word, end word, score), the evidence, and the number of words."""
        words = WORD.findall(text)
        scores = np.array(self.scores(words))
        found = segments(scores)
        least = math.log(len(words) + 1)
        out = [(a, b, s) for a, b, s in found if self.model.scale * s > least]
        return out, sum(self.model.scale * s - least for *_, s in out), len(words)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score): every positive score is one, and neighbours are joined while
    that gains; the words between count -DRIFT each.

    An open segment knows the last one before it that starts lower. The search for a lower start follows these links;
    when there is none, no open segment can grow any more, and all are closed.
    """
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    upto = np.concatenate(([0.0], np.cumsum(np.where(scores > 0, scores, -DRIFT))))
    closed: list[tuple[int, int, float]] = []
    opened: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum at the end, link
    for first, low, high in zip(hits.tolist(), upto[hits].tolist(), upto[hits + 1].tolist(), strict=True):
        end, j = first + 1, len(opened) - 1
        while j >= 0 and opened[j][2] >= low:
            j = opened[j][4]
        while j >= 0 and opened[j][3] < high:
            first, _, low, _, before = opened[j]
            del opened[j:]
            j = before
        if j < 0:
            closed += [(a, b, y - x) for a, b, x, y, _ in opened]
            opened.clear()
        opened.append((first, end, low, high, j))
    return closed + [(a, b, y - x) for a, b, x, y, _ in opened]


def log_odds(t, c, toxic: float, other: float, log=math.log, root=math.sqrt):
    """(log-odds, their number of standard deviations) of a token's counts among all tokens' counts toxic and other."""
    weight = PRIOR * min(toxic, other)
    prior = (t + c) * (weight / (toxic + other))
    odds = log((t + prior) / (toxic + weight - t - prior)) - log((c + prior) / (other + weight - c - prior))
    return odds, odds / root(1 / (t + prior) + 1 / (c + prior))


def learn(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """The lexicon of token counts (toxic, other); toxic, other: all tokens' counts."""
    judged = {token: log_odds(t, c, toxic, other) for token, (t, c) in counts.items()}
    return {token: odds for token, (odds, z) in judged.items() if z >= LEAST_Z and odds >= LEAST_ODDS}


def rate(values: Counter, words: int) -> float:
    """The positive root of sum(p * exp(x * score)) = 1 over background word scores; values: of the words that score."""
    if not values:
        values = Counter({LEAST_ODDS: 1})
    share = max(RARE, sum(values.values()) / max(1, words))
    total = sum(values.values())
    share = min(share, 0.5 * DRIFT / (DRIFT + max(values)))
    mean = lambda x: (1 - share) * math.exp(-DRIFT * x) + sum(n / total * share * math.exp(s * x) for s, n in values.items())
    low, high = 1e-6, 1.0
    while mean(high) < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a weak pull to zero on both; only the weights' proportions matter."""
    weights = weights * (len(weights) / weights.sum())
    scale = max(1.0, float(x.max(initial=0.0)))
    a, w = np.stack([np.ones(len(x)), x / scale], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weights * (p - y)) + 1e-3 * w
        hessian = (a * (weights * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
    return float(w[0]), float(max(0.0, w[1]) / scale)


def held_out(id_col) -> F.Column:
    """crc32 of the id as text, mod 5, is 0; labels of these rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_ids(labels: DataFrame) -> DataFrame:
    """(id, toxic, fold, weight), at most PER_CLASS of each class; weight: the labels of its class a row stands for."""
    known = labels.where("id is not null and toxic is not null").where(~held_out(F.col("id")))
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PER_CLASS))
    chosen = known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"), place.alias("place")).agg(F.min_by("id", F.xxhash64("id", F.lit(4))).alias("id"), F.count("*").alias("weight"))
    return chosen.groupBy("id").agg(F.max("toxic").alias("toxic"), F.max_by("weight", "toxic").alias("weight")).select("id", "toxic", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLDS)).alias("fold"), "weight")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Of docs (id, text) and labels (id, toxic)."""
    sample = docs.where("text is not null").join(F.broadcast(training_ids(labels)), "id")
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"), F.sum("weight").alias("weight"))
    sample = written(sample.select("text", "toxic", "fold", "weight"))

    def count(batches):
        found: Counter = Counter()
        for batch, texts in slices(batches, "text"):
            for text, toxic, fold in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.update((t, toxic, fold) for t in {t for w in set(WORD.findall(text.decode())) for t in tokens(w)})
        keys = list(found)
        kinds = [(toxic, fold) for toxic in (1, 0) for fold in range(FOLDS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), *(pa.array([found[k] if k[1:] == kind else 0 for k in keys], pa.int64()) for kind in kinds)],
            ["token", *names],
        )

    names = [f"{x}{fold}" for x in "tc" for fold in range(FOLDS)]
    parts = sample.mapInArrow(releasing(count), "token string, " + ", ".join(f"{c} long" for c in names))
    counts = written(parts.groupBy("token").agg(*(F.sum(c).alias(c) for c in names)))
    first = counts.agg(*(F.sum(c).alias(c) for c in names)).first()
    total = [first[c] or 0 for c in names]
    if not all(total):
        return Model()
    t, c = (sum(F.col(f"{x}{fold}") for fold in range(FOLDS)) for x in "tc")
    odds, z = log_odds(t, c, sum(total[:FOLDS]), sum(total[FOLDS:]), F.log, F.sqrt)
    rows = counts.select("*", z.alias("z")).where((odds >= LEAST_ODDS) & (z >= LEAST_Z - 1)).collect()

    def without(fold: int) -> dict[str, float]:
        use = [k for k in range(FOLDS) if k != fold]
        some = {r.token: (sum(r[f"t{k}"] for k in use), sum(r[f"c{k}"] for k in use)) for r in rows}
        return learn({k: v for k, v in some.items() if v[0]}, sum(total[k] for k in use), sum(total[FOLDS + k] for k in use))

    lexicons = [without(fold) for fold in range(FOLDS)]

    def scored(batches):
        """(batch, the word scores of each of its texts) by what the lexicon learned without its fold gives."""
        scorers = [Scorer(Model(x)) for x in lexicons]
        for batch, texts in slices(batches, "text"):
            yield batch, [scorers[f].scores(WORD.findall(t.decode())) for f, t in zip(batch.column(2).to_pylist(), texts, strict=True)]

    def background(batches):
        """A histogram of other documents' word scores; the score 0 stands for all their words."""
        found: Counter = Counter()
        for batch, scores in scored(batches):
            for toxic, x in zip(batch.column(1).to_pylist(), scores, strict=True):
                if not toxic:
                    found.update(round(s, 1) for s in x if s > 0)
                    found[0.0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], ["score", "n"])

    seen = {r.score: r.n for r in sample.mapInArrow(releasing(background), "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()}
    scale = rate(Counter({s: n for s, n in seen.items() if s}), seen.get(0.0, 0))

    def look(batches):
        for batch, scores in scored(batches):
            evidence = [sum(max(0.0, scale * s - math.log(len(x) + 1)) for *_, s in segments(np.array(x))) for x in scores]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(evidence, pa.float64())], ["toxic", "weight", "evidence"])

    points = sample.mapInArrow(releasing(look), "toxic int, weight long, evidence double").toPandas()
    curve = logistic(np.log1p(points.evidence.to_numpy()), points.toxic.to_numpy(dtype=float), points.weight.to_numpy(dtype=float))
    return Model(without(-1), scale, *curve)


def score(df: DataFrame, model: Model) -> DataFrame:
    """df (id, text) -> (id, score, n_passages, passages); passages: first:end in code points, joined by commas."""

    def work(batches):
        scorer = Scorer(model)
        for batch, texts in slices(batches, "text"):
            scores, found = [], []
            for raw in texts:
                text = raw.decode()
                some, evidence, _ = scorer.passages(text)
                scores.append(model.probability(evidence))
                spans = [m.span() for m in WORD.finditer(text)] if some else []
                found.append(",".join(f"{spans[a][0]}:{spans[b - 1][1]}" for a, b, _ in some))
            counts = [x.count(":") for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(found, pa.string())],
                ["id", "score", "n_passages", "passages"],
            )

    return df.mapInArrow(releasing(work), "id long, score double, n_passages long, passages string")


def with_score(df: DataFrame, model: Model, into: str, text_col: str = "text") -> DataFrame:
    """df with the column `into`: its score."""

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([model.probability(scorer.passages(t or "")[1]) for t in texts], dtype=float)
        del scorer
        release()

    return in_small_batches(df).withColumn(into, judge(df[text_col].cast("string")))


def plain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return in_small_batches(df).select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of df: id, held_out, score, predicted, n_passages, passages."""
    rows = plain(df, id_col, text_col)
    model = fit(rows, labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic")))
    out = score(rows, model)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")
