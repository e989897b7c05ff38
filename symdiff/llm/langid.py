"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram's vector binds (multiplies) its three letters' vectors,
permuted (rotated) by 2, 1 and 0 places. A document's vector bundles (adds) the vectors of its trigrams, with word gaps
as letters; a language's prototype bundles the unit vectors of its training documents. A document takes the language
whose prototype has the greatest cosine with its vector.

Prototypes are fitted on a bounded sample of labelled documents (PER_LANGUAGE of each language, by hash of the id, found
by a pre-aggregated min); the languages' sums are all that reaches the driver. Every document is predicted from its
whole text, row by row: no shuffle.

A text is of a known language if its best cosine reaches a floor, MARGIN times the least best cosine of the sample's texts
of about its length (powers of two of trigrams). Where fewer than LEAST_TEXTS are so long, shorter ones count too; texts
shorter than those have no floor.

Defined results: a text without a letter, empty or null, is `und` with score 0; ties go to the language that sorts
first; a table without labelled texts predicts `und` everywhere, and as no language is learned, any letter makes a text
known; repeated rows are each predicted; a row with a null id is not held out; other columns are not read. The score is
the share of the best cosine among the positive cosines, sharpened by SHARPNESS (a softmax). A text without a letter is
of no known language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import in_small_batches, release, releasing, slices, written

DIMENSIONS = 1024
#: Letters share this many vectors; code points of the usual alphabets have one each.
LETTERS = 1024
PER_LANGUAGE = 1024
#: Training ids up to this many (some hundred languages) are sent to every executor instead of shuffling the texts.
BROADCAST_IDS = 500_000
SHARPNESS = 30.0
SEED = 20
#: Of the least cosine of training texts, and texts that it takes.
MARGIN = 0.5
LEAST_TEXTS = 32
#: Texts longer than this are counted in parts.
PART = 1 << 20


@cache
def letter_numbers() -> np.ndarray:
    """Of each code point: its letter's number in lower case, 0 if it isn't a letter."""
    out = np.zeros(0x110000, dtype=np.int16)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = 1 + ord(low if len(low) == 1 else x) % (LETTERS - 1)
    return out


class Encoder:
    def __init__(self):
        draws = np.random.default_rng(SEED).integers(0, 2, size=(LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
        self.turned = [np.roll(draws, k, axis=1) for k in (2, 1, 0)]
        self.numbers = letter_numbers()

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Trigram codes and counts (a long text's codes may come in several parts); empty if it has no letter."""
        n = self.numbers[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        n = n[(n > 0) | np.concatenate(([True], n[:-1] > 0))]  # a gap is one place
        found = []
        for at in range(0, len(n) - 2, PART):
            x = n[at : at + PART + 2].astype(np.int64)
            found.append(np.unique((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:], return_counts=True))
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate([c for c, _ in found]), np.concatenate([k for _, k in found])

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A unit vector per text, zero for those without a letter, and the length class of each."""
        counted = [self.counts(t) for t in texts]
        every, where = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *(c for c, _ in counted)]), return_inverse=True)
        out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        weights = np.zeros((len(texts), min(len(every), 4096)), dtype=np.float32)
        owner = np.repeat(np.arange(len(texts)), [len(c) for c, _ in counted])
        times = np.concatenate([np.empty(0, dtype=np.int64), *(n for _, n in counted)])
        for at in range(0, len(every), 4096):  # trigrams by the block, so that memory is bounded
            e = every[at : at + 4096]
            grams = self.turned[0][e // LETTERS**2] * self.turned[1][e // LETTERS % LETTERS] * self.turned[2][e % LETTERS]
            weights[:] = 0
            mine = (where >= at) & (where < at + 4096)
            np.add.at(weights, (owner[mine], where[mine] - at), times[mine])
            out += weights[:, : len(e)] @ grams.astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1), np.array([int(n.sum()).bit_length() for _, n in counted], dtype=np.int64)


def unit_vectors(batches, encoder: Encoder):
    """(batch, unit vectors of its texts, length classes), in blocks of texts."""
    for batch, texts in slices(batches, "text", 1 << 20):
        for at in range(0, len(texts), 256):
            yield batch.slice(at, 256), *encoder.bundle([t.decode() for t in texts[at : at + 256]])


def blocks(texts: list[str], rows: int = 256, chars: int = 1 << 20):
    """The texts in blocks of bounded rows and, but for single texts, bounded size."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= rows or size + len(t) > chars):
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


@dataclass
class Model:
    prototypes: dict[str, np.ndarray]
    floors: np.ndarray  # by length class


def best(vectors: np.ndarray, classes: np.ndarray, model: Model) -> list[tuple[str, float, bool]]:
    """Each vector's language, score and whether it is of a known language."""
    names, out = sorted(model.prototypes), [("und", 0.0, False)] * len(vectors)
    some = np.flatnonzero(vectors.any(axis=1))
    if not names:
        for i in some:
            out[i] = ("und", 0.0, True)
    elif len(some):
        cosines = vectors[some] @ np.array([model.prototypes[n] for n in names], dtype=np.float32).T
        odds = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
        known = cosines.max(axis=1) >= model.floors[classes[some]]
        for i, k, s, x in zip(some, cosines.argmax(axis=1), 1 / odds.sum(axis=1), known, strict=True):
            out[i] = (names[k], float(s), bool(x))
    return out


def floors(sample: DataFrame, prototypes: dict[str, np.ndarray]) -> np.ndarray:
    """The least cosine of a known language, by length class; sample (text)."""
    out = np.full(64, -np.inf)
    if not prototypes:
        return out
    every = np.array(list(prototypes.values()))

    def work(batches):
        encoder = Encoder()
        for batch, vectors, classes in unit_vectors(batches, encoder):
            yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array((vectors @ every.T).max(axis=1).astype(np.float64))], ["class", "cosine"])

    rows = sample.select("text").mapInArrow(releasing(work), "class long, cosine double").where("class > 0").groupBy("class").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()
    found = {r["class"]: r for r in rows}
    for k in range(64):
        n, least = 0, np.inf
        for r in (found[x] for x in range(k, 0, -1) if x in found):
            n, least = n + r["n"], min(least, r["least"])
            if n >= LEAST_TEXTS:
                out[k] = MARGIN * least
                break
    return out


def fit(training: DataFrame) -> Model:
    """Of training rows (id, text, lang): each language's prototype, a unit vector, and the floors."""
    known = training.where("lang is not null and text is not null")
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PER_LANGUAGE))
    chosen = known.groupBy("lang", place.alias("place")).agg(F.min_by("id", F.xxhash64("id", F.lit(2))).alias("id")).select("lang", "id")
    chosen = written(chosen)
    sample = known.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, ["lang", "id"], "left_semi")
    sample = written(sample.select("lang", "text"))

    def work(batches):
        encoder, sums = Encoder(), {}
        for batch, vectors, _ in unit_vectors(batches, encoder):
            for lang, v in zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), vectors, strict=True):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "sums"])

    parts = sample.select("lang", "text").mapInArrow(releasing(work), "lang string, sums array<double>")
    summed = parts.select("lang", F.posexplode("sums").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("s")).collect()
    out = {r.lang: np.array([x.v for x in r.s]) for r in rows}
    prototypes = {lang: (v / np.linalg.norm(v)).astype(np.float32) for lang, v in sorted(out.items()) if np.linalg.norm(v) > 0}
    return Model(prototypes, floors(sample, prototypes))


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df (id, text, ...) -> (id, lang_pred, score, known)."""

    def work(batches):
        encoder = Encoder()
        for batch, vectors, classes in unit_vectors(batches, encoder):
            found = best(vectors, classes, model)
            langs, scores, known = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], ["id", "lang_pred", "score", "known"])

    return df.select("id", "text").mapInArrow(releasing(work), "id long, lang_pred string, score double, known boolean")


def with_language(df: DataFrame, model: Model, into: str, text_col: str = "text") -> DataFrame:
    """df with the column `into`: (lang, score, known)."""

    @F.pandas_udf("struct<lang: string, score: double, known: boolean>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder()
        for texts in batches:
            out = [x for some in blocks(texts.fillna("").tolist()) for x in best(*encoder.bundle(some), model)]
            yield pd.DataFrame(out, columns=["lang", "score", "known"])
        del encoder
        release()

    return in_small_batches(df).withColumn(into, judge(df[text_col].cast("string")))


def held_out(id_col) -> F.Column:
    """crc32 of the id as text, mod 4, is 2; these rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def plain(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    columns = [df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text")]
    return in_small_batches(df).select(*columns, *([df[lang_col].cast("string").alias("lang")] if lang_col else []))


def identify_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of df: id, held_out, lang_pred, score, known."""
    rows = plain(df, id_col, text_col, lang_col)
    model = fit(rows.where(~held_out(F.col("id")) & F.col("id").isNotNull()))
    out = predict(rows, model)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "known")
