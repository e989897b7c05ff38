"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over BUCKETS hashed unigrams and bigrams are counted: the trusted target (documents labelled as good)
and the raw corpus (all documents). A document's mean log ratio of its n-grams' probabilities (so its length doesn't
matter) is compared with a fixed threshold: the LOST share of the scores of trusted documents that the target was not
counted from lies below it. Whoever is at least at the threshold is kept; nothing is drawn at random.

Every labelled-good document is used, by hash of its id: half make the target, half the threshold. The counts of all
documents are pre-aggregated before they are shuffled, one row per bucket; these BUCKETS rows are all that reaches the
driver, and go back as one array constant. Scoring is row-local.

Defined results: words are runs of anything but ASCII white space; a null or empty text has no words and is not kept; a
row with a null id is judged like any other but trusted by no label; without trusted documents every score is 0 and the
base rules decide; repeated rows are each judged; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symdiff.llm.common import written

BUCKETS = 1 << 14
#: Share of the trusted documents that may lie below the threshold.
LOST = 0.002
#: Added to each bucket's count, in both multinomials.
SMOOTHING = 1.0
WINDOW = 5

#: Trusted ids up to this many are sent to every executor instead of shuffling the texts (8 bytes each).
BROADCAST_IDS = 500_000

# The base rules' symbols, limits and white space.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def bound(value: Column, use) -> Column:
    """use(value) with value computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The words; an empty array for a null or blank text."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{BLANK}+"))


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more in the text."""

    def windows(h: Column) -> Column:
        n = F.size(h)
        code = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        return F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - WINDOW), code))

    def covered(w: Column) -> Column:
        """w: window hashes, some of them equal. Equal neighbours after sorting mark the repeated ones."""
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        repeated = lambda s: F.filter(s, lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"]))
        starts = bound(placed, lambda s: F.array_sort(F.transform(repeated(s), lambda e: e["i"])))
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound(bound(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_like(x, F.lit(NOT_BLANK)))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def buckets_of(words: Column) -> Column:
    """Hashed unigrams, then bigrams, of lower-cased words."""

    def both(h: Column) -> Column:
        place = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
        pairs = F.transform(h, lambda x, i: F.when(i > 0, place(F.xxhash64(F.get(h, i - 1), x))))
        return F.concat(F.transform(h, lambda x: place(F.xxhash64(x, F.lit(1)))), F.slice(pairs, 2, F.greatest(F.size(h) - 1, F.lit(0))))

    return bound(F.transform(words, lambda w: F.xxhash64(F.lower(w))), both)


def base_rules(df: DataFrame) -> DataFrame:
    """df (id, text) -> id, words, n_words and the four base figures."""
    text = F.coalesce("text", F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    chars = F.length(F.translate(text, BLANKS, ""))
    return df.select("id", words_of(F.col("text")).alias("words"), "text").select(
        "id", "words", F.size("words").cast("bigint").alias("n_words"), chars.cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id, half) of all documents that labels (id, quality) call good; the greatest label of an id counts."""
    good = written(labels.where("id is not null and quality > 0").select("id").distinct().withColumn("half", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(2))))
    return F.broadcast(good) if good.count() <= BROADCAST_IDS else good


def ratios(df: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket. df (id, text): all documents; trusted (id): the trusted ones among them."""
    marked = df.join(trusted.select("id", F.lit(1).alias("good")), "id", "left")
    grams = marked.select("good", F.explode(buckets_of(words_of(F.col("text")))).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()
    target, raw = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for r in rows:
        target[r.bucket] += r.target
        raw[r.bucket] += r.raw
    if not any(r.target for r in rows):
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def likelihood_ratio(words: Column, weights: np.ndarray) -> Column:
    """Mean log ratio of the n-grams of words; 0 without words."""
    table = F.lit(weights)
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(b)
    return bound(buckets_of(words), lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(total(b)))


def judge_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of df: id, n_words, the base figures, base_failed, kept, and the method's score."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    trusted = trusted_ids(labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("quality")))
    weights = ratios(rows, trusted.where("half = 0"))
    own = rows.join(trusted.where("half = 1"), "id", "left_semi").select(likelihood_ratio(words_of(F.col("text")), weights).alias("score"))
    threshold = own.agg(F.percentile("score", F.lit(LOST))).first()[0]
    judged = base_rules(rows).withColumn("score", likelihood_ratio(F.col("words"), weights)).drop("words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("score") >= (0.0 if threshold is None else threshold))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "score")
