"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents; the last
one returns the pieces of the packed sequences. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symdiff.llm import langid, minhash, toxicity
from symdiff.llm.common import free_name, table, written
from symdiff.llm.packing import pack
from symdiff.llm.queries import tokenizer_file
from symdiff.llm.secrets import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: those without a letter, null, empty, or unlike every language learned.

    Where no document has a language, only those without a letter go. Repeated rows and rows without an id are each judged
    by their text; other columns stay as they are.
    """
    rows = langid.plain(docs, "doc_id", "text", "lang")
    model = langid.fit(rows.where(~langid.held_out(F.col("id")) & F.col("id").isNotNull()))
    judged = free_name(docs, "judged")
    return langid.with_language(docs, model, judged).where(F.col(judged)["known"]).drop(judged)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: those with a score of 0.5 or more.

    Null and empty texts stay unless most of what is labelled is toxic; without labels of both classes all stay. Repeated
    rows and rows without an id are each judged by their text; other columns stay as they are.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    model = toxicity.fit(toxicity.plain(docs), labels)
    score = free_name(docs, "toxicity")
    return toxicity.with_score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (five-word shingles, 0.8 or more).

    Documents without an id or without words are linked with nothing and stay. Of rows that repeat an id and its text one
    stays; rows of one id with different texts go only together. Other columns stay as they are.
    """
    by_id = minhash.near_dedup(docs, words=5, percent=80).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    some = written(by_id.where("not kept or rows > 1"))
    gone, again = some.where("not kept").select("doc_id"), some.where("kept and rows > 1").select("doc_id")
    if some.count() <= minhash.BROADCAST_IDS:
        gone, again = F.broadcast(gone), F.broadcast(again)
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    once = left.join(again, "doc_id", "left_anti")
    return once.select(docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kinds, and n_chars follows; all documents stay, null texts as null."""
    cleaned = redact_secrets(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; null and empty texts are an end id alone, other columns are not read."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("near_dedup", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: Statistical stages and packing can't be expressed in SQL; the tests compare their operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
