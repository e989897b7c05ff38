"""The training-data queries: name -> function of (spark, sf_dir), and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from symdiff.llm.alignment import align_documents
from symdiff.llm.common import table
from symdiff.llm.html import extract_text
from symdiff.llm.langid import identify_language
from symdiff.llm.lines import LINES_SQL, line_dedup
from symdiff.llm.minhash import near_dedup
from symdiff.llm.negatives import NEGATIVES_SQL, mine_hard_negatives
from symdiff.llm.packing import pack
from symdiff.llm.pivots import embedding_near_dedup
from symdiff.llm.quality import judge_quality
from symdiff.llm.secrets import scan_secrets
from symdiff.llm.sentencepiece import encode_documents
from symdiff.llm.toxicity import score_toxicity
from symdiff.llm.urls import filter_sql, filter_urls


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_quality_rules(spark, sf_dir):
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents"), words=3, percent=85)


def op7_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op8_language_id(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_embedding_near_dedup(spark, sf_dir):
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op11_hard_negative_mining(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_tokenizer_alignment(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_line_dedup(spark, sf_dir):
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_packing, op3_quality_rules, op4_url_filters, op5_toxicity, op6_minhash_near_dedup, op7_html_extraction, op8_language_id, op9_sentencepiece, op10_embedding_near_dedup, op11_hard_negative_mining, op12_tokenizer_alignment, op13_line_dedup)}
ORACLES: dict[str, str] = {"op4_url_filters": filter_sql(), "op11_hard_negative_mining": NEGATIVES_SQL, "op13_line_dedup": LINES_SQL}
