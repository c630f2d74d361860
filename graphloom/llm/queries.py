"""Queries of the corpus operators over whole tables, and SQL twins where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, licenses, packing, phrase_dedup, simhash, suffix_dedup, tokens, topk, toxicity
from .common import documents, table


def tokenizer_path() -> str:
    """The tokenizer file; GRAPHLOOM_TOKENIZER names another one."""
    return os.environ.get("GRAPHLOOM_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every row of documents before and after redaction; null and empty texts have none."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of each row whose vec_id is divisible by 50; ties to the smaller vec_id, rows with nulls take no part."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with each item of benchmark of which it holds a passage; null and empty texts match nothing, repeated rows each."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of documents, null and empty texts too; equal texts have equal scores."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of documents; null texts are empty, rows without a doc_id have no component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every row of documents that a smaller doc_id has too; null texts have no words, ties of doc_id remove nothing."""
    kept = phrase_dedup.remove_phrases(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of phrases and matches of templates in every row of documents; null texts are empty, repeated rows each."""
    return licenses.scan(documents(table(spark, sf_dir, "documents")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every row of documents in strings of 400 bytes that start anywhere else; null texts are empty, repeated rows repeat each other.

    n_passage_words tells of passages of over 50 words that other documents have too, also where they have fewer bytes; they are not removed.
    """
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=51)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return kept.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages; null and empty html have an empty one, repeated rows each."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece of every row of documents; null texts are empty, repeated rows are packed once each."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_phrase_dedup": op6_phrase_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op2_exact_topk": """
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q, e r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op7_license_scan": licenses.ORACLE,
}
