"""The registered queries of the operators of this package, and SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    archives, conversations, decontaminate, importance, jaccard_join, language, licenses, packing, pitman_yor, quality,
    sql, suffix_dedup, token_counts, token_files,
)
from .staging import small_batches, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """True for documents held out; a NULL id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 1, F.lit(False))


@query
def op1_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path(VOCABULARY), with_ids=False, with_crc32=True)
    return packing.pack(pieces)


@query
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = docs.select("doc_id", quality.judge("text", field).alias("j"))
    return judged.select("doc_id", *(f"j.{c}" for c in quality.COUNTS), "j.base_failed", "j.kept", "j.n_lines", "j.content_lines", "j.content_words")


@query
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold(3).alias("held_out"))
    kernel = language.fit(language.labelled_sample(docs.filter(~F.col("held_out")), "text", "lang"))
    found = docs.select("doc_id", "held_out", language.predict("text", kernel).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query
def op3_warc_zip(spark, sf_dir):
    return archives.round_trip(table(spark, sf_dir, "pages")).select(*archives.RECORD_COLUMNS)


SQL["op3_warc_zip"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS low FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > low THEN low END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query
def op5_token_counts(spark, sf_dir):
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op6_license_scan(spark, sf_dir):
    return licenses.license_matches(table(spark, sf_dir, "documents"))


SQL["op6_license_scan"] = licenses.license_sql()


@query
def op7_ngram_jaccard_join(spark, sf_dir):
    joined = jaccard_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


@query
def op10_suffix_array_dedup(spark, sf_dir):
    cleaned = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = (f"_dedup.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    return cleaned.select("doc_id", *counts, F.col("_dedup.kept").alias("text"))


@query
def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_pitman_yor_scoring(spark, sf_dir):
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"), fold(5))


@query
def op11_importance_resampling(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


SQL["op11_importance_resampling"] = sql.resampling_sql()


@query
def op12_token_files(spark, sf_dir):
    path = workspace(spark).child(f"token-files-{uuid.uuid4().hex}")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_VOCABULARY), end_id=1)
    return token_files.token_digests(token_files.read_tokens(spark, path))


@query
def op13_conversation_repair(spark, sf_dir):
    return conversations.repair(table(spark, sf_dir, "conversations"))


SQL["op13_conversation_repair"] = sql.repair_sql()
