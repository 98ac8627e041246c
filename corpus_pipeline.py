"""The corpus pipeline: quality rules, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthstat.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from hearthstat.llm.queries import VOCABULARY, table
from hearthstat.llm.staging import small_batches, staged
from hearthstat.workspace import configure

ORACLE_SQL = None
SHINGLE_WORDS, NEAR_PERCENT = 5, 80  # the stage's rule; op7 has its own
PASSAGE_WORDS = 50  # a passage has more; op10 goes by 400 bytes instead
PASSAGE_BYTES, PASSAGE_GRAM = 2 * PASSAGE_WORDS + 1, 40  # the shortest passage: words of one letter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole and unchanged."""
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.judge(docs["text"], field)["kept"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at 0.8: the one with the least id, then the least text.

    Rows of one id and one text are one document, of which the row that is least in its other
    columns stays, also without an id; other documents without words are each their own.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", "text", key.alias("_key"))
    joined = jaccard_join.ngram_jaccard_join(keyed, id_col="_key", k=SHINGLE_WORDS, percent=NEAR_PERCENT)
    groups = staged(joined.select("_key", "component_id").distinct(), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key"))
    ids = docs.select(key.alias("_key"), "doc_id").join(groups, "_key")
    kept = ids.groupBy("component_id").agg(least.alias("_least")).select("_least._key")
    single = docs.groupBy(key.alias("_key")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return single.join(kept, "_key", "left_semi").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of more than 50 words, or of op10's 400 bytes; ``n_chars`` follows the text.

    Strings are sought at the fewest bytes that hold 51 words; repeats that overlap in a text are
    one span, which goes if it has the words or the bytes.
    """
    cleaned = suffix_dedup.deduplicated(docs, over_words=PASSAGE_WORDS, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, sift=True)
    changed = F.col("_dedup.n_removed") > 0
    columns = {"text": F.when(changed, F.col("_dedup.kept")).otherwise(F.col("text"))}
    columns["n_chars"] = F.when(changed, F.length("_dedup.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.select(*(columns.get(c, F.col(c)).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and place."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(VOCABULARY), with_crc32=True, with_ids=False))


def _stage(function):
    @functools.wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(small_batches(configure(spark)), docs, sf_dir)

    return stage


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("n-gram Jaccard join", _stage(near_copies)),
    ("suffix-array dedup", _stage(repeated_passages)),
    ("benchmark decontamination", _stage(benchmark_leaks)),
    ("best-fit packing", _stage(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "_"))
    return docs
