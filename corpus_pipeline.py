"""Corpus preparation: five stages over ``documents``, each written and read again.

1. language ID: documents without a language, or in which no language has most of the letters, go;
2. line dedup: recurring template lines go, documents stay;
3. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays;
4. benchmark decontamination: documents with a benchmark passage go;
5. byte-level BPE: every document left is encoded, and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import bpe, decontaminate, jaccard, langid, lines
from palimpsest.llm.common import bounded_batches, table, written
from palimpsest.llm.queries import RANK_FILE

#: Share of a document's letters that its language must have.
LANGUAGE_SHARE = 0.5


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents with other names for all columns but key and text, so that no operator's result
    can replace one, and the way back."""
    back = {f"column_{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    aside, back = _aside(docs)
    found = langid.identify(aside, langid.train(docs), keep=tuple(aside.columns))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).select(*aside.columns).withColumnsRenamed(back).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    aside, back = _aside(docs)
    cut = lines.drop_recurring_lines(aside).select(*aside.columns).withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("bigint"))
    return cut.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    aside, back = _aside(docs)
    matches = decontaminate.phrase_matches(aside, table(spark, sf_dir, "benchmark"), keep=tuple(aside.columns))
    return matches.where(F.size("hit_spans") == 0).select(*aside.columns).withColumnsRenamed(back).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    coded = bpe.bpe_round_trip(docs, RANK_FILE)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", token_stage),
]

#: SQL cannot express the learned first stage; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
