"""Registered queries of the corpus operators and their SQL.

An operator has one query with all its results. Where SQL can express a part of them only, a
second query of that part stands beside it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import blocks, bpe, decontaminate, jaccard, langid, licenses, lines, phrases, pii, postings, quality, repeats, sql, tiff, trie
from .common import held_out, table, written

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A fixed key, so that the query's results repeat; callers pass their own.
PSEUDONYM_KEY = "registered-query"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), RANK_FILE)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines_dropped", F.octet_length("text").cast("bigint").alias("n_bytes_left"), F.sha2("text", 256).alias("text_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.license_scan(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.tiff_pages(tiff.tiff_encode(table(spark, sf_dir, "documents")))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings.store_index(table(spark, sf_dir, "documents"))
    return decontaminate.contamination(postings.search(index, table(spark, sf_dir, "benchmark")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    scored = quality.score(stats, quality.train(stats, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = blocks.remove_repeated_words(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("digest", "parent")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the license scan that rest on exact phrases."""
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def tiff_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the media query that rest on the samples as they are read back."""
    return op8_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


OPERATORS = (op1_ngram_jaccard, op2_pii_pseudonyms, op3_bpe, op4_suffix_dedup, op5_line_templates, op6_license_scan, op7_language_id, op8_tiff, op9_decontamination, op10_quality, op11_block_dedup, op12_phrases, op13_prefix_trie)
QUERIES = {f.__name__: f for f in (*OPERATORS, license_base, tiff_payload)}
SQL = {"op1_ngram_jaccard": sql.NGRAM_JACCARD, "op4_suffix_dedup": sql.SUFFIX_DEDUP, "op9_decontamination": sql.DECONTAMINATION, "license_base": sql.LICENSE_BASE, "tiff_payload": sql.TIFF_PAYLOAD}
SQL |= {"op11_block_dedup": sql.BLOCK_DEDUP, "op12_phrases": sql.PHRASES, "op13_prefix_trie": sql.TRIE}
