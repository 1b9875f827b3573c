"""The queries opN_* of the text operators, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_fingerprint, exact_dedup, license_scan, mixing, ngram_join, quality_rules, suffix_dedup, token_counts, unigram, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_license_scans(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op5_document_fingerprints(spark, sf_dir):
    return edit_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score(docs, model).select("doc_id", quality_rules.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_source_mixing(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark, sf_dir):
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op9_sentencepiece(spark, sf_dir):
    return unigram.encode_decode(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.QUERY_SQL,
        "op2_exact_dedup": EXACT_DEDUP_SQL,
        "op3_license_scans": license_scan.query_sql(),
        "op4_ngram_jaccard_join": ngram_join.QUERY_SQL,
        "op7_source_mixing": mixing.QUERY_SQL,
    }
