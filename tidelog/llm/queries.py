"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, embedding_dedup, html_text, jaccard, mixing, preference, token_counts, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbours(_table(spark, sf_dir, "conversations")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), jaccard.Rule(k=3, p=90, q=100))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Digests are base32, which DuckDB lacks: 32 letters, each of five bits of the 160.
SQL_WARC = """
WITH d AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
), b AS (
  SELECT *, list_transform(range(20), lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::UTINYINT::BIGINT) AS x FROM d
)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((x[(5 * j) // 8 + 1] * 256 + coalesce(x[(5 * j) // 8 + 2], 0)) >> (11 - (5 * j) % 8)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_token_counts": op3_token_counts,
        "op4_warc": op4_warc,
        "op5_preference": op5_preference,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_mixing": op7_mixing,
        "op8_url_filter": op8_url_filter,
        "op9_html_text": op9_html_text,
        "op10_decontamination": op10_decontamination,
    }
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op5_preference": preference.SQL, "op4_warc": SQL_WARC}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
