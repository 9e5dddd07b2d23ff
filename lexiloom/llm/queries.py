"""The queries of the training-data operators, and their SQL where SQL can express them.

Each query reads a whole table, applies its operator with production settings and returns its full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, license_scan, line_dedup, lm_score, media_ts, packing, quality_crf, simhash_dedup, substring_dedup, token_output
from lexiloom.llm.common import scratch


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole texts and of whole lines."""
    found = license_scan.scan(documents(spark, sf_dir))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text."""
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir), scratch(spark, "trie"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality_crf.score(docs, model)
    return found.select("doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.write_tokens(documents(spark, sf_dir), scratch(spark, "token-files"))
    return token_output.read_tokens(spark, files)


def op8_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.media_features(media_ts.store_media(documents(spark, sf_dir))).drop("pts", "random_access")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated paragraph, with its class and the document that keeps it."""
    return substring_dedup.repeated_paragraphs(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_line_dedup, op4_simhash_dedup, op5_lm_score, op6_quality_crf, op7_token_output, op8_media_ts, op9_substring_dedup, op10_packing)}


def _license_sql() -> str:
    def canonical(x: str) -> str:
        x = f"lower({x})"
        for pattern, new in license_scan.STEPS:
            new = new.replace("${1}", "\\1").replace("'", "''")
            pattern = pattern.replace("'", "''")
            x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')" if new != "\n" else f"regexp_replace({x}, '{pattern}', chr(10), 'g')"
        return f"trim({x})"

    known = ", ".join(f"('{d}', '{n}')" for d, n in license_scan.known_digests())
    return f"""
WITH known(known, license) AS (VALUES {known}),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit FROM documents),
hit AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS license_lines
        FROM (SELECT doc_id, sha256({canonical("unit")}) AS known FROM line WHERE {canonical("unit")} <> '') l JOIN known USING (known) GROUP BY doc_id),
whole AS (SELECT doc_id, CASE WHEN {canonical("coalesce(text, '')")} <> '' THEN sha256({canonical("coalesce(text, '')")}) END AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license AS document_license, coalesce(h.line_licenses, '') AS line_licenses, coalesce(h.license_lines, 0) AS license_lines
FROM whole w LEFT JOIN known k ON k.known = w.digest LEFT JOIN hit h USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql()}
