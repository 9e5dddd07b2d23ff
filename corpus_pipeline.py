"""A corpus pipeline of five operators: documents in, packed training windows out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. The last returns the packed pieces with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, line_dedup, packing, quality_crf, simhash_dedup
from lexiloom.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field accepts."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, model).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and near-repeated lines; those left empty go."""
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where("n_removed = 0 or text <> ''")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.keep_one(docs).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of training windows."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("decontamination", benchmark_leaks), ("packing", windows)]

#: SQL expresses neither the field, nor banding, nor retrieval; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
