"""The row-local operators on streams: filters, detection and personal data need no state.

Counts of statements per window keep state for as long as the watermark allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators import filters
from lexiloom.operators.detect import Terms
from lexiloom.plans import social
from lexiloom.sources.readers import parsed_posts


def post_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of submissions under ``path``."""
    return parsed_posts(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def identified_posts(stream: DataFrame, terms: Terms, split: str | None = "text") -> DataFrame:
    return social.post_users(stream, terms, split=split)


def kept_per_window(stream: DataFrame, window: str = "1 day", late: str = "2 days", split: str | None = "text") -> DataFrame:
    """Kept posts per window of their creation time."""
    timed = stream.where(filters.keep_post(split)).withColumn("at", F.timestamp_seconds(F.col("created_utc").try_cast("bigint"))).where("at is not null")
    return timed.withWatermark("at", late).groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Parquet files, exactly once by the checkpoint; ``once`` takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
