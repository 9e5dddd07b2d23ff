"""End-to-end plans of the other corpora: n-grams, generated text, feeds, and the merge of everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.operators import features, merge, ngrams
from lexiloom.sources import readers, sinks


def top_ngrams(spark: SparkSession, path: str, k: int = ngrams.TOP) -> DataFrame:
    """Global top K over all files: exact counts, one shuffle of partial sums."""
    return ngrams.top(ngrams.counts(ngrams.clean(readers.ngram_lines(spark, path))), k)


def annotated_top_ngrams(spark: SparkSession, path: str, lexicons: features.Lexicons, k: int = ngrams.TOP) -> DataFrame:
    """Rows of the top K n-grams with features; only survivors are scored, each n-gram once."""
    rows = ngrams.clean(readers.ngram_lines(spark, path))
    kept = ngrams.keep_top(rows, ngrams.top(ngrams.counts(rows), k))
    return ngrams.annotate(kept, lexicons).drop("ngram_cleaned")


def generated_text(spark: SparkSession, path: str, dataset: str, lexicons: features.Lexicons) -> DataFrame:
    df, columns = readers.generated(spark, path, dataset)
    return features.annotate_columns(df, columns, lexicons)


def feed_texts(spark: SparkSession, path: str, lexicons: features.Lexicons, max_files: int | None = None) -> DataFrame:
    return features.annotate(readers.feeds(spark, path, max_files), "description", lexicons).drop("item_no")


def merged(spark: SparkSession, paths: list[str], out: str, prefix: str = "id", by_month: bool = False) -> None:
    """Read TSV outputs leniently and write one typed parquet table."""
    inputs = {p: readers.table(spark, p, lenient=True) for p in paths}
    sinks.parquet(merge.merge(inputs, prefix), out, by_month)
