"""N-gram tables: parse, clean, count, global top K, semi-join, annotate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import strip_pos_tags
from lexiloom.operators import features

SIZE, TOP = 5, 1_000_000


def parse(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(ngram, year, match_count, book_count) and the columns ``keep`` of lines with exactly four tab-separated fields and three integers."""
    # exploded as an array of one, so the line is split once: a filter on the expression itself would split it again for every column
    rows = lines.select(F.explode(F.array(F.split(column, "\t"))).alias("_f"), *keep).where("size(_f) = 4")
    number = lambda i, kind: F.trim(F.get("_f", i)).try_cast(kind)
    rows = rows.select(F.get("_f", 0).alias("ngram"), number(1, "int").alias("year"), number(2, "bigint").alias("match_count"), number(3, "bigint").alias("book_count"), *keep)
    return rows.where("year is not null and match_count is not null and book_count is not null")


def clean(df: DataFrame, size: int = SIZE) -> DataFrame:
    """With ngram_cleaned (no part-of-speech tags); only n-grams of ``size`` words stay."""
    # nearly all are ASCII words with a tag at most, parted by single blanks: one look finds, counts and strips these, and marks them by a tab
    word = "([!-^`-~]++)(?:_[!-^`-~]*+)?+"
    plain = F.regexp_replace("ngram", rf"\A{' '.join([word] * size)}\z", "\t" + " ".join(f"${i + 1}" for i in range(size)))
    marked = F.startswith("_p", F.lit("\t")) & ~F.startswith("ngram", F.lit("\t"))
    # exploded as arrays of one: a filter on the expressions themselves would compute them twice
    out = df.select("*", F.explode(F.array(plain)).alias("_p"))
    out = out.select("*", F.explode(F.array(F.when(marked, F.expr("substring(_p, 2)")).otherwise(strip_pos_tags(F.col("ngram"))))).alias("ngram_cleaned"))
    return out.where(marked | F.col("ngram_cleaned").rlike(rf"\A *+(?:[^ ]++ ++){{{size - 1}}}[^ ]++ *+\z")).drop("_p")


def counts(df: DataFrame, ngram: str = "ngram_cleaned") -> DataFrame:
    """(ngram, match_count): exact sums, combined map-side; only positive ones."""
    return df.groupBy(F.col(ngram).alias("ngram")).agg(F.sum("match_count").alias("match_count")).where("match_count > 0")


def top(df: DataFrame, k: int = TOP) -> DataFrame:
    """The k most frequent n-grams; ties by n-gram, descending."""
    return df.orderBy(F.desc("match_count"), F.desc("ngram")).limit(k)


def keep_top(df: DataFrame, best: DataFrame, ngram: str = "ngram_cleaned") -> DataFrame:
    """Rows whose cleaned n-gram is among ``best``, with it as their ngram. The planner picks the join by size."""
    return df.join(best.select(F.col("ngram").alias(ngram)), ngram, "left_semi").withColumn("ngram", F.col(ngram))


def annotate(df: DataFrame, lexicons: features.Lexicons) -> DataFrame:
    """Features of each row's cleaned n-gram; every distinct n-gram is scored once."""
    kinds = df.select("ngram_cleaned").distinct()
    scored = features.annotate(kinds, "ngram_cleaned", lexicons)
    return df.join(scored, "ngram_cleaned")
