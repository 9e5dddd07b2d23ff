"""Per-author aggregation of self-identifications by majority, and the enrichment of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import age

SEPARATOR = "|"


def majority_item(df: DataFrame, key: str, column: str, order: tuple[str, ...]) -> DataFrame:
    """(key, column): the most frequent item of ``|``-joined values; ties go to the item seen first by ``order``.

    Counts are combined before the shuffle; only one row per (key, item) meets in a task.
    """
    items = df.where(F.col(key).isNotNull()).select(key, *order, F.posexplode(F.split(column, r"\|")).alias("_at", "_item"))
    items = items.withColumn("_item", F.trim("_item")).where("_item <> ''")
    per = items.groupBy(key, "_item").agg(F.count("*").alias("_n"), F.min(F.struct(*order, "_at")).alias("_seen"))
    return per.groupBy(key).agg(F.min_by("_item", F.struct((-F.col("_n")).alias("n"), "_seen")).alias(column))


def mode(column: str) -> Column:
    """Most frequent value; ties go to the smallest, NULLs and empty texts do not count."""
    return F.mode(F.nullif(F.col(column), F.lit("")), deterministic=True)


def aggregate_users(df: DataFrame, *, year: Column, order: tuple[str, ...], key: str = "Author", confidence: float = 0.5) -> DataFrame:
    """One row per author: birth year re-resolved from all raw extractions with the latest year, majorities of the rest.

    ``df`` has ``|``-joined raw columns, as the users table is stored. Authors that are NULL form no group.
    """
    raw = [c for c in df.columns if c.startswith("DMG") and "Raw" in c and c != "DMGRawBirthyearExtractions"]
    other = [c for c in df.columns if c.startswith("DMG") and c not in raw and c not in ("DMGRawBirthyearExtractions", "DMGMajorityBirthyear")]
    rows = df.where(F.col(key).isNotNull()).withColumn("_year", year)
    births = F.filter(F.transform(F.split(F.coalesce("DMGRawBirthyearExtractions", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("_births", births)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_births"))), lambda x: x["_births"])
    out = rows.groupBy(key).agg(F.max("_year").alias("_year"), F.flatten(listed).alias("_births"), *[mode(c).alias(c) for c in other])
    sure = age.resolve(F.col("_births"), F.col("_year"))
    out = out.withColumn("_age", sure).select(
        key,
        F.when(F.col("_age.confidence") >= confidence, F.col("_year") - F.col("_age.age")).alias("DMGMajorityBirthyear"),
        F.when(F.size("_births") > 0, F.array_join(F.array_sort(F.array_distinct("_births")), SEPARATOR)).alias("DMGRawBirthyearExtractions"),
        *other,
    )
    for c in raw:
        out = out.join(majority_item(df, key, c, order), key, "left")
    return out.select(key, *[c for c in df.columns if c.startswith("DMG")])


def enrich(posts: DataFrame, users: DataFrame, *, year: Column, keep_unknown_age: bool, key: str = "Author") -> DataFrame:
    """Posts of known users with their demographics and DMGAgeAtPost; ages outside 13 to 99 are dropped.

    Where the birth year is unknown the post goes, or stays with NULL age under ``keep_unknown_age``. Of several rows of
    a user the least one with a known birth year counts.
    """
    rest = [c for c in users.columns if c != key]
    users = users.groupBy(key).agg(F.min(F.struct(F.col("DMGMajorityBirthyear").isNull().alias("_unknown"), *rest)).alias("_user")).select(key, *[F.col(f"_user.`{c}`") for c in rest])
    out = posts.join(users, key).withColumn("DMGAgeAtPost", (year - F.col("DMGMajorityBirthyear").try_cast("int")).cast("int"))
    good = F.col("DMGAgeAtPost").between(age.LOW, age.HIGH)
    return out.where(good | F.col("DMGAgeAtPost").isNull() if keep_unknown_age else good)


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order`` (largest city first, and the like)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
