"""Row filters for posts. Conjuncts are written from cheap to expensive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import is_blank, word_count

#: Fixed values.
NO_AUTHORS = ("", "[deleted]", "AutoModerator", "Bot")
IMAGES = r"\.(jpg|png|jpeg|gif)\z"


def has_media(url: Column, is_video: Column) -> Column:
    return F.coalesce(is_video, F.lit(False)) | F.coalesce(F.lower(url).rlike(IMAGES), F.lit(False))


def keep_post(split: str | None = "text", low: int = 5, high: int = 1000, text: str = "selftext") -> Column:
    """Not adult, not promoted, low to high words; split "text" without media, "multimodal" with. NULL text: rejected."""
    false = F.lit(False)
    keep = ~F.coalesce(F.col("over_18"), false) & ~F.coalesce(F.col("promoted"), false) & ~F.coalesce(F.col("whitelist_status") == "promo_specified", false)
    if split == "text":
        keep &= ~has_media(F.col("url"), F.col("is_video"))
    elif split == "multimodal":
        keep &= has_media(F.col("url"), F.col("is_video"))
    return keep & ~is_blank(F.col(text)) & F.coalesce(word_count(F.col(text)), F.lit(0)).between(low, high)


def keep_author(author: str = "author") -> Column:
    return F.col(author).isNotNull() & ~F.col(author).isin(*NO_AUTHORS)


def of_authors(posts: DataFrame, users: DataFrame, key: str = "Author") -> DataFrame:
    """Posts of known users: a semi-join, planned by size."""
    return posts.join(users.select(key).distinct(), key, "left_semi")
