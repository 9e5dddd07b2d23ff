"""Posts and short messages in two stages: users that identify themselves, then all posts of these users with features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom import schema
from lexiloom.functions import age
from lexiloom.functions.text import clean_newlines, created_at_year, epoch_year, id_text
from lexiloom.operators import demographics, features, filters, pii
from lexiloom.operators.detect import Terms, any_match, detected


def post_text() -> Column:
    """Title and body of a post; NULLs are empty."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))


def renamed_post() -> list[Column]:
    plain = {"PostID": "id", "PostSubreddit": "subreddit", "PostCreatedUtc": "created_utc", "PostScore": "score", "PostNumComments": "num_comments", "PostPermalink": "permalink", "PostUrl": "url"}
    own = {n: F.col(c) for n, c in plain.items()} | {"PostTitle": clean_newlines(F.coalesce("title", F.lit(""))), "PostSelftext": clean_newlines(F.col("selftext")), "PostMediaPath": F.lit(None).cast("string")}
    return [own[n].alias(n) for n in schema.POST_COLUMNS]


def renamed_message(split: str) -> list[Column]:
    own = {"PostID": "TweetID", "PostText": "Tweet", "PostCreatedAt": "createdAt", "PostYear": "Year", "PostMonth": "Month", "PostCity": "City", "PostCountry": "Country", "PostMyCountry": "MyCountry", "PostPlace": "Place", "PostPlaceID": "PlaceID", "PostPlaceType": "PlaceType"}
    return [F.col(own[n]).alias(n) for n in schema.message_columns(split)]


def message_year() -> Column:
    return F.coalesce(id_text(F.col("Year")).try_cast("int"), created_at_year(F.col("createdAt")))


def _lookup(raw: Column, table: dict[str, str]) -> Column:
    """Values of array elements in a small dictionary held as a map (bounded by PATTERN_TERMS)."""
    if not table:
        return F.transform(raw, lambda x: F.lit(None).cast("string"))
    return F.transform(raw, lambda x: F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x))


def identified(df: DataFrame, text: Column, year: Column, terms: Terms, maps: dict[str, dict[str, str]] | None = None, *, require_age: bool = False) -> DataFrame:
    """Rows with at least one statement, and their demographic columns (arrays).

    ``maps``: city to country, religion to main religion and to category, occupation to title, keys in lower case
    with the adherents' forms of religions; for large dictionaries leave them out and use ``operators.detect.mapped``.
    """
    maps = maps or {}
    df = detected(df, text, terms).withColumn("_year", year)
    df = df.where(F.size("_found.age") > 0 if require_age else any_match(F.col("_found")))
    df = df.withColumn("_age", age.resolve(F.col("_found.age"), F.col("_year")))
    low = lambda c: F.transform(F.col(f"_found.{c}"), F.lower)
    cities = maps.get("city", {})
    raw = {c: low(c) for c in ("age", "gender", "city", "country", "religion", "occupation")}
    if cities:
        raw["city"] = F.filter(raw["city"], lambda x: x.isin(*cities))
    lower_values = lambda xs: F.transform(xs, F.lower)
    names = dict(zip(("age", "gender", "city", "country", "religion", "occupation"), ("DMGRawExtractedAge", "DMGRawExtractedGender", "DMGRawExtractedCity", "DMGRawExtractedCountry", "DMGRawExtractedReligion", "DMGRawExtractedOccupation"), strict=True))
    cols = {n: raw[c] for c, n in names.items()}
    cols["DMGCountryMappedFromExtractedCity"] = lower_values(_lookup(raw["city"], cities))
    cols["DMGMainReligionMappedFromExtractedReligion"] = lower_values(_lookup(raw["religion"], maps.get("religion", {})))
    cols["DMGMainCategoryMappedFromExtractedReligion"] = lower_values(_lookup(raw["religion"], maps.get("category", {})))
    cols["DMGSOCTitleMappedFromExtractedOccupation"] = lower_values(_lookup(raw["occupation"], maps.get("occupation", {})))
    cols["DMGMajorityBirthyear"] = age.majority_birthyear(F.col("_found.age"), F.col("_age"), F.col("_year"))
    cols["DMGRawBirthyearExtractions"] = F.transform(age.birthyears(F.col("_found.age"), F.col("_year")), lambda y: y.cast("string"))
    return df.withColumns(cols).drop("_found", "_age", "_year")


def post_users(posts: DataFrame, terms: Terms, maps=None, *, split: str | None = "text", low: int = 5, high: int = 1000, require_age: bool = False) -> DataFrame:
    """Stage 1 of posts: one row per self-identifying post."""
    kept = posts.where(filters.keep_author()).where(filters.keep_post(split, low, high))
    found = identified(kept, post_text(), epoch_year(F.col("created_utc")), terms, maps, require_age=require_age)
    out = found.select(F.col("author").alias("Author"), *schema.BIRTH, *schema.DEMOGRAPHICS, *renamed_post())
    return out.select(*schema.users_columns("posts"))


def message_users(messages: DataFrame, terms: Terms, maps=None, *, split: str = "country", require_age: bool = False) -> DataFrame:
    """Stage 1 of short messages: no length or author filter."""
    found = identified(messages, F.coalesce("Tweet", F.lit("")), message_year(), terms, maps, require_age=require_age)
    return found.select("Author", *schema.BIRTH, *schema.DEMOGRAPHICS, *renamed_message(split))


def stored_form(users: DataFrame) -> DataFrame:
    """Arrays as ``|``-joined text, as the users table is written."""
    joined = {n: F.array_join(F.col(n), "|") for n, t in users.dtypes if t.startswith("array")}
    return users.withColumns(joined)


def user_table(users: DataFrame, source: str) -> DataFrame:
    """One row per author from the stored users table."""
    if source == "posts":
        year, order = epoch_year(F.col("PostCreatedUtc")), ("PostCreatedUtc", "PostID")
    else:
        year, order = F.coalesce(id_text(F.col("PostYear")).try_cast("int"), created_at_year(F.col("PostCreatedAt"))), ("PostCreatedAt", "PostID")
    slim = users.select("Author", *[c for c in users.columns if c.startswith("DMG")], *order, *(["PostYear"] if source != "posts" else []))
    return demographics.aggregate_users(slim, year=year, order=order)


def user_posts(posts: DataFrame, users: DataFrame, lexicons: features.Lexicons, *, split: str | None = "text", low: int = 5, high: int = 1000) -> DataFrame:
    """Stage 2 of posts: filtered posts of known users; without a birth year they are dropped."""
    kept = posts.where(filters.keep_post(split, low, high)).withColumn("Author", F.col("author"))
    kept = demographics.enrich(kept, users, year=epoch_year(F.col("created_utc")), keep_unknown_age=False)
    out = features.annotate(kept.withColumn("_text", post_text()), "_text", lexicons)
    made = features.feature_names(lexicons.categories)
    return out.select("Author", "DMGAgeAtPost", *renamed_post(), *made, *schema.BIRTH, *schema.DEMOGRAPHICS)


def user_messages(messages: DataFrame, users: DataFrame, lexicons: features.Lexicons, *, split: str = "country") -> DataFrame:
    """Stage 2 of short messages: blank ones are dropped, unknown birth years stay."""
    kept = messages.where("trim(Tweet) <> ''")
    kept = demographics.enrich(kept, users, year=message_year(), keep_unknown_age=True)
    out = features.annotate(kept, "Tweet", lexicons)
    return out.select("Author", "DMGAgeAtPost", *renamed_message(split), *features.feature_names(lexicons.categories), *schema.DEMOGRAPHICS)


def post_pii(posts: DataFrame, *, split: str | None = "text", low: int = 5, high: int = 1000) -> DataFrame:
    """Posts that hold personal data, with what was found."""
    kept = posts.where(filters.keep_post(split, low, high))
    found = pii.detect(kept, post_text())
    return found.select(F.col("author").alias("Author"), *renamed_post(), *schema.PII_COLUMNS)
