"""Declared schemas: inputs are never inferred and outputs always have the same columns."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in (x.rsplit(" ", 1) for x in spec.split(", "))])


#: Keys that are read of a submission. created_utc occurs as number and as text.
POSTS = "id string, author string, subreddit string, title string, selftext string, created_utc string, score bigint, num_comments bigint, permalink string, url string, over_18 boolean, promoted boolean, whitelist_status string, is_video boolean, _corrupt_record string"
#: Columns of short-message tables; city tables have City, country tables Country and MyCountry.
MESSAGES = ("TweetID", "Tweet", "createdAt", "Year", "Month", "Place", "PlaceID", "PlaceType", "City", "Country", "MyCountry", "UserID", "userName", "Author")

DEMOGRAPHICS = (
    "DMGRawExtractedAge", "DMGRawExtractedGender", "DMGRawExtractedCity", "DMGCountryMappedFromExtractedCity", "DMGRawExtractedCountry", "DMGRawExtractedReligion",
    "DMGMainReligionMappedFromExtractedReligion", "DMGMainCategoryMappedFromExtractedReligion", "DMGRawExtractedOccupation", "DMGSOCTitleMappedFromExtractedOccupation",
)
BIRTH = ("DMGMajorityBirthyear", "DMGRawBirthyearExtractions")
POST_COLUMNS = ("PostID", "PostSubreddit", "PostTitle", "PostSelftext", "PostCreatedUtc", "PostScore", "PostNumComments", "PostPermalink", "PostUrl", "PostMediaPath")
MESSAGE_COLUMNS = ("PostID", "PostText", "PostCreatedAt", "PostYear", "PostMonth")
PLACE_COLUMNS = ("PostPlace", "PostPlaceID", "PostPlaceType")


def message_columns(split: str) -> tuple[str, ...]:
    return (*MESSAGE_COLUMNS, *(("PostCity",) if split == "city" else ("PostCountry", "PostMyCountry")), *PLACE_COLUMNS)


def users_columns(source: str, split: str = "text") -> tuple[str, ...]:
    return ("Author", *BIRTH, *DEMOGRAPHICS, *(POST_COLUMNS if source == "posts" else message_columns(split)))


def posts_columns(source: str, features: tuple[str, ...], split: str = "text") -> tuple[str, ...]:
    own = POST_COLUMNS if source == "posts" else message_columns(split)
    return ("Author", "DMGAgeAtPost", *own, *features, *(BIRTH if source == "posts" else ()), *DEMOGRAPHICS)


PII_TYPES = ("EMAIL_ADDRESS", "IBAN_CODE", "IP_ADDRESS", "MEDICAL_LICENSE", "PHONE_NUMBER", "CRYPTO")
PII_COLUMNS = (*(f"PII_{t}" for t in PII_TYPES), "PII_Types_Found", "PII_Count", "Has_PII")
NGRAMS = "ngram string, year int, match_count bigint, book_count bigint"
