"""Merging corpora into one typed table: common columns, coercion by column name, Year and Month, labels, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import to_bool, to_datetime, to_number
from lexiloom.operators.tables import union_by_name

# Fixed values.
YEAR_COLUMNS = ("PostYear", "year")
MONTH_COLUMNS = ("PostMonth", "month")
DATE_COLUMNS = ("PostCreatedAt", "createdAt", "pubDate", "date", "created_at")
EPOCH_COLUMNS = ("PostCreatedUtc", "created_utc", "timestamp")
#: A corpus by its folder's name: pattern of the path in lower case, dataset type, group in ids; the first that fits counts.
CORPORA = (
    (r"(^|/)books(/|$)", "Books", "books"),
    (r"(^|/)tusc/(.*/)?[^/]*country[^/]*$", "Twitter", "tusc_ctry"),
    (r"(^|/)tusc/(.*/)?[^/]*city[^/]*$", "Twitter", "tusc_city"),
    (r"(^|/)tusc(/|$)", "Twitter", "tusc"),
    (r"(^|/)reddit(/|$)", "Reddit", "reddit"),
    (r"(^|/)blogs(/|$)", "Blogs", "blogs"),
    (r"(^|/)ai-gen(/|$)", "AI-Generated", "ai"),
    (r"(^|/)ai(_gen)?(/|$)", "Unknown", "ai"),
    (r"", "Unknown", "unknown"),
)
#: Ids have twelve digits. Hashes take numbers below SPARE; those above are dealt in slots to rows whose hash is another row's.
DIGITS, SPARE, SLOT = 12, 990_000_000_000, 1_000_000


def kind_of(column: str) -> str:
    """The merged type of a column by its name; a count is not the beginning of ``Country``."""
    if re.search(r"Has", column):
        return "boolean"
    if re.search(r"Count(?!ry)", column):
        return "int"
    if re.search(r"Avg", column):
        return "float"
    return "string"


def coerce(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns cast to the types of their names; what does not read becomes NULL."""
    make = {"boolean": to_bool, "int": lambda c: to_number(c, "int"), "float": lambda c: to_number(c, "float"), "string": lambda c: c.cast("string")}
    return df.withColumns({c: make[kind_of(c)](F.col(c)) for c in columns or df.columns})


def year_month(df: DataFrame, millis: frozenset[str] = frozenset()) -> DataFrame:
    """With Year (short) and Month (byte): per row from numbers, then dates as text, then epochs (``millis``: in ms)."""
    have = lambda names: [c for c in names if c in df.columns]
    when: list[Column] = [to_datetime(F.col(c)) for c in have(DATE_COLUMNS)]
    for c in have(EPOCH_COLUMNS):
        n = to_number(F.col(c))
        when.append(F.timestamp_seconds(n / 1000 if c in millis else n))
    years = [to_number(F.col(c), "smallint") for c in have(YEAR_COLUMNS)] + [F.year(t).cast("smallint") for t in when]
    month = lambda m: F.when(m.between(1, 12), m)
    months = [month(to_number(F.col(c), "tinyint")) for c in have(MONTH_COLUMNS)] + [F.month(t).cast("tinyint") for t in when]
    none = lambda kind: F.lit(None).cast(kind)
    return df.withColumns({"Year": F.coalesce(*years, none("smallint")), "Month": F.coalesce(*months, none("tinyint"))})


def in_millis(df: DataFrame) -> frozenset[str]:
    """Epoch columns most of whose values are so large that they count milliseconds: one pass over the table, one row."""
    have = [c for c in EPOCH_COLUMNS if c in df.columns]
    if not have:
        return frozenset()
    row = df.agg(*[F.avg((to_number(F.col(c)) > 10**12).cast("int")).alias(c) for c in have]).first()
    return frozenset(c for c in have if row[c] is not None and row[c] > 0.5)


def corpus(path: Column) -> tuple[Column, Column, Column]:
    """Label (the path's last three parts), dataset type and id group of a file's path, also of ``input_file_name()``."""
    clean = F.regexp_replace(F.regexp_replace(path, r"(^|/)(\./)+", "$1"), "/+", "/")
    low = F.lower(clean)
    kind = group = F.lit(None).cast("string")
    for pattern, a, b in reversed(CORPORA):
        fits = low.rlike(pattern)
        kind, group = F.when(fits, a).otherwise(kind), F.when(fits, b).otherwise(group)
    return F.regexp_extract(clean, r"((?:[^/]+/){0,2}[^/]+)$", 1), kind, group


def add_ids(df: DataFrame, columns: list[str], group: str | Column, prefix: str = "id") -> DataFrame:
    """With ``id``: prefix, group and twelve digits. Equal rows have the same id, different rows of a group have different ids.

    The digits are a hash of the row. Where different rows share them, one keeps them and the others get numbers from ``SPARE`` on, which no hash
    takes; which ones depends on the rows that are there. Rows are told apart by 128 bits of hashes.
    """
    # a NULL leaves xxhash64 as it is, so a value that moves to another column would not show
    values = [x for c in columns for x in (F.col(c), F.isnull(F.col(c)))]
    df = df.withColumns({"_id_group": F.lit(group), "_id_a": F.xxhash64(*values), "_id_b": F.xxhash64(F.lit(1), *values)})
    number = F.pmod("_id_a", F.lit(SPARE))
    same = Window.partitionBy("_id_group", "_id_n").orderBy("_id_a", "_id_b")
    rows = df.select("_id_group", number.alias("_id_n"), "_id_a", "_id_b").repartition("_id_n").dropDuplicates()
    later = rows.withColumn("_id_k", F.row_number().over(same)).where("_id_k > 1").withColumn("_id_slot", F.pmod(F.xxhash64("_id_b", "_id_a"), F.lit((10**DIGITS - SPARE) // SLOT)))
    # numbered within slots, so no task sees all of them
    at = F.row_number().over(Window.partitionBy("_id_group", "_id_slot").orderBy("_id_a", "_id_b")) - 1
    at = F.when(at < SLOT, at).otherwise(F.raise_error(F.lit("too many rows for ids of twelve digits")))
    moved = later.select("_id_group", "_id_a", "_id_b", (SPARE + F.col("_id_slot") * SLOT + at).alias("_id_moved"))
    # of n rows about n * n / (2 * SPARE): 5,000 of 100 million
    df = df.join(F.broadcast(moved), ["_id_group", "_id_a", "_id_b"], "left")
    digits = F.lpad(F.coalesce("_id_moved", number).cast("string"), DIGITS, "0")
    return df.withColumn("id", F.concat(F.lit(f"{prefix}_"), "_id_group", F.lit("_"), digits)).drop("_id_group", "_id_a", "_id_b", "_id_moved")


def common_columns(headers: list[list[str]]) -> list[str]:
    """Columns of all inputs, and every input's demographic columns, sorted."""
    shared = set(headers[0]).intersection(*headers[1:]) if headers else set()
    return sorted(shared | {c for h in headers for c in h if c.startswith("DMG")})


def merge(inputs: dict[str, DataFrame], prefix: str = "id") -> DataFrame:
    """One table of all inputs (path: table), with Year, Month, MatchCount, Dataset, Dataset Type and id."""
    columns = common_columns([d.columns for d in inputs.values()])
    out = []
    for path, df in inputs.items():
        label, kind, group = corpus(F.lit(path))
        df = year_month(df, in_millis(df))
        absent = [c for c in columns if c not in df.columns]
        df = coerce(df.withColumns({c: F.lit(None).cast("string") for c in absent}), columns)
        count = F.when(group == "books", to_number(F.col("match_count"), "bigint")).otherwise(F.lit(1).cast("bigint")) if "match_count" in df.columns else F.lit(1).cast("bigint")
        df = df.withColumns({"MatchCount": count, "Dataset": label, "Dataset Type": kind})
        out.append(df.select(*columns, "Year", "Month", "MatchCount", "Dataset", "Dataset Type", group.alias("_group")))
    rows = union_by_name(out)
    return add_ids(rows, [f"`{c}`" for c in rows.columns if c != "_group"], F.col("_group"), prefix).drop("_group")


def fill_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their headers; what a table lacks is an empty text."""
    return union_by_name(frames).na.fill("")
