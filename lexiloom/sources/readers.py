"""Sources. Schemas are declared; files are split by Spark, so there is no index to build and no limit on their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schema
from lexiloom.functions.text import field, id_text, is_blank, sanitize
from lexiloom.functions.language import is_english
from lexiloom.operators import ngrams

#: Text columns of generated-text datasets.
GENERATED = {
    "wildchat-1m": ("ai_text",), "lmsys-1m": ("ai_text",), "pippa": ("ai_text",), "hh-rlhf": ("ai_text",), "prism": ("ai_text",), "apt-paraphrase-dataset-gpt-3": ("text",),
    "anthropic-persuasiveness": ("ai_text",), "M4": ("ai_text",), "mage": ("ai_text",), "luar": ("ai_text",), "general_thoughts_430k": ("model_answer", "model_reasoning"),
    "reasoning_shield": ("model_answer", "model_reasoning"), "safechain": ("model_answer", "model_reasoning"), "star1": ("model_answer", "model_reasoning"), "tinystories": ("ai_text",), "raid": ("ai_text",),
}
ENCODINGS = {"wildchat-1m": "windows-1252"}


def parsed_posts(lines: DataFrame) -> DataFrame:
    """Submissions of JSON lines (value); lines that are not one JSON object are left out."""
    kind = schema.struct(schema.POSTS)
    rows = lines.select("value", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where(r"value rlike '^\\s*\\{' and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def posts(spark: SparkSession, path: str, pattern: str = "RS_*") -> DataFrame:
    """Submissions as JSON lines (plain or compressed): one file, or all files of the pattern under a folder."""
    reader = spark.read
    if not path.rsplit("/", 1)[-1].startswith(pattern.rstrip("*")):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return parsed_posts(reader.text(path))


def post_columns(media_path: str | None = None) -> list[Column]:
    """The eleven columns that are kept of a post."""
    from lexiloom.functions.text import clean_newlines

    plain = ("id", "subreddit", "created_utc", "score", "num_comments", "author", "permalink", "url")
    return [*map(F.col, plain), F.coalesce("title", F.lit("")).alias("title"), clean_newlines(F.col("selftext")).alias("selftext"), F.lit(media_path).cast("string").alias("media_path")]


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Short messages as parquet, with ``Author`` from the first usable id column; absent columns are NULL."""
    df = spark.read.parquet(path)
    there = {c.lower() for c in df.columns}  # names are resolved whatever their case
    ids = [id_text(F.col(c)) for c in ("Author", "UserID", "userName") if c.lower() in there]
    df = df.withColumn("Author", F.coalesce(*ids) if ids else F.lit(None).cast("string"))
    return df.withColumns({c: F.lit(None).cast("string") for c in schema.MESSAGES if c.lower() not in there and c != "Author"})


def split_name(path: str) -> str:
    return "city" if "city" in path.rsplit("/", 1)[-1].lower() else "country"


def ngram_lines(spark: SparkSession, path: str, pattern: str = "*5gram*") -> DataFrame:
    """Parsed n-gram rows with the file that they come from."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    lines = lines.select("value", name.alias("source_file"))
    return ngrams.parse(lines, keep=("source_file",))


def table(spark: SparkSession, path: str, *, encoding: str = "UTF-8", columns: tuple[str, ...] | None = None, lenient: bool = False) -> DataFrame:
    """CSV or TSV (by extension) with a header, every column as text; quoted line breaks are allowed.

    ``lenient`` drops malformed lines, and lines are then the records, so large files split.
    """
    sep = "\t" if path.rstrip("/").endswith(".tsv") else ","
    options = {"sep": sep, "header": "true", "encoding": encoding, "quote": '"', "escape": '"', "inferSchema": "false", "enforceSchema": "false"}
    options |= {"mode": "DROPMALFORMED"} if lenient else {"multiLine": "true"}
    df = spark.read.options(**options).csv(path)
    return df.select(*columns) if columns else df


def escaped_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``sinks.escaped_tsv`` wrote, every column as text."""
    df = spark.read.options(sep="\t", header="true", quote="", escape="\\").csv(path)

    def text(name: str) -> Column:
        c = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        out = F.replace(c, F.lit("\\\\"), F.lit("\n"))  # no field holds a line break
        for mark, value in (("\\0", "\0"), ("\\&", ""), ("\n", "\\")):
            out = F.replace(out, F.lit(mark), F.lit(value))
        return F.when(c != "\\N", out).alias(name)

    return df.select(*[text(c) for c in df.columns])


def header(spark: SparkSession, path: str) -> list[str]:
    return table(spark, path).columns


def generated(spark: SparkSession, path: str, dataset: str) -> tuple[DataFrame, tuple[str, ...]]:
    """A generated-text dataset and its text columns."""
    if dataset not in GENERATED:
        raise ValueError(f"dataset {dataset!r} is not configured")
    return table(spark, path, encoding=ENCODINGS.get(dataset, "UTF-8")), GENERATED[dataset]


def feed_items(xml: DataFrame, content: str = "value", path: str = "file_path") -> DataFrame:
    """Items of RSS texts: file_path, title, link, guid, pubDate, description_raw, description, categories.

    Lenient: items are what stands between item tags, whatever else is broken. Items whose descriptions are all empty are
    left out, and so are descriptions under 250 characters or not in English.
    """
    items = xml.select(path, F.posexplode(F.regexp_extract_all(content, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("item_no", "item"))
    both = r"(?s)<content:encoded>(.*?)</content:encoded>|<description>(.*?)</description>"
    found = F.zip_with(F.regexp_extract_all("item", F.lit(both), F.lit(1)), F.regexp_extract_all("item", F.lit(both), F.lit(2)), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))
    rows = items.withColumn("description_raw", F.get(F.filter(found, lambda d: d.isNotNull()), 0)).where("description_raw is not null")
    rows = rows.withColumn("description", sanitize(F.col("description_raw"), strip_tags=True)).where(F.length("description") >= 250).where(is_english(F.col("description")))
    text = lambda tag: sanitize(F.coalesce(field(F.col("item"), tag), F.lit(""))).alias(tag)
    categories = F.array_join(F.regexp_extract_all("item", F.lit(r"(?s)<category>(.*?)</category>"), F.lit(1)), "|")
    return rows.select(path, "item_no", text("title"), text("link"), text("guid"), text("pubDate"), sanitize(F.col("description_raw"), strip_tags=True).alias("description_raw"), "description", sanitize(categories).alias("categories"))


def feeds(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Items of all ``*.xml`` under ``path``; with ``max_files`` only the first files by name."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").option("wholetext", "true").text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    if max_files is not None:
        names = files.select("file_path").distinct().orderBy("file_path").limit(max_files)
        files = files.join(F.broadcast(names), "file_path", "left_semi")  # max_files rows
    return feed_items(files)


def sample(df: DataFrame, column: str, pattern: str, n: int = 100) -> DataFrame:
    """The first n rows whose column matches: a sampling operator."""
    return df.where(F.coalesce(F.col(column), F.lit("")).rlike(pattern)).limit(n)


def months(spark: SparkSession, template: str, first: str = "2010-01-01", last: str = "2022-12-01") -> DataFrame:
    """(url): a download address for each month, ``{month}`` replaced by year and month."""
    month = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month")))
    return spark.range(1).select(month.alias("m")).select(F.replace(F.lit(template), F.lit("{month}"), F.date_format("m", "yyyy-MM")).alias("url"))


def links(pages: DataFrame, html: str, pattern: str = ".*") -> DataFrame:
    """(url): addresses in href attributes that match."""
    return pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"href=[\"']([^\"']*)[\"']"), F.lit(1))).alias("url")).where(F.col("url").rlike(pattern))


def has_text(c: str) -> Column:
    return ~is_blank(F.col(c))
