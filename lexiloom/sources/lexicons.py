"""Lexicon and dictionary loaders. All scores end up in one wide table with a row per word.

Word lists are bounded by their language, so the small ones (term lists for patterns) are read to the driver; the
wide table stays a DataFrame and is broadcast only after its rows are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.terms import category_name
from lexiloom.operators.demographics import first_by
from lexiloom.operators.features import BONDS, DIMENSIONS, EMOTIONS

WIDE = "word string, " + ", ".join(f"{d} double" for d in DIMENSIONS) + ", " + ", ".join(f"{e} int" for e in EMOTIONS) + ", worry int, " + ", ".join(f"{c} int" for c, _ in BONDS) + ", n_pst int, n_prs int"


def _lines(spark: SparkSession, path: str, skip_header: bool = False) -> DataFrame:
    """Fields of tab-separated lines with their order, without blank lines."""
    df = spark.read.text(path).select(F.monotonically_increasing_id().alias("no"), F.split("value", "\t").alias("f")).where("trim(f[0]) <> ''")
    return df.where("no > 0") if skip_header else df


def _word(i: int) -> Column:
    return F.lower(F.trim(F.get("f", i))).alias("word")


def vad(spark: SparkSession, path: str) -> DataFrame:
    """word, valence, arousal, dominance: lines of four fields with numbers; the last of a word counts."""
    df = _lines(spark, path).where("size(f) = 4").select("no", _word(0), *[F.trim(F.get("f", i + 1)).try_cast("double").alias(d) for i, d in enumerate(DIMENSIONS)])
    return first_by(df.dropna(subset=list(DIMENSIONS)), "word", F.desc("no")).drop("no")


def emotions(spark: SparkSession, path: str) -> DataFrame:
    """word and a 0/1 column per emotion: lines word, emotion, flag."""
    df = _lines(spark, path).where("size(f) = 3 and trim(f[2]) = '1'").select(_word(0), F.trim(F.get("f", 1)).alias("emotion"))
    return df.groupBy("word").agg(*[F.max((F.col("emotion") == e).cast("int")).alias(e) for e in EMOTIONS])


def number(spark: SparkSession, path: str, name: str, key: int = 0, value: int = 2) -> DataFrame:
    """word and an integer; a header line; the last of a word counts."""
    df = _lines(spark, path, skip_header=True).select("no", _word(key), F.trim(F.get("f", value)).try_cast("int").alias(name)).dropna()
    return first_by(df, "word", F.desc("no")).drop("no")


def tenses(spark: SparkSession, path: str) -> DataFrame:
    """word, n_pst, n_prs: how many of a form's tags are past, and how many are present and not past."""
    df = _lines(spark, path).where("size(f) > 2").select(_word(1), F.get("f", 2).alias("tag"))
    past = F.contains("tag", F.lit("PST"))
    return df.groupBy("word").agg(F.count_if(past).cast("int").alias("n_pst"), F.count_if(~past & F.contains("tag", F.lit("PRS"))).cast("int").alias("n_prs"))


def cognition(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """Words with a 0/1 column per category, the categories in file order, and the single-word terms as verbs."""
    items = spark.read.schema("category string, terms array<string>").option("multiLine", "true").json(path).collect()  # a lexicon file
    names = list(dict.fromkeys(category_name(r.category) for r in items))
    terms = {n: {t.lower() for r in items if category_name(r.category) == n for t in r.terms} for n in names}
    words = sorted(set().union(*terms.values())) if terms else []
    rows = [(w, *[int(w in terms[n]) for n in names]) for w in words]
    table = spark.createDataFrame(rows, "word string" + "".join(f", cog_{n} int" for n in names))
    return table, names, sorted(w for w in words if w.isalpha())


def wide(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """Full outer join of the loaders' tables on word, with every column of the wide table."""
    joined = reduce(lambda a, b: a.join(b, "word", "full"), parts)
    columns = [x.split(" ") for x in WIDE.split(", ")]
    absent = {n: F.lit(None).cast(t) for n, t in columns if n not in joined.columns}
    zero = {c: F.coalesce(F.col(c) if c in joined.columns else F.lit(0), F.lit(0)) for c in ("n_pst", "n_prs")}
    return joined.withColumns(absent | zero)


def term_list(spark: SparkSession, path: str, lower: bool = False) -> list[str]:
    """One term per line, blank lines left out."""
    terms = [r.value.strip() for r in spark.read.text(path).collect()]
    return [t.lower() if lower else t for t in terms if t]


def cities(spark: SparkSession, path: str) -> DataFrame:
    """(term, country) of a semicolon-separated table of cities; of equal names the most populous counts, alternates too."""
    df = spark.read.options(sep=";", header="true", quote='"', escape='"').csv(path)
    df = df.select(F.trim("Name").alias("name"), F.trim("`Country name EN`").alias("country"), F.coalesce(F.col("Population").try_cast("double"), F.lit(0.0)).alias("size"), F.coalesce("`Alternate Names`", F.lit("")).alias("also"))
    df = df.where("name <> '' and country <> ''")
    rows = df.select(F.posexplode(F.concat(F.array("name"), F.split("also", ","))).alias("at", "term"), "country", "size").withColumn("term", F.lower(F.trim("term"))).where("term <> ''")
    return first_by(rows, "term", F.desc("size"), F.asc("at"), F.asc("country")).select("term", "country")


def religions(spark: SparkSession, path: str) -> DataFrame:
    """(term, main, category): each substrain, and each main religion as itself; later lines win."""
    df = spark.read.options(header="true", quote='"', escape='"').csv(path).withColumn("no", F.monotonically_increasing_id())
    sub = next(c for c in ("Substrain/Denomination", "Substrain") if c in df.columns)
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    named = df.select("no", value(sub).alias("sub"), value("Main Religion").alias("main"), value("Main Category").alias("category"))
    both = named.select("no", F.lower("sub").alias("term"), "main", "category", F.lit(0).alias("own")).unionByName(named.select("no", F.lower("main").alias("term"), "main", "category", F.lit(1).alias("own")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("no", "own"))).alias(c)
    return both.where("term is not null").groupBy("term").agg(last("main"), last("category"))


def occupations(spark: SparkSession, path: str) -> DataFrame:
    """(term, title) of a CSV, or of an Excel sheet where pandas can read one; blank cells are skipped."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd  # needs an Excel engine; a title list of some thousand rows

        df = spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None))
    else:
        df = spark.read.options(header="true", quote='"', escape='"').csv(path)
    direct = next(c for c in df.columns if "Direct Match Title" in c)
    title = next(c for c in df.columns if c != direct and ("SOC Title" in c or "Occupation" in c))
    rows = df.select(F.monotonically_increasing_id().alias("no"), F.lower(F.trim(F.col(f"`{direct}`"))).alias("term"), F.trim(F.col(f"`{title}`")).alias("title")).where("term <> '' and title <> ''")
    return first_by(rows, "term", F.desc("no")).drop("no")
