"""Queries of the sources, sinks and plans: each writes files to the shared folder and reads them back.

The SQL gives the rows from the tables themselves, so a value that a file format changes shows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schema
from lexiloom.functions.language import WORDS as FUNCTION_WORDS
from lexiloom.operators import detect, features, merge, ngrams, pii
from lexiloom.plans import social
from lexiloom.queries import GRAM_SQL, LEXICON, LEXICON_SQL, NAMES, SQL, TERMS, TOKENS_SQL, docs, lexicon, ngram_lines, query, said
from lexiloom.sources import lexicons, readers, sinks


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; a local one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def lines(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)


# --- sources --------------------------------------------------------------------------------------

CLEAN_SQL = r"trim(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT doc_id::VARCHAR AS id, lang AS subreddit, source AS author, doc_id AS score, (1500000000 + doc_id)::VARCHAR AS created_utc, '' AS title, {CLEAN_SQL} AS selftext, NULL AS media_path FROM documents")
def posts_json(spark, d):
    """Posts as JSON lines, numbers and text as created_utc, with lines that are no objects in between."""
    when = "CASE WHEN doc_id % 2 = 0 THEN 1500000000 + doc_id END AS created_utc"
    post = docs(spark, d).selectExpr("cast(doc_id as string) AS id", "lang AS subreddit", "source AS author", "doc_id AS score", when, "cast(1500000000 + doc_id as string) AS as_text", "text AS selftext", "'x' AS other")
    made = F.when(F.col("as_text").cast("long") % 2 == 0, F.to_json(F.struct("id", "subreddit", "author", "score", "created_utc", "selftext", "other")))
    text_form = F.to_json(F.struct("id", "subreddit", "author", "score", F.col("as_text").alias("created_utc"), "selftext"))
    good = post.select(F.coalesce(made, text_form).alias("value"))
    bad = spark.createDataFrame([("",), ("{\"id\": ",), ("[1, 2]",), ("not json",)], "value string")
    path = folder(spark, "posts")
    lines(good.unionByName(bad), f"{path}/RS_2020-01")
    got = readers.posts(spark, f"{path}/RS_2020-01").select(*readers.post_columns())
    return got.select("id", "subreddit", "author", "score", "created_utc", "title", "selftext", "media_path")


@query("SELECT conv_id::VARCHAR || '-' || turn AS TweetID, text AS Tweet, CASE WHEN turn % 3 = 0 THEN role ELSE conv_id::VARCHAR END AS Author, NULL AS Place FROM conversations")
def messages_parquet(spark, d):
    """Messages as parquet: the author is the first usable id, absent columns are NULL."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    path = folder(spark, "messages")
    user = "CASE WHEN turn % 3 = 0 THEN 'nan' ELSE concat(conv_id, '.0') END AS UserID"
    sinks.parquet(c.selectExpr("concat(conv_id, '-', turn) AS TweetID", "text AS Tweet", user, "role AS userName"), path)
    return readers.messages(spark, path).select("TweetID", "Tweet", "Author", "Place")


@query(f"WITH {GRAM_SQL}, sums AS (SELECT ngram, sum(match_count) AS n FROM gram GROUP BY 1) SELECT n::BIGINT AS match_count, count(*) AS n_grams FROM sums GROUP BY 1")
def ngram_files(spark, d):
    """N-gram files found by their names; lines of a count of 0 or less are not summed."""
    path = folder(spark, "grams")
    none = spark.createDataFrame([("a b c d e\t1999\t0\t1",), ("a b c d e\t1999\t-4\t1",)], "value string")
    # the lines are seven times the input; packed files do not split, so each holds a million lines at most
    ngram_lines(spark, d).unionByName(none).write.options(compression="gzip", maxRecordsPerFile=1_000_000).text(f"{path}/eng-5gram-all")
    rows = ngrams.clean(readers.ngram_lines(spark, f"{path}/eng-5gram-all", "part*"))
    return ngrams.counts(rows).groupBy("match_count").agg(F.count("*").alias("n_grams"))


@query("SELECT doc_id::VARCHAR AS doc_id, lang, source, 2::BIGINT AS n FROM documents")
def tsv_append(spark, d):
    """Two appends to one folder: every row twice, no header among them."""
    path = folder(spark, "append")
    rows = docs(spark, d).select("doc_id", "lang", "source")
    for _ in range(2):
        sinks.tsv(rows, f"{path}/t.tsv")
    return readers.table(spark, f"{path}/t.tsv").groupBy("doc_id", "lang", "source").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS doc_id, 'a \"b\"' || chr(10) || lang || chr(9) || ', ' || source AS said, lang || '|' || source AS both, NULL AS absent FROM documents")
def tsv_quoted(spark, d):
    """Tabs, quotes and line breaks survive; arrays are joined; columns that are not there are empty."""
    path = folder(spark, "quoted") + ".tsv"
    rows = docs(spark, d).select("doc_id", F.expr("concat('a \"b\"\\n', lang, '\\t, ', source)").alias("said"), F.array("lang", "source").alias("both"))
    sinks.tsv(rows, path, ("doc_id", "said", "both", "absent"))
    return readers.table(spark, path)


@query("SELECT doc_id::VARCHAR AS doc_id, lang FROM documents")
def csv_lenient(spark, d):
    """Lines with too many fields are left out; the columns asked for are read."""
    path = folder(spark, "lenient")
    good = docs(spark, d).selectExpr("concat(doc_id, ',', lang, ',x') AS value").unionByName(spark.createDataFrame([("1,2,3,4,5",)], "value string"))
    head = spark.createDataFrame([("doc_id,lang,more",)], "value string")
    lines(head, f"{path}/a")
    lines(good, f"{path}/b")
    both = spark.read.text(f"{path}/a").unionByName(spark.read.text(f"{path}/b"))
    lines(both.coalesce(1), f"{path}/c")  # one header: one file
    return readers.table(spark, f"{path}/c", lenient=True).select("doc_id", "lang", "more").where("more is not null").select("doc_id", "lang")


@query("SELECT unnest(['doc_id', 'text', 'lang']) AS name, unnest([0, 1, 2])::INTEGER AS at")
def header_names(spark, d):
    path = folder(spark, "header") + ".tsv"
    sinks.tsv(docs(spark, d).select("doc_id", "text", "lang").limit(0), path)
    return spark.createDataFrame([(n, i) for i, n in enumerate(readers.header(spark, path))], "name string, at int")


@query("SELECT doc_id::VARCHAR AS doc_id, lang AS model_answer, source AS model_reasoning FROM documents")
def generated_text(spark, d):
    """The text columns of a configured dataset."""
    path = folder(spark, "generated")
    sinks.csv(docs(spark, d).select("doc_id", F.col("lang").alias("model_answer"), F.col("source").alias("model_reasoning")), path)
    rows, columns = readers.generated(spark, path, "star1")
    return rows.select("doc_id", *columns)


# --- sinks ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id::VARCHAR AS doc_id, replace(replace({CLEAN_SQL}, chr(9), ' '), '\\', '/') AS cleaned FROM documents")
def tsv_escaped(spark, d):
    """Text without raw tabs and line breaks, written unquoted."""
    from lexiloom.functions.text import clean_newlines

    path = folder(spark, "escaped")
    cleaned = F.translate(clean_newlines(F.col("text")), "\t\\", " /").alias("cleaned")
    sinks.escaped_tsv(docs(spark, d).select("doc_id", cleaned), path)
    return readers.escaped_table(spark, path)


@query("SELECT year(ts)::INTEGER AS Year, month(ts)::INTEGER AS Month, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def parquet_by_month(spark, d):
    path = folder(spark, "months")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value", F.year("ts").alias("Year"), F.month("ts").alias("Month"))
    sinks.parquet(e, path, by_month=True)
    return spark.read.parquet(path).groupBy("Year", "Month").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, count(*) AS n, 1::BIGINT AS n_files FROM documents GROUP BY 1")
def single_file(spark, d):
    path = folder(spark, "single")
    sinks.single_file(docs(spark, d).groupBy("lang").agg(F.count("*").alias("n")), path)
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("f")).agg(F.countDistinct("f").alias("n_files"))
    got = spark.read.options(sep="\t", header="true").csv(path).select("lang", F.col("n").cast("long").alias("n"))
    return got.crossJoin(F.broadcast(files))  # one row


@query(f"SELECT {', '.join(NAMES[:-2])} FROM {LEXICON_SQL} WHERE worry <> 99")
def lexicon_files(spark, d):
    """Every loader over files in its own layout, joined to the wide table."""
    path = folder(spark, "lexicons")
    at = {n: i for i, n in enumerate(NAMES)}

    def write(name: str, rows: list[str]) -> str:
        lines(spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1), f"{path}/{name}")
        return f"{path}/{name}"

    def pairs(c: str) -> str:
        return write(c, ["head\ting\tvalue", *(f"{r[0].upper()}\tx\t{r[at[c]]}" for r in LEXICON)])

    vad = write("vad", ["word\tv\ta\td", *("\t".join(map(str, r[:4])) for r in LEXICON)])
    feel = write("emotions", [f"{r[0]}\t{e}\t{r[at[e]]}" for r in LEXICON for e in features.EMOTIONS])
    tags = write("tenses", [f"lemma\t{r[0]}\t{tag}" for r in LEXICON for tag, c in (("V;PST", "n_pst"), ("V;PRS", "n_prs"), ("N", None)) for _ in range(r[at[c]] if c else 1)])
    parts = [lexicons.vad(spark, vad), lexicons.emotions(spark, feel), lexicons.tenses(spark, tags), *(lexicons.number(spark, pairs(c), c) for c in ("worry", "moral", "social", "warm"))]
    # a word without any emotion has no row in that loader
    return lexicons.wide(parts, spark).fillna(0, list(features.EMOTIONS)).select(*NAMES[:-2])


# --- plans ----------------------------------------------------------------------------------------

SAID = [("I am from Toronto. I am 30 years old.", "30", "", "toronto", "canada", ""), ("I am a Teacher.", "", "teacher", "", "", "teachers"), ("My religion is Islam", "", "", "", "", ""), ("Nothing is said here", None, None, None, None, None)]


def _said(i: int) -> str:
    return "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN '{s[i]}'" for k, s in enumerate(SAID) if s[i] is not None) + " END"


@query(
    f"SELECT doc_id, {_said(1)} AS age, {_said(2)} AS occupation, {_said(3)} AS city, {_said(4)} AS city_country, {_said(5)} AS title, CASE WHEN doc_id % 4 = 2 THEN 'islam' ELSE '' END AS religion, "
    "CASE WHEN doc_id % 4 = 0 THEN 1990 END::INTEGER AS born FROM documents WHERE doc_id % 4 <> 3"
)
def identified_documents(spark, d):
    """Rows with any statement, their values in lower case and mapped: city to country, occupation to title."""
    maps = {"city": {"toronto": "Canada"}, "occupation": {"teacher": "Teachers"}}
    rows = said(spark, d, f"concat({_said(0)}, ' ')").select("doc_id", "statement")
    got = social.identified(rows, F.col("statement"), F.lit(2020), TERMS, maps)
    names = {"age": "DMGRawExtractedAge", "occupation": "DMGRawExtractedOccupation", "city": "DMGRawExtractedCity", "city_country": "DMGCountryMappedFromExtractedCity", "title": "DMGSOCTitleMappedFromExtractedOccupation", "religion": "DMGRawExtractedReligion"}
    return got.select("doc_id", *[F.array_join(c, "|").alias(n) for n, c in names.items()], F.col("DMGMajorityBirthyear").cast("int").alias("born"))


@query("SELECT event_id, year(ts)::SMALLINT AS Year, month(ts)::TINYINT AS Month FROM events")
def year_month_millis(spark, d):
    """Epochs that count milliseconds are found by their size."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("cast(unix_millis(cast(ts as timestamp)) as string)").alias("timestamp"))
    return merge.year_month(rows, merge.in_millis(rows)).select("event_id", "Year", "Month")


BLANK = "CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN NULL ELSE text END"
_count = lambda c: f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN len({TOKENS_SQL.format(c)}) END::INTEGER"
_flag = lambda c: f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN list_contains({TOKENS_SQL.format(c)}, 'they')::INTEGER END"


@query(f"SELECT doc_id, {_count('body')} AS body_WordCount, {_flag('body')} AS body_PRNHasThey, {_count('source')} AS source_WordCount FROM (SELECT doc_id, source, {BLANK} AS body FROM documents)")
def prefixed_features(spark, d):
    """Features of two columns have their names in front; blank and NULL texts have none."""
    rows = docs(spark, d).select("doc_id", "source", F.expr(BLANK).alias("body"))
    made = features.annotate_columns(rows, ("body", "source"), lexicon(spark))
    return made.select("doc_id", "body_WordCount", "body_PRNHasThey", "source_WordCount")


_PII_FORMS = [("a.b@example.org or 10.0.0.1", "a.b@example.org", "10.0.0.1", "EMAIL_ADDRESS; IP_ADDRESS", 2), ("see 10.0.0.1 and 10.0.0.2", "", "10.0.0.1; 10.0.0.2", "IP_ADDRESS", 2), ("nothing", "", "", "", 0)]


@query(" UNION ALL ".join(f"SELECT doc_id, '{e}' AS PII_EMAIL_ADDRESS, '{i}' AS PII_IP_ADDRESS, '' AS PII_PHONE_NUMBER, '{t}' AS PII_Types_Found, {n} AS PII_Count, true AS Has_PII FROM documents WHERE doc_id % 3 = {k}" for k, (_, e, i, t, n) in enumerate(_PII_FORMS) if n))
def pii_columns(spark, d):
    """Joined values, sorted types, counts, and only the rows with any."""
    cases = " ".join(f"WHEN {k} THEN '{s[0]}'" for k, s in enumerate(_PII_FORMS))
    found = pii.detect(said(spark, d, f"CASE doc_id % 3 {cases} END").select("doc_id", "statement"), F.col("statement"))
    return found.select("doc_id", *[c for c in schema.PII_COLUMNS if c in ("PII_EMAIL_ADDRESS", "PII_IP_ADDRESS", "PII_PHONE_NUMBER", "PII_Types_Found", "PII_Count", "Has_PII")])


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'no' END AS kept FROM documents WHERE doc_id % 2 = 0")
def any_detection(spark, d):
    """The filter that keeps rows with a statement of any category."""
    rows = said(spark, d, "CASE WHEN doc_id % 2 = 0 THEN 'I am a woman, and' ELSE 'you are a woman' END")
    found = detect.detected(rows, F.col("statement"), TERMS).where(detect.any_match(F.col("_found")))
    return found.select("doc_id", F.lit("yes").alias("kept"))


@query("SELECT count(*) AS n_docs, count(DISTINCT (doc_id, text)) AS n_ids, count(*) AS n_formed FROM documents")
def row_id(spark, d):
    """As many ids as different rows."""
    made = merge.add_ids(docs(spark, d), ["doc_id", "text"], "reddit")
    return made.agg(F.count("*").alias("n_docs"), F.countDistinct("id").alias("n_ids"), F.count_if(F.col("id").rlike("^id_reddit_[0-9]{12}$")).alias("n_formed"))


_share = lambda k: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in FUNCTION_WORDS[k].split()) + "))) / greatest(1, len(w))::DOUBLE"
SQL["language_gate"] = (
    "WITH t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(left(text, 4000)), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM documents), "
    f"s AS (SELECT doc_id, lang, {', '.join(f'{_share(k)} AS share_{k}' for k in FUNCTION_WORDS)} FROM t) "
    f"SELECT * FROM s WHERE share_en >= 0.1 AND {' AND '.join(f'share_en > share_{k}' for k in FUNCTION_WORDS if k != 'en')}"
)
