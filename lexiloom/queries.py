"""Queries that run the library's operators over the test tables, each with the SQL that must give the same rows.

The tables hold no social posts, so some queries build statements out of row values; the SQL builds the same.
Patterns on the SQL side use no look-around and ASCII classes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import age, terms, text
from lexiloom.functions.language import is_english, shares
from lexiloom.operators import demographics, detect, features, filters, merge, ngrams, pii
from lexiloom.sources import lexicons, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A made-up lexicon over frequent words of the tables.
WORDS = "the of and to in is that for it was on with be as by this are at from or you la le de der die und que el en est".split()
LEXICON = [
    (
        w, round((i * 37 % 100) / 100, 2), round((i * 53 % 100) / 100, 2), round((i * 71 % 100) / 100, 2), *[int((i + k) % 4 == 0) for k in range(10)],
        i % 7 - 3, (i * 3) % 7 - 3, (i * 5) % 7 - 3, (i * 2) % 7 - 3, i % 3, (i + 1) % 2, int(i % 5 == 0), int(i % 6 == 1),
    )
    for i, w in enumerate(WORDS)
]
NAMES = ["word", *features.DIMENSIONS, *features.EMOTIONS, "worry", "moral", "social", "warm", "n_pst", "n_prs", "cog_Insight", "cog_Doubt"]
LEXICON_SQL = "(VALUES " + ", ".join("('" + r[0] + "', " + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r[1:]) + ")" for r in LEXICON) + f") lex({', '.join(NAMES)})"
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({0}), '[\s\x1c-\x1f]+'), lambda w: w <> '')"


def lexicon(spark: SparkSession) -> features.Lexicons:
    words = spark.createDataFrame(LEXICON, lexicons.WIDE + ", cog_Insight int, cog_Doubt int")
    return features.Lexicons(words, ("hand", "the", "er", "head"), ("think", "plan", "be"), ("Insight", "Doubt"))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def said(spark: SparkSession, d: str, expression: str) -> DataFrame:
    """Documents with a made-up statement."""
    return docs(spark, d).select("doc_id", "source", F.expr(expression).alias("statement"))


# --- filters, projections -------------------------------------------------------------------------

POST_SQL = "SELECT *, 'https://x.org/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.PNG' ELSE '' END AS url, doc_id % 11 = 0 AS over_18, doc_id % 13 = 0 AS promoted, CASE WHEN doc_id % 17 = 0 THEN 'promo_specified' END AS whitelist_status, doc_id % 19 = 0 AS is_video FROM documents"


def as_posts(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("concat('https://x.org/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.PNG' ELSE '' END)")
    cols = {"url": url, "over_18": F.expr("doc_id % 11 = 0"), "promoted": F.expr("doc_id % 13 = 0"), "whitelist_status": F.expr("CASE WHEN doc_id % 17 = 0 THEN 'promo_specified' END"), "is_video": F.expr("doc_id % 19 = 0")}
    return docs(spark, d).withColumns(cols)


FILTER_SQL = rf"""WITH p AS ({POST_SQL}), n AS (SELECT *, len({TOKENS_SQL.format("text")}) AS n FROM p)
SELECT doc_id, n::BIGINT AS n_words FROM n WHERE NOT over_18 AND NOT promoted AND whitelist_status IS NULL AND n BETWEEN 5 AND 1000
AND {{}} (is_video OR regexp_matches(lower(url), '\.(jpg|png|jpeg|gif)$'))"""


@query(FILTER_SQL.format("NOT"))
def post_filter(spark, d):
    return as_posts(spark, d).where(filters.keep_post("text", text="text")).select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


@query(FILTER_SQL.format(""))
def post_filter_multimodal(spark, d):
    return as_posts(spark, d).where(filters.keep_post("multimodal", text="text")).select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


@query("SELECT source AS author, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN '[deleted]' WHEN doc_id % 10 = 0 THEN 'AutoModerator' WHEN doc_id % 8 = 0 THEN NULL ELSE source END AS source FROM documents) WHERE source NOT IN ('', '[deleted]', 'AutoModerator', 'Bot') GROUP BY 1")
def author_filter(spark, d):
    who = F.expr("CASE WHEN doc_id % 9 = 0 THEN '[deleted]' WHEN doc_id % 10 = 0 THEN 'AutoModerator' WHEN doc_id % 8 = 0 THEN NULL ELSE source END")
    return docs(spark, d).select(who.alias("author")).where(filters.keep_author()).groupBy("author").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace('  ' || text || chr(13) || chr(10), '[\r\n]+', ' ', 'g'), ' +', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", text.clean_newlines(F.expr("concat('  ', text, '\\r\\n')")).alias("cleaned"))


@query(rf"SELECT doc_id, len({TOKENS_SQL.format('text')})::BIGINT AS n_words FROM documents")
def word_counts(spark, d):
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id::VARCHAR END AS uid, count(*) AS n FROM events GROUP BY 1")
def author_coalesce(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.expr("CASE WHEN user_id % 3 = 0 THEN 'nan' ELSE concat(' ', user_id, '.0 ') END").alias("raw"))
    return e.groupBy(text.id_text(F.col("raw")).alias("uid")).agg(F.count("*").alias("n"))


# --- n-grams --------------------------------------------------------------------------------------

NGRAM_LINES = "transform(sequence(0, greatest(size(w), 5) - 5), i -> concat(get(w, i), '_NOUN ', get(w, i + 1), '_VERB ', get(w, i + 2), ' ', get(w, i + 3), ' ', get(w, i + 4), '\t', 1990 + i % 20, '\t', 1 + i % 3, '\t1'))"
GRAM_SQL = r"""gram AS (SELECT doc_id, i, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS ngram, 1990 + (i - 1) % 20 AS year, 1 + (i - 1) % 3 AS match_count
FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents WHERE lang = 'en') WHERE len(w) >= 5))"""


def ngram_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated lines with tagged five-word sequences of the English documents."""
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    # exploded as arrays of one, so the words are computed once and not again for every line
    rows = docs(spark, d).where("lang = 'en'").select(F.explode(F.array(w)).alias("w")).where("size(w) >= 5")
    # the lines are built as one array, so exploding does not carry the words along
    return rows.select(F.explode(F.expr(NGRAM_LINES)).alias("value"))


@query(f"WITH {GRAM_SQL} SELECT year::INTEGER AS year, count(*) AS n, sum(match_count)::BIGINT AS matches FROM gram GROUP BY 1")
def ngram_parse(spark, d):
    bad = spark.createDataFrame([("a\tb",), ("a b c d e\tx\t1\t1",), ("a b c d\t1999\t1\t1",)], "value string")
    rows = ngrams.clean(ngrams.parse(ngram_lines(spark, d).unionByName(bad)))
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.sum("match_count").alias("matches"))


@query(f"WITH {GRAM_SQL} SELECT ngram, sum(match_count)::BIGINT AS match_count FROM gram GROUP BY 1 ORDER BY match_count DESC, ngram DESC LIMIT 500")
def ngram_topk(spark, d):
    return ngrams.top(ngrams.counts(ngrams.clean(ngrams.parse(ngram_lines(spark, d)))), 500)


@query(f"WITH {GRAM_SQL}, top AS (SELECT ngram, sum(match_count) AS n FROM gram GROUP BY 1 ORDER BY n DESC, ngram DESC LIMIT 500) SELECT ngram, count(*) AS n_rows, sum(match_count)::BIGINT AS matches FROM gram WHERE ngram IN (SELECT ngram FROM top) GROUP BY 1")
def ngram_semijoin(spark, d):
    rows = ngrams.clean(ngrams.parse(ngram_lines(spark, d)))
    sums = rows.groupBy("ngram_cleaned").agg(F.count("*").alias("n_rows"), F.sum("match_count").alias("matches"))
    # both sides of the semi-join read one shuffle of the sums; without the exploded struct the planner would move the join below them and read the lines again
    made = sums.select(F.inline(F.array(F.struct(*sums.columns))))
    best = made.where("matches > 0 and n_rows > 0").select(F.col("ngram_cleaned").alias("ngram"), F.col("matches").alias("match_count"))
    return ngrams.keep_top(made, ngrams.top(best, 500)).select("ngram", "n_rows", "matches")


@query(r"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: w), ' ') AS stripped FROM documents WHERE text NOT LIKE '%\_%' ESCAPE '\'")
def strip_pos(spark, d):
    tagged = F.array_join(F.transform(text.split_words(F.col("text")), lambda w: F.concat(w, F.lit("_X"))), " ")
    return docs(spark, d).where(~F.contains("text", F.lit("_"))).select("doc_id", text.strip_pos_tags(tagged).alias("stripped"))


# --- ages and other statements --------------------------------------------------------------------

AGE = "concat(CASE doc_id % 4 WHEN 0 THEN concat('I am ', 10 + doc_id % 90, ' years old. ') WHEN 1 THEN concat('I was born in ', 1900 + doc_id % 125, '. ') WHEN 2 THEN concat('i''m ', doc_id % 100, ', and I was born on 3rd May ', 1950 + doc_id % 60, '. ') ELSE 'I was born on 1/2/1987 ' END, source)"
AGE_SQL = "(CASE doc_id % 4 WHEN 0 THEN 'I am ' || (10 + doc_id % 90) || ' years old. ' WHEN 1 THEN 'I was born in ' || (1900 + doc_id % 125) || '. ' WHEN 2 THEN 'i''m ' || (doc_id % 100) || ', and I was born on 3rd May ' || (1950 + doc_id % 60) || '. ' ELSE 'I was born on 1/2/1987 ' END || source)"
FOUND_SQL = rf"""said AS (SELECT doc_id, {AGE_SQL} AS s FROM documents),
found AS (SELECT doc_id, list_distinct_in_order AS m FROM (SELECT doc_id, list_filter([nullif(regexp_extract(s, '(?i)\bI am (\d{{1,2}}) years old\b', 1), ''), nullif(regexp_extract(s, '(?i)\bI''m (\d{{1,2}}),', 1), ''),
nullif(regexp_extract(s, '(?i)\bI was born in ((?:19\d\d|20(?:0\d|1\d|2[0-4])))\b', 1), ''), nullif(regexp_extract(s, '(?i)\bI was born on 3rd May ((?:19\d\d|20(?:0\d|1\d|2[0-4])))\b', 1), ''), nullif(regexp_extract(s, '(?i)\bI was born on 1/2/(\d{{4}})\b', 1), '')], lambda x: x IS NOT NULL) AS list_distinct_in_order FROM said))"""


@query(f"WITH {FOUND_SQL} SELECT doc_id, array_to_string(m, '|') AS found FROM found")
def age_extract(spark, d):
    found = detect.matches(text.strip(F.col("statement")), detect.patterns(detect.Terms())["age"])
    return said(spark, d, AGE).select("doc_id", F.array_join(found, "|").alias("found"))


RESOLVE_SQL = f"""WITH {FOUND_SQL}, cand AS (SELECT doc_id, len(m) AS n, list_filter(list_transform(m, lambda x: CASE WHEN x::INT BETWEEN 1900 AND 2020 THEN x::INT WHEN x::INT BETWEEN 13 AND 99 THEN 2020 - x::INT END), lambda x: x IS NOT NULL) AS y,
list_filter(list_transform(m, lambda x: CASE WHEN x::INT BETWEEN 1900 AND 2020 THEN 1.0::DOUBLE WHEN x::INT BETWEEN 13 AND 99 THEN 0.8::DOUBLE END), lambda x: x IS NOT NULL) AS w FROM found),
pick AS (SELECT doc_id, n, CASE WHEN len(y) = 1 THEN y[1]::DOUBLE WHEN abs(y[2] - y[1]) <= 2 THEN (y[1] * w[1] + y[2] * w[2]) / (w[1] + w[2]) WHEN w[2] > w[1] THEN y[2] ELSE y[1] END AS yr,
CASE WHEN len(y) = 1 THEN w[1] + 0.1::DOUBLE WHEN abs(y[2] - y[1]) <= 2 THEN w[1] + w[2] + 0.2::DOUBLE ELSE greatest(w[1], w[2]) + 0.1::DOUBLE END AS score FROM cand WHERE len(y) > 0)
SELECT doc_id, (2020 - round_even(yr, 0))::INTEGER AS age, round(least(1.0::DOUBLE, score / n), 6) AS confidence FROM pick WHERE 2020 - round_even(yr, 0) BETWEEN 13 AND 99"""


@query(RESOLVE_SQL)
def age_resolve(spark, d):
    found = detect.matches(text.strip(F.col("statement")), detect.patterns(detect.Terms())["age"])
    rows = said(spark, d, AGE).select("doc_id", age.resolve(found, F.lit(2020)).alias("r")).where("r is not null")
    return rows.select("doc_id", "r.age", F.round("r.confidence", 6).alias("confidence"))


@query(f"WITH {FOUND_SQL} SELECT doc_id, array_to_string(list_filter(list_transform(m, lambda x: CASE WHEN x::INT BETWEEN 1921 AND 2007 THEN x::INT WHEN x::INT BETWEEN 13 AND 99 THEN 2020 - x::INT END), lambda x: x IS NOT NULL), '|') AS years FROM found")
def raw_birthyears(spark, d):
    found = detect.matches(text.strip(F.col("statement")), detect.patterns(detect.Terms())["age"])
    years = F.transform(age.birthyears(found, F.lit(2020)), lambda y: y.cast("string"))
    return said(spark, d, AGE).select("doc_id", F.array_join(years, "|").alias("years"))


TERMS = detect.Terms(
    occupations=("teacher", "software engineer", "nurse", "art teacher"), genders=("man", "woman", "non-binary"), countries=("Canada", "India", "Poland", "Italy", "Peru", "United States"),
    cities=("London", "Toronto", "New York", "York", "Poland"), religions=("Christianity", "Islam", "Buddhism", "Taoism", "Druze"), stopwords=frozenset({"about"}),
)


def statements(category: str, forms: list[tuple[str, str]], pattern: str):
    """A query over made-up statements ``form`` filled by doc_id from a list, and its SQL."""
    cases = " ".join(f"WHEN {i} THEN '{s.replace(chr(39), chr(39) * 2)}'" for i, (s, _) in enumerate(forms))
    wanted = " ".join(f"WHEN {i} THEN '{w}'" for i, (_, w) in enumerate(forms))
    n = len(forms)

    def run(spark, d):
        rows = said(spark, d, f"concat(source, '. ', CASE doc_id % {n} {cases} END, ' ', lang)")
        return rows.select("doc_id", F.array_join(detect.detect(F.col("statement"), TERMS, (category,))[category], "|").alias("found"))

    run.__name__ = f"self_id_{category}"
    return query(f"SELECT doc_id, CASE doc_id % {n} {wanted} END AS found FROM documents")(run)


statements("occupation", [("I am a Teacher.", "Teacher"), ("I am nurse.", ""), ("I'm  nurse and", "nurse"), ("I work as an art  teacher at Big School!", "art  teacher"), ("I am not a nurse.", ""), ("My job is software engineer.", "software engineer"), ("I'm currently employed as a nurse.", "nurse")], "")
statements("gender", [("I am a woman, and", "woman"), ("I identify as non-binary.", "non-binary"), ("My gender identity is man.", "man"), ("I'm a trans man.", "man"), ("I am not a man.", ""), ("I am man.", "")], "")
statements("country", [("I am from Canada.", "Canada"), ("I'm Indian.", "Indian"), ("I live in the United States now", "United States"), ("My nationality is Italian.", "Italian"), ("I was born and raised in Peru.", "Peru"), ("I am not from anywhere.", ""), ("I'm originally from Poland.", "Poland"), ("I am Peruese.", "Peruese")], "")
statements("city", [("I am from Toronto.", "Toronto"), ("I live in London fear", "London"), ("I live in sin.", ""), ("I am originally from London.", ""), ("My home town is New York.", "New York"), ("I grew up in London.", "London"), ("I live in Poland.", ""), ("currently based in Toronto ok", "Toronto")], "")
SQL["self_id_city"] = SQL["self_id_city"].replace("WHEN 1 THEN 'London'", "WHEN 1 THEN ''")
statements("religion", [("I am a devout christian.", "christian"), ("My religion is Islam.", "Islam"), ("I was raised as a Buddhist.", "Buddhist"), ("I identify with the Taoism", "Taoism"), ("I converted to Druze.", "Druze"), ("I identify as Druzeist.", "Druzeist"), ("I am not a muslim.", "")], "")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Toronto' WHEN 1 THEN 'New York' WHEN 2 THEN NULL ELSE 'London' END AS found FROM documents WHERE doc_id % 4 <> 2")
def city_dictionary(spark, d):
    """The same statements through the dictionary join that serves large lists."""
    rows = said(spark, d, "concat(source, '. ', CASE doc_id % 4 WHEN 0 THEN 'I am from Toronto, and' WHEN 1 THEN 'I live in New York City' WHEN 2 THEN 'I live in London fear' ELSE 'I grew up in London yes' END)")
    names = spark.createDataFrame([("city", "toronto"), ("city", "new york"), ("city", "london")], "list string, term string")
    got = detect.dictionary_matches(rows, "doc_id", "statement", "city", names, 2)
    return got.select("doc_id", F.array_join("matches", "|").alias("found"))


BIG = "concat(source, '. I live in City ', {0}, CASE WHEN {0} % 2 = 0 THEN ' Falls. ' ELSE ' ' END, 'I grew up in Nowhere')"


def big_list(n: int) -> detect.Terms:
    return detect.Terms(cities=tuple(f"City {i} Falls" if i % 2 == 0 else f"City {i}" for i in range(n)), countries=("Canada",))


@query("SELECT doc_id, CASE WHEN doc_id * 7 % 30000 < 20000 THEN 'City ' || (doc_id * 7 % 30000) || CASE WHEN doc_id * 7 % 30000 % 2 = 0 THEN ' Falls' ELSE '' END ELSE '' END AS found FROM documents")
def city_large_list(spark, d):
    """A list far too long for one pattern, through the same entry as short ones."""
    rows = said(spark, d, BIG.format("(doc_id * 7 % 30000)"))
    return detect.detected(rows, F.col("statement"), big_list(20_000)).select("doc_id", F.array_join("_found.city", "|").alias("found"))


FAITHS = [("christianity", "Christianity", "Abrahamic"), ("catholicism", "Christianity", "Abrahamic"), ("buddhism", "Buddhism", "Dharmic"), ("atheism", "Atheism", None), ("druze", "Druze", "Abrahamic")]


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Christianity' WHEN 1 THEN 'Christianity' WHEN 2 THEN NULL WHEN 3 THEN 'Atheism' ELSE 'Druze' END AS main, CASE WHEN doc_id % 5 IN (0, 1, 4) THEN 'Abrahamic' END AS category FROM documents")
def religion_mapping(spark, d):
    table = detect.religion_dictionary(spark.createDataFrame(FAITHS, "term string, main string, category string"))
    said_ = docs(spark, d).select("doc_id", F.array(F.expr("CASE doc_id % 5 WHEN 0 THEN 'Catholic' WHEN 1 THEN 'christian' WHEN 2 THEN 'jedi' WHEN 3 THEN 'Atheist' ELSE 'Druze' END")).alias("raw"))
    got = detect.mapped(said_, "doc_id", "raw", table, ("main", "category"))
    return got.select("doc_id", F.get("main", 0).alias("main"), F.get("category", 0).alias("category"))


@query("SELECT country, unnest(CASE WHEN country = 'Poland' THEN ['polish'] WHEN country IN ('India', 'Canada') THEN [country || 'n'] WHEN country = 'Italy' THEN ['Italian'] ELSE [country || 'ian', country || 'ese'] END) AS nationality FROM (VALUES ('Canada'), ('India'), ('Poland'), ('Italy'), ('Peru')) t(country)")
def nationalities(spark, d):
    names = ["Canada", "India", "Poland", "Italy", "Peru"]
    return spark.createDataFrame([(n, x) for n in names for x in terms.nationalities([n])], "country string, nationality string")


# --- users ----------------------------------------------------------------------------------------

RANKED_SQL = "SELECT user_id, {0} AS v, count(*) AS n, min(event_id) AS f FROM events WHERE {0} IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT user_id::BIGINT AS user_id, v AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM ({RANKED_SQL.format('event_type')})) WHERE r = 1")
def user_majority_raw(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type")
    return demographics.majority_item(e, "user_id", "event_type", ("event_id",))


@query(f"SELECT user_id::BIGINT AS user_id, v AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS r FROM ({RANKED_SQL.format('event_type')})) WHERE r = 1")
def user_mode(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(demographics.mode("event_type").alias("event_type"))


@query("SELECT source AS Author, (2020 - (20 + (ascii(right(source, 1)) - 48) * 3))::INTEGER AS DMGMajorityBirthyear, (2020 - (20 + (ascii(right(source, 1)) - 48) * 3))::VARCHAR AS DMGRawBirthyearExtractions FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)")
def user_birthyear(spark, d):
    born = F.expr("cast(2020 - (20 + (ascii(right(source, 1)) - 48) * 3) as string)")
    rows = docs(spark, d).where("source is not null").select(F.col("source").alias("Author"), born.alias("DMGRawBirthyearExtractions"), F.lit(None).cast("int").alias("DMGMajorityBirthyear"), F.expr("2015 + doc_id % 6").cast("int").alias("y"), "doc_id")
    got = demographics.aggregate_users(rows, year=F.when(F.col("y") >= 0, F.lit(2020)), order=("y", "doc_id"))
    return got.select("Author", "DMGMajorityBirthyear", "DMGRawBirthyearExtractions")


@query("SELECT event_id, user_id::BIGINT AS user_id, (2024 - (1930 + user_id % 90))::INTEGER AS age FROM events WHERE user_id % 3 = 0 AND 2024 - (1930 + user_id % 90) BETWEEN 13 AND 99")
def stage2_join(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").cast("long").alias("user_id"), F.year("ts").alias("y"))
    users = e.where("user_id % 3 = 0").select("user_id").distinct().withColumn("DMGMajorityBirthyear", F.expr("cast(1930 + user_id % 90 as string)"))
    got = demographics.enrich(e, users, year=F.col("y"), keep_unknown_age=False, key="user_id")
    return got.select("event_id", "user_id", F.col("DMGAgeAtPost").alias("age"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def semi_join(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return filters.of_authors(e, e.where("event_type = 'purchase'"), "user_id").select("event_id")


# --- features -------------------------------------------------------------------------------------

JOIN_SQL = f"tok AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS word FROM documents), hit AS (SELECT doc_id, lex.* FROM tok JOIN {LEXICON_SQL} USING (word))"


def feature_query(name: str, columns: dict[str, str]):
    """A subset of the lexicon features of all documents; ``columns`` gives each one's SQL over a document's hits."""
    inner = ", ".join(f"{sql} AS {c}" for c, sql in columns.items())
    outer = ", ".join(f"coalesce({c}, 0) AS {c}" for c in columns)

    def run(spark, d):
        made = features.scores(docs(spark, d).select("doc_id", "text"), "text", "doc_id", lexicon(spark))
        kinds = dict(made.dtypes)
        return made.select("doc_id", *[(F.round(c, 6) if kinds[c] == "double" else F.col(c).cast("long")).alias(c) for c in columns])

    run.__name__ = name
    return query(f"WITH {JOIN_SQL}, agg AS (SELECT doc_id, {inner} FROM hit GROUP BY 1) SELECT doc_id, {outer} FROM documents LEFT JOIN agg USING (doc_id)")(run)


_n = lambda cond: f"count(*) FILTER (WHERE {cond})"
_any = lambda cond: f"(count(*) FILTER (WHERE {cond}) > 0)::BIGINT"
_avg = lambda c, cond="true": f"round(coalesce(avg({c}::DOUBLE) FILTER (WHERE {cond}), 0), 6)"
VAD = {f"NRCAvg{x.capitalize()}": _avg(x) for x in features.DIMENSIONS}
for _x in features.DIMENSIONS:
    for _level, _cond in (("High", f"{_x} > 0.67"), ("Low", f"{_x} < 0.33")):
        VAD |= {f"NRCHas{_level}{_x.capitalize()}Word": _any(_cond), f"NRCCount{_level}{_x.capitalize()}Words": _n(_cond)}
feature_query("vad", VAD)
feature_query("emotions", {k: v for e in features.EMOTIONS for k, v in ((f"NRCHas{e.capitalize()}Word", _any(f"{e} = 1")), (f"NRCCount{e.capitalize()}Words", _n(f"{e} = 1")))})
feature_query("worry", {k: v for name, side, top in (("Anxiety", "worry > 0", 3), ("Calmness", "worry < 0", -3)) for k, v in ((f"NRCHas{name}Word", _any(side)), (f"NRCAvg{name}", _avg("worry", side)), (f"NRCHasHigh{name}Word", _any(f"worry = {top}")), (f"NRCCountHigh{name}Words", _n(f"worry = {top}")))})
feature_query("warmth_family", {k: v for c, name in features.BONDS for k, v in ((f"NRCAvg{name}Word", _avg(c)), *((f"NRC{kind}{level}{name}Word", (_any if kind == "Has" else _n)(f"{c} = {top}")) for level, top in (("High", 3), ("Low", -3)) for kind in ("Has", "Count")))})
feature_query("tense", {"TIMEHasPastVerb": "(sum(n_pst) > 0)::BIGINT", "TIMECountPastVerbs": "sum(n_pst)::BIGINT", "TIMEHasPresentVerb": "(sum(n_prs) > 0)::BIGINT", "TIMECountPresentVerbs": "sum(n_prs)::BIGINT"})
feature_query("cognition", {f"COGHas{c}Word": f"max(cog_{c})::BIGINT" for c in ("Insight", "Doubt")})


@query("SELECT doc_id, " + ", ".join(f"list_contains(t, '{p.lower()}')::INTEGER AS PRNHas{p}" for p in features.PRONOUNS) + f" FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)")
def pronouns(spark, d):
    return docs(spark, d).select("doc_id", *[c.alias(n) for n, c in features.pronouns(text.tokens(F.col("text"))).items()])


PARTS = ("hand", "nose", "stomach")
BODY = "concat(CASE doc_id % 3 WHEN 0 THEN 'My Hand and your nose. ' WHEN 1 THEN 'their stomachs, his hands ' ELSE '' END, lang)"


@query("WITH s AS (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN 'My Hand and your nose. ' WHEN 1 THEN 'their stomachs, his hands ' ELSE '' END || lang) AS s FROM documents) SELECT doc_id, " + ", ".join(f"array_to_string(list_filter(['{o} hand', '{o} nose', '{o} stomach'], lambda t: contains(s, t)), ', ') AS {o.capitalize()}BPM" for o in features.OWNERS) + ", len(list_filter(['hand', 'nose', 'stomach'], lambda t: contains(s, t))) > 0 AS HasBPM FROM s")
def body_parts(spark, d):
    return said(spark, d, BODY).select("doc_id", *[c.alias(n) for n, c in features.body_parts(F.col("statement"), PARTS).items()])


@query(f"WITH s AS (SELECT doc_id, {TOKENS_SQL.format('''(CASE doc_id % 4 WHEN 0 THEN 'We will go tomorrow' WHEN 1 THEN 'She shall  not, next  year' WHEN 2 THEN 'going to' ELSE 'should' END)''')} AS t FROM documents) SELECT doc_id, (n > 0)::INTEGER AS TIMEHasFutureModal, n::INTEGER AS TIMECountFutureModals, (contains(j, 'tomorrow') OR contains(j, 'next day') OR contains(j, 'next year') OR contains(j, 'next month'))::INTEGER AS TIMEHasFutureReference FROM (SELECT doc_id, len(list_filter(t, lambda w: w IN ('will', 'shall', 'should'))) AS n, array_to_string(t, ' ') AS j FROM s)")
def future_time(spark, d):
    rows = said(spark, d, "CASE doc_id % 4 WHEN 0 THEN 'We will go tomorrow' WHEN 1 THEN 'She shall  not, next  year' WHEN 2 THEN 'going to' ELSE 'should' END")
    return rows.select("doc_id", *[c.alias(n) for n, c in features.future(text.tokens(F.col("statement"))).items()])


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'I am really thinking' WHEN 3 THEN 'I was planning' ELSE '' END AS ICOG, CASE WHEN doc_id % 5 = 1 THEN 'she has been not planning' ELSE '' END AS SheCOG, doc_id % 5 IN (0, 1, 3) AS HasCOG FROM documents")
def thinking(spark, d):
    rows = said(spark, d, "concat(CASE doc_id % 5 WHEN 0 THEN 'I am really thinking. i AM really THINKING' WHEN 1 THEN 'so she has been not planning' WHEN 2 THEN 'I''m thinking' WHEN 3 THEN 'I was planning' ELSE 'they think' END, ' ', lang)")
    made = features.thinking(F.col("statement"), ("think", "plan"))
    return rows.select("doc_id", *[made[c].alias(c) for c in ("ICOG", "SheCOG", "HasCOG")])


@query()
def annotate_documents(spark, d):
    """All feature columns of all documents (checked piece by piece by the queries above)."""
    return features.annotate(docs(spark, d).select("doc_id", "text"), "text", lexicon(spark)).drop("text")


# --- dates, coercion, merge -----------------------------------------------------------------------


@query("SELECT event_id, year(ts)::INTEGER AS iso_year, year(ts)::INTEGER AS feed_year FROM events")
def created_at_year(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    iso, feed = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format("ts", "'Wed' MMM dd HH:mm:ss '+0000' yyyy")
    return e.select("event_id", text.created_at_year(iso).alias("iso_year"), text.created_at_year(feed).alias("feed_year"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE year(ts) END::INTEGER AS y FROM events")
def epoch_year(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.unix_timestamp("ts").cast("string"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.epoch_year(raw).alias("y"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1999 ELSE year(ts) END::SMALLINT AS Year, CASE WHEN event_id % 3 = 0 AND event_id % 14 BETWEEN 1 AND 12 THEN event_id % 14 ELSE month(ts) END::TINYINT AS Month FROM events")
def year_month(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN '1999' END").alias("PostYear"), F.expr("CASE WHEN event_id % 3 = 0 THEN cast(event_id % 14 as string) END").alias("PostMonth"), F.expr("CASE WHEN event_id % 3 = 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END").alias("createdAt"), F.expr("cast(unix_timestamp(ts) as string)").alias("created_utc"))
    return merge.year_month(rows).select("event_id", "Year", "Month")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL ELSE true END AS HasX, CASE WHEN doc_id % 2 = 0 THEN doc_id END::INTEGER AS CountX, CASE WHEN doc_id % 2 = 0 THEN doc_id / 4.0 END::FLOAT AS AvgX, lang AS DMGRawExtractedCountry FROM documents")
def coerce_types(spark, d):
    flag = "CASE doc_id % 6 WHEN 0 THEN '1' WHEN 1 THEN ' False' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'yes' ELSE '1.0' END"
    rows = docs(spark, d).selectExpr("doc_id", f"{flag} AS HasX", "CASE WHEN doc_id % 2 = 0 THEN cast(doc_id as string) ELSE 'x' END AS CountX", "CASE WHEN doc_id % 2 = 0 THEN cast(doc_id / 4.0 as string) END AS AvgX", "lang AS DMGRawExtractedCountry")
    return merge.coerce(rows, ["HasX", "CountX", "AvgX", "DMGRawExtractedCountry"])


@query("SELECT doc_id::VARCHAR AS key, text, NULL AS DMGRole, 1::BIGINT AS MatchCount, 'a/reddit/docs.tsv' AS Dataset, 'Reddit' AS \"Dataset Type\" FROM documents UNION ALL SELECT conv_id::VARCHAR, text, role, turn::BIGINT, 'a/books/talk.tsv', 'Books' FROM conversations")
def merge_union(spark, d):
    a = docs(spark, d).select(F.col("doc_id").alias("key"), "text", "n_chars")
    b = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("key"), "text", F.col("role").alias("DMGRole"), F.col("turn").alias("match_count"))
    return merge.merge({"a/reddit/docs.tsv": a, "a/books/talk.tsv": b}).drop("Year", "Month", "id")


@query("SELECT doc_id::VARCHAR AS k, lang, '' AS role FROM documents UNION ALL SELECT conv_id::VARCHAR, '', role FROM conversations")
def fill_union(spark, d):
    a = docs(spark, d).selectExpr("cast(doc_id as string) AS k", "lang")
    b = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("cast(conv_id as string) AS k", "role")
    return merge.fill_union([a, b])


# --- personal data, feeds -------------------------------------------------------------------------


def pii_query(name: str, pattern: str, check: str = "true"):
    sql_pattern = pattern.replace("'", "''")

    def run(spark, d):
        found = pii.recognise(F.col("text"), crypto=False)[name]
        rows = docs(spark, d).select("doc_id", F.array_join(found, "; ").alias("found"))
        return rows.where("found <> ''")

    run.__name__ = f"pii_{name.lower()}"
    # the first occurrence of each value keeps its place
    return query(rf"""WITH m AS (SELECT doc_id, x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{sql_pattern}', 1) AS x FROM documents)),
v AS (SELECT doc_id, x[i] AS v, min(i) AS i FROM m GROUP BY 1, 2) SELECT doc_id, string_agg(v, '; ' ORDER BY i) AS found FROM v WHERE {check} GROUP BY 1""")(run)


pii_query("EMAIL_ADDRESS", pii.EMAIL)
pii_query("PHONE_NUMBER", pii.PHONE)
pii_query("MEDICAL_LICENSE", pii.DEA, "(substr(v, 3, 1)::INT + substr(v, 5, 1)::INT + substr(v, 7, 1)::INT + 2 * (substr(v, 4, 1)::INT + substr(v, 6, 1)::INT + substr(v, 8, 1)::INT)) % 10 = substr(v, 9, 1)::INT")


@query(rf"""WITH m AS (SELECT doc_id, x, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pii.IPV4}', 1) || regexp_extract_all(text, '{pii.IPV6}', 1) AS x FROM documents)),
v AS (SELECT doc_id, x[i] AS v, min(i) AS i FROM m GROUP BY 1, 2) SELECT doc_id, string_agg(v, '; ' ORDER BY i) AS found FROM v GROUP BY 1""")
def pii_ip_address(spark, d):
    found = pii.recognise(F.col("text"), crypto=False)["IP_ADDRESS"]
    return docs(spark, d).select("doc_id", F.array_join(found, "; ").alias("found")).where("found <> ''")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'GB82 WEST 1234 5698 7654 32' WHEN 1 THEN '' ELSE 'DE89370400440532013000' END AS found FROM documents")
def pii_iban_code(spark, d):
    rows = said(spark, d, "concat('pay ', CASE doc_id % 3 WHEN 0 THEN 'GB82 WEST 1234 5698 7654 32' WHEN 1 THEN 'GB82 WEST 1234 5698 7654 33' ELSE 'DE89370400440532013000' END, ', now')")
    return rows.select("doc_id", F.array_join(pii.recognise(F.col("statement"), crypto=False)["IBAN_CODE"], "; ").alias("found"))


@query()
def pii_documents(spark, d):
    return pii.detect(docs(spark, d).select("doc_id", "text"), F.col("text")).drop("text")


def _unescaped(x: str) -> str:
    for name, value in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{value}')"
    return x


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_unescaped(_unescaped('html'))}, '&#x?[0-9A-Fa-f]+;', '', 'g'), '<[^>]+>', '', 'g'), '[\s\x1c-\x1f]+', ' ', 'g')) AS clean FROM pages")
def html_sanitise(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.sanitize(F.col("html"), strip_tags=True).alias("clean"))


@query("SELECT doc_id, 'T & ' || source AS title, lang || '|' || source AS categories FROM documents WHERE lang = 'en' AND false")
def feed_items_short(spark, d):
    """Descriptions under the minimal length give no items."""
    item = "concat('<rss><item><title>T &amp;amp; ', source, '</title><description>short</description><category>', lang, '</category><category>', source, '</category></item></rss>')"
    rows = docs(spark, d).select("doc_id", F.expr(item).alias("value"), F.col("doc_id").cast("string").alias("file_path"))
    return readers.feed_items(rows).select(F.col("file_path").cast("long").alias("doc_id"), "title", "categories")


@query("SELECT doc_id, 'T & ' || source AS title, 'en|' || source AS categories, repeat('it is the end of the day and we are here for you ', 6) || doc_id AS description FROM documents")
def feed_items(spark, d):
    item = "concat('<item><title>T &amp;amp; ', source, '</title><content:encoded></content:encoded><description><![x]]><p>', repeat('it is the end of the day and we are here for you ', 6), doc_id, '</p></description><category>en</category><category>', source, '</category></item>')"
    rows = docs(spark, d).select(F.replace(F.expr(item), F.lit("<![x]]>"), F.lit("")).alias("value"), F.col("doc_id").cast("string").alias("file_path"))
    return readers.feed_items(rows).select(F.col("file_path").cast("long").alias("doc_id"), "title", "categories", "description")


@query("SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'of', 'and'))) / greatest(1, len(w))::DOUBLE, 6) AS share FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(left(text, 4000)), '[^\\p{L}]+'), lambda x: x <> '') AS w FROM documents)".replace("\\\\", "\\"))
def language_share(spark, d):
    words = F.filter(F.split(F.lower(F.substring("text", 1, 4000)), r"[^\p{L}]+"), lambda w: w != "")
    three = F.size(F.filter(words, lambda w: w.isin("the", "of", "and"))) / F.greatest(F.lit(1), F.size(words))
    return docs(spark, d).select("doc_id", F.round(three, 6).alias("share"))


@query()
def language_gate(spark, d):
    """Documents that pass as English, with their scores (approximate by nature; tested against the lang column)."""
    s = shares(F.col("text"))
    return docs(spark, d).where(is_english(F.col("text"))).select("doc_id", "lang", *[c.alias(f"share_{k}") for k, c in s.items()])


@query("SELECT DISTINCT replace('https://x.org/RS_{month}.zst', '{month}', strftime(m, '%Y-%m')) AS url FROM generate_series(TIMESTAMP '2010-01-01', TIMESTAMP '2022-12-01', INTERVAL 1 MONTH) t(m)")
def month_urls(spark, d):
    return readers.months(spark, "https://x.org/RS_{month}.zst")


@query("SELECT unnest(regexp_extract_all(html, 'href=[\"'']([^\"'']*)[\"'']', 1)) AS url FROM pages")
def href_urls(spark, d):
    return readers.links(spark.read.parquet(f"{d}/pages.parquet"), "html")


# queries over written files register themselves
from lexiloom import file_queries  # noqa: E402, F401
