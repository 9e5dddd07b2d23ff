import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiloom import schema
from lexiloom.functions.text import strip
from lexiloom.operators import demographics, detect, features, filters, merge, ngrams, pii
from lexiloom.plans import corpora, social
from lexiloom.sources import lexicons, readers, sinks
from lexiloom.streaming import streams

TERMS = detect.Terms(occupations=("teacher", "nurse"), genders=("man", "woman"), countries=("Canada", "Italy"), cities=("Toronto", "New York"), religions=("Islam", "Taoism"))


def found(spark, text, category, terms=TERMS):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(detect.detect(F.col("t"), terms)[category]).first()[0]


@pytest.mark.parametrize(
    "text, category, want",
    [
        ("I am 25 years old", "age", ["25"]),
        ("i'm 25", "age", ["25"]),
        ("I am 25 and happy", "age", ["25"]),
        ("I am 25 dogs", "age", []),
        ("I'm born in '98.", "age", ["98"]),
        ("I was born on the 5th", "age", []),
        ("I was born on 5th March, 1990", "age", []),
        ("I was born on March 5th, 1990", "age", ["1990"]),
        ("I am nurse", "occupation", []),
        ("I am  nurse", "occupation", ["nurse"]),
        ("I am looking for a nurse", "occupation", []),
        ("I'm Italian, I am from the Canada", "country", ["Canada", "Italian"]),
        ("I live in New  York", "city", ["New  York"]),
        ("I identify with the Taoism", "religion", ["Taoism"]),
        ("I'm a muslim who", "religion", ["muslim"]),
        ("", "age", []),
        (None, "age", []),
    ],
)
def test_detection(spark, text, category, want):
    assert found(spark, text, category) == want


def test_empty_lists_match_nothing(spark):
    assert found(spark, "I am a . I live in ", "city", detect.Terms()) == []


def test_dictionary_backs_off_to_shorter_terms(spark):
    df = spark.createDataFrame([(1, "I am from New York City, and"), (2, "I am from New York Citadel"), (3, "I live in York fear")], "k int, t string")
    names = spark.createDataFrame([("new york",), ("new york city",), ("york",)], "term string")
    got = {r.k: r.matches for r in detect.dictionary_matches(df, "k", "t", "city", names.selectExpr("'city' AS list", "lower(term) AS term"), 3).collect()}
    assert got == {1: ["New York City"], 2: ["New York"]}


def posts(spark, tmp_path, rows):
    d = tmp_path / "in"
    d.mkdir()
    (d / "RS_1").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n[1]\n\n")
    return readers.posts(spark, str(d))


BODY = "some words that make the body long enough"


def submission(i, author, text, ts=1600000000, **more):
    return {"id": str(i), "author": author, "title": "t", "selftext": text, "created_utc": ts, "score": i, "subreddit": "s", "num_comments": 0, "permalink": f"/{i}", "url": "http://x"} | more


def test_two_stages_of_posts(spark, tmp_path):
    rows = [
        submission(1, "ann", f"I am 30 years old. {BODY}"),
        submission(2, "ann", f"I am 31 years old, I am a nurse. {BODY}", str(1631536000)),
        submission(3, "bob", f"I am a teacher. {BODY}"),
        submission(4, "[deleted]", f"I am 20 years old. {BODY}"),
        submission(5, "ann", f"no statement, i was thinking {BODY}"),
        submission(6, "eve", f"I am 40 years old. {BODY}", over_18=True),
        submission(7, "eve", "I am 40", promoted=None),
        submission(8, None, f"I am 40 years old. {BODY}"),
        submission(9, "cat", None),
    ]
    p = posts(spark, tmp_path, rows)
    assert p.count() == 9
    users = social.post_users(p, TERMS, {"occupation": {"nurse": "Registered Nurses"}})
    assert users.columns == list(schema.users_columns("posts"))
    assert sorted(r.PostID for r in users.collect()) == ["1", "2", "3"]
    assert [r.PostID for r in social.post_users(p, TERMS, require_age=True).orderBy("PostID").collect()] == ["1", "2"]
    table = social.user_table(social.stored_form(users), "posts")
    got = {r.Author: r for r in table.collect()}
    assert got["ann"].DMGMajorityBirthyear == 1990 and got["ann"].DMGRawBirthyearExtractions == "1990"
    assert got["ann"].DMGSOCTitleMappedFromExtractedOccupation == "registered nurses"
    assert got["bob"].DMGMajorityBirthyear is None
    words = spark.createDataFrame([("words", 0.9, 3)], "word string, valence double, worry int")
    lex = features.Lexicons(lexicons.wide([words], spark), ("body",), ("think",))
    out = social.user_posts(p, table, lex)
    assert out.columns == list(schema.posts_columns("posts", tuple(features.feature_names())))
    made = {r.PostID: r for r in out.collect()}
    assert sorted(made) == ["1", "2", "5"]  # bob has no birth year
    assert made["5"].DMGAgeAtPost == 30 and made["5"].ICOG == "i was thinking" and made["5"].HasBPM and made["5"].NRCHasHighValenceWord == 1


def test_messages_keep_unknown_ages(spark, tmp_path):
    rows = [(1, "I am 20 years old", "2015-04-10T02:47:38.000Z", 10.0), (2, "I am a nurse, here", None, 11.0), (3, " ", "2016-04-10T02:47:38.000Z", 10.0), (4, "hello there", "2016-04-10T02:47:38.000Z", 11.0)]
    spark.createDataFrame(rows, "TweetID long, Tweet string, createdAt string, UserID double").write.parquet(str(tmp_path / "country.parquet"))
    m = readers.messages(spark, str(tmp_path / "country.parquet"))
    assert readers.split_name(str(tmp_path / "country.parquet")) == "country"
    users = social.message_users(m, TERMS)
    assert sorted(r.Author for r in users.collect()) == ["10", "11"]
    table = social.user_table(social.stored_form(users), "messages")
    lex = features.Lexicons(lexicons.wide([spark.createDataFrame([("x", 1)], "word string, worry int")], spark))
    got = {r.PostID: r.DMGAgeAtPost for r in social.user_messages(m, table, lex).collect()}
    assert got == {1: 20, 2: None, 4: None}


def test_post_pii(spark, tmp_path):
    p = posts(spark, tmp_path, [submission(1, "a", f"mail me x@y.org or x@y.org {BODY}"), submission(2, "b", BODY)])
    out = social.post_pii(p)
    assert out.columns == ["Author", *schema.POST_COLUMNS, *schema.PII_COLUMNS]
    (row,) = out.collect()
    assert (row.PII_EMAIL_ADDRESS, row.PII_Types_Found, row.PII_Count, row.Has_PII) == ("x@y.org", "EMAIL_ADDRESS", 1, True)


def test_pii_checksums(spark):
    text = "IBAN GB82WEST12345698765432 not GB82WEST12345698765433; dea AB1234563 not AB1234564; ip 10.0.0.1 not 10.0.0.256; 1BoatSLRHtKNngkdXEeobR76b53LETtpyT not 1BoatSLRHtKNngkdXEeobR76b53LETtpyX; call +1 (415) 555-0132"
    row = pii.detect(spark.createDataFrame([(text,), (None,)], "t string"), F.col("t")).first()
    assert row.PII_IBAN_CODE == "GB82WEST12345698765432"
    assert row.PII_MEDICAL_LICENSE == "AB1234563"
    assert row.PII_IP_ADDRESS == "10.0.0.1"
    assert row.PII_CRYPTO == "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"
    assert row.PII_PHONE_NUMBER == "+1 (415) 555-0132"


def test_majority_ties(spark):
    df = spark.createDataFrame([("a", 1, "x|y"), ("a", 2, "y| x |"), ("b", 1, ""), (None, 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in demographics.majority_item(df, "k", "v", ("o",)).collect()} == {"a": "x"}
    assert demographics.majority_item(df.where("false"), "k", "v", ("o",)).count() == 0


def test_ngrams(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    (d / "x-5gram-1").write_text("a_X b c d e\t1990\t3\t1\na b c d e\t1991\t2\t1\na b c d f\t1990\t5\t1\nz z z z z\t1990\t0\t1\nbad\tline\na b c d\t1990\t9\t1\nq q q q q\tx\t1\t1\n")
    assert [(r.ngram, r.match_count) for r in corpora.top_ngrams(spark, str(d), 5).collect()] == [("a b c d f", 5), ("a b c d e", 5)]
    lex = features.Lexicons(lexicons.wide([spark.createDataFrame([("a", 3)], "word string, worry int")], spark))
    rows = corpora.annotated_top_ngrams(spark, str(d), lex, 1).collect()
    assert [(r.ngram, r.NRCCountHighAnxietyWords, r.WordCount) for r in rows] == [("a b c d f", 1, 5)]


def test_partitions_do_not_change_counts(spark):
    df = spark.range(1000).selectExpr("concat('w', id % 7) AS ngram_cleaned", "1L AS match_count")
    want = sorted(map(tuple, ngrams.counts(df.coalesce(1)).collect()))
    assert sorted(map(tuple, ngrams.counts(df.repartition(9)).collect())) == want


def test_lexicon_loaders(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    vad = lexicons.vad(spark, w("vad", "Term\tv\ta\td\nHappy\t0.9\t0.5\t0.6\nhappy\t0.8\t0.5\t0.6\n"))
    emo = lexicons.emotions(spark, w("emo", "happy\tjoy\t1\nhappy\tfear\t0\nsad\tsadness\t1\n"))
    num = lexicons.number(spark, w("num", "Term\tx\tv\nhappy\t-\t-3\n"), "worry")
    tense = lexicons.tenses(spark, w("tense", "go\twent\tV;PST\ngo\tWent\tV;PRS;PST\ngo\tgoes\tV;PRS\n"))
    cog, names, verbs = lexicons.cognition(spark, w("cog", json.dumps([{"category": "Doubt & Such", "terms": ["Doubt", "not sure"]}])))
    rows = {r.word: r for r in lexicons.wide([vad, emo, num, tense, cog], spark).collect()}
    assert rows["happy"].valence == 0.8 and rows["happy"].joy == 1 and rows["happy"].worry == -3 and rows["happy"].n_pst == 0
    assert rows["went"].n_pst == 2 and rows["went"].n_prs == 0 and rows["goes"].n_prs == 1
    assert names == ["DoubtSuch"] and verbs == ["doubt"] and rows["doubt"].cog_DoubtSuch == 1
    c = lexicons.cities(spark, w("c.csv", "Name;Country name EN;Alternate Names;Population\nParis;France;Lutetia,Paname;100\nParis;United States;;5\n;X;;9\n"))
    assert {r.term: r.country for r in c.collect()} == {"paris": "France", "lutetia": "France", "paname": "France"}
    r = lexicons.religions(spark, w("r.csv", "Main Category,Main Religion,Substrain\nAbrahamic,Christianity,Catholicism\nOther,,Jedi\n"))
    assert {x.term: (x.main, x.category) for x in r.collect()} == {"catholicism": ("Christianity", "Abrahamic"), "christianity": ("Christianity", "Abrahamic"), "jedi": (None, "Other")}
    o = lexicons.occupations(spark, w("o.csv", "2018 SOC Title,2018 SOC Direct Match Title\nRegistered Nurses,Nurse\n,Blank\nTeachers,Teacher\n"))
    assert {x.term: x.title for x in o.collect()} == {"nurse": "Registered Nurses", "teacher": "Teachers"}
    assert lexicons.term_list(spark, w("t", "A\n\n b \n"), lower=True) == ["a", "b"]


def test_generated_text(spark, tmp_path):
    (tmp_path / "d.csv").write_text('model_answer,model_reasoning\n"one\ntwo",x y z\n,q\n')
    lex = features.Lexicons(lexicons.wide([spark.createDataFrame([("one", 3)], "word string, worry int")], spark))
    rows = corpora.generated_text(spark, str(tmp_path / "d.csv"), "star1", lex).collect()
    assert [(r.model_answer_WordCount, r.model_reasoning_WordCount) for r in sorted(rows, key=lambda r: r.model_reasoning)] == [(None, 1), (2, 3)]
    with pytest.raises(ValueError):
        readers.generated(spark, "x", "nope")


def test_feeds_and_escaped_sink(spark, tmp_path):
    long = "it is the end of the day and we are here for you " * 6
    item = f"<item><title>T</title><description></description><description>&lt;p&gt;{long}&lt;/p&gt;</description><category>a</category><category>b</category></item>"
    (tmp_path / "b.xml").write_text(item + "<item><description>short</description></item><item><description></description></item><item>")
    (tmp_path / "a.xml").write_text("<item>")
    got = readers.feeds(spark, str(tmp_path)).collect()
    assert [(r.title, r.description, r.categories) for r in got] == [("T", long.strip(), "a|b")]
    assert readers.feeds(spark, str(tmp_path), max_files=1).count() == 0
    with pytest.raises(ValueError):
        sinks.escaped_tsv(spark.createDataFrame([("a\nb",)], "x string"), str(tmp_path / "o"))
    sinks.escaped_tsv(spark.createDataFrame([('a"b',)], "x string").coalesce(1), str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["x", 'a"b']


def test_merge(spark, tmp_path):
    a = spark.createDataFrame([("1", "0", "x", "1600000000")], "HasA string, CountB string, DMGRawExtractedCountry string, created_utc string")
    b = spark.createDataFrame([("true", "2.0", "2001", "7", "9")], "HasA string, CountB string, year string, month string, match_count string")
    out = merge.merge({"r/reddit/posts/a.tsv": a, "r/books/b.tsv": b}, prefix="row")
    assert out.columns == ["CountB", "DMGRawExtractedCountry", "HasA", "Year", "Month", "MatchCount", "Dataset", "Dataset Type", "id"]
    rows = {r["Dataset Type"]: r for r in out.collect()}
    assert rows["Reddit"].Year == 2020 and rows["Reddit"].DMGRawExtractedCountry == "x" and rows["Reddit"].HasA is True and rows["Reddit"].MatchCount == 1
    assert (rows["Books"].Year, rows["Books"].Month, rows["Books"].MatchCount, rows["Books"].CountB) == (2001, 7, 9, 2)
    assert rows["Books"].id.startswith("row_books_") and len(rows["Books"].id) == len("row_books_") + 12
    sinks.parquet(out, str(tmp_path / "m"), by_month=True)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    ms = spark.createDataFrame([("1600000000000",)], "created_utc string")
    assert merge.in_millis(ms) == {"created_utc"} and merge.year_month(ms, frozenset({"created_utc"})).first().Year == 2020
    paths = spark.createDataFrame([("x/tusc/city.tsv",), ("./x/tusc/my_country.tsv",), ("/d/x/AI-gen/z.tsv",), ("q",), ("a/books/2/b.tsv",), ("tusc/other.tsv",), ("a/ai/b.tsv",)], "p string")
    got = [tuple(r) for r in paths.select(*merge.corpus(F.col("p"))).collect()]
    assert got == [("x/tusc/city.tsv", "Twitter", "tusc_city"), ("x/tusc/my_country.tsv", "Twitter", "tusc_ctry"), ("x/AI-gen/z.tsv", "AI-Generated", "ai"), ("q", "Unknown", "unknown"), ("books/2/b.tsv", "Books", "books"), ("tusc/other.tsv", "Twitter", "tusc"), ("a/ai/b.tsv", "Unknown", "ai")]


def test_filters_on_nulls(spark):
    kind = "id int, selftext string, over_18 boolean, promoted boolean, whitelist_status string, is_video boolean, url string"
    rows = [(1, "a b c d e", None, None, None, None, None), (2, None, None, None, None, None, None), (3, "a b c d e", None, None, None, True, None), (4, "a b c d e", None, None, None, None, "http://x/y.JPEG")]
    df = spark.createDataFrame(rows, kind)
    assert [r.id for r in df.where(filters.keep_post("text")).collect()] == [1]
    assert [r.id for r in df.where(filters.keep_post("multimodal")).orderBy("id").collect()] == [3, 4]
    assert df.where("false").where(filters.keep_post()).count() == 0


def test_feature_names():
    names = features.feature_names(("A",))
    assert len(names) == 103 and len(set(names)) == 103


def test_streams_give_batch_results(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    rows = [submission(i, f"u{i}", f"I am {20 + i} years old. {BODY}") for i in range(5)] + [submission(9, "x", BODY)]
    (d / "RS_1").write_text("\n".join(map(json.dumps, rows)))
    stream = streams.identified_posts(streams.post_stream(spark, str(d)), TERMS)
    streams.write(stream, str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination(60)
    got = sorted(r.PostID for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got == sorted(r.PostID for r in social.post_users(readers.posts(spark, str(d)), TERMS).collect()) == ["0", "1", "2", "3", "4"]
    q = streams.kept_per_window(streams.post_stream(spark, str(d))).writeStream.outputMode("complete").format("memory").queryName("kept").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").agg(F.sum("n")).first()[0] == 6


def test_strip(spark):
    assert spark.range(1).select(strip(F.lit("  a \x1c"))).first()[0] == "a"


def test_long_lists_match_like_short_ones(spark, monkeypatch):
    """The same statements with every list below the pattern's limit and above it."""
    terms = detect.Terms(occupations=("teacher", "art teacher", "c++ programmer"), genders=("man", "woman"), countries=("Canada", "United States", "Côte d'Ivoire"), cities=("Toronto", "New York", "Washington, D.C.", "York Mills"), religions=("Islam", "Buddhism"))
    said = ["I am a teacher.", "I work as an art  teacher at Big School!", "I am a C++ programmer, and", "I'm a woman", "I am not a man", "I am from the United  States", "I'm Canadian.", "I live in Côte d'Ivoire!", "I live in New York fear and", "I am from Washington, D.C., and", "I grew up in York Mills\nI live in Toronto\tnow", "I am a Buddhist who", "I converted to islam", "I grew up in " + "x " * 300 + "Toronto", "", None, "I am 30 years old. I live in Toronto. I live in New York. I live in TORONTO."]
    df = spark.createDataFrame([(i % 5 or None, t) for i, t in enumerate(said * 2)], "k int, t string")
    rows = lambda: sorted(map(repr, detect.detected(df, F.col("t"), terms).collect()))
    short = rows()
    monkeypatch.setattr(detect, "PATTERN_TERMS", 0)
    assert rows() == short and len(short) == len(said) * 2
    with pytest.raises(ValueError):
        detect.detect(F.col("t"), terms)


def test_features_do_not_depend_on_keys(spark):
    words = spark.createDataFrame([("joy", 0.9, 0.5, 0.1, *[1] * 10, 3, 3, 3, 3, 1, 0)], lexicons.WIDE)
    df = spark.createDataFrame([(1, "joy joy"), (1, "none"), (None, "joy"), (None, "joy"), (2, None), (2, " ")], "k int, t string")
    got = features.annotate(df, "t", features.Lexicons(words, (), ())).select("k", "t", "NRCCountJoyWords").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "joy joy", 2), (1, "none", 0), (None, "joy", 1), (None, "joy", 1), (2, None, None), (2, " ", None)]))
    both = features.annotate_columns(df.selectExpr("t AS a", "t AS b"), ("a", "b"), features.Lexicons(words, (), ()))
    assert both.count() == 6 and {"a_WordCount", "b_WordCount"} < set(both.columns)


def test_enrich_takes_the_same_row_of_repeated_users(spark):
    from pyspark.sql import functions as F

    from lexiloom.operators import demographics

    users = spark.createDataFrame([("a", None, "x"), ("a", "1990", "z"), ("a", "1980", "y"), ("b", None, "q")], "Author string, DMGMajorityBirthyear string, DMGRawExtractedCity string")
    posts = spark.createDataFrame([("a",), ("b",), ("c",)], "Author string")
    for part in (1, 7):
        got = demographics.enrich(posts, users.repartition(part), year=F.lit(2020), keep_unknown_age=True)
        rows = sorted((r.Author, r.DMGAgeAtPost, r.DMGRawExtractedCity) for r in got.collect())
        assert rows == [("a", 40, "y"), ("b", None, "q")]


def test_ids_of_different_rows_differ(spark, tmp_path):
    from lexiloom.queries import QUERIES

    # rows whose hashes share their last twelve digits, as ids were before, and rows that share them now
    rows = [(i, "t") for i in (28554, 1720288, 65488, 3538420, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert tuple(QUERIES["row_id"](spark, str(tmp_path)).first()) == (6, 5, 6)
    # a NULL in another column makes another row
    nulls = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "x string, y string")
    assert merge.add_ids(nulls, ["x", "y"], "g").select("id").distinct().count() == 3
    ids = merge.add_ids(df, ["doc_id", "text"], F.when(F.col("doc_id") > 1, "g"), "row").select("doc_id", "id").distinct().collect()
    assert len(ids) == 5 and all((r.id is None) == (r.doc_id == 1) for r in ids)
    assert [r.id for r in ids if r.id and r.id.startswith("row_g_99")]


def test_escaped_files_keep_every_text(spark, tmp_path):
    from lexiloom.queries import QUERIES

    texts = ["", " ", "\x00", "a\x00b", "\x01a\x01", "\x1b", '"', '""', "#", "a\\", "\\N", "\\0", "\\\\0", "\\&", "\\\x00", " a ", None, "x" * 200_000]
    rows = [(t, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "a string, i int, b string")
    for columns, want in ((("a", "i", "b"), [(t, str(i), t) for t, i, _ in rows]), (("a", "b"), [(t, t) for t in texts]), (("a",), [(t,) for t in texts])):
        sinks.escaped_tsv(df.repartition(3), str(tmp_path / "o"), columns)
        got = readers.escaped_table(spark, str(tmp_path / "o"))
        assert got.columns == list(columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    spark.createDataFrame([(1, ""), (2, " \n "), (3, "\x01a\x00"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, QUERIES["tsv_escaped"](spark, str(tmp_path)).collect())) == [("1", ""), ("2", ""), ("3", "\x01a\x00"), ("4", None)]


def test_semijoin_reads_lines_once(spark):
    from lexiloom.queries import QUERIES

    df = QUERIES["ngram_semijoin"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_ngram_steps_do_not_interpret_lambdas(spark):
    odd = ["a_NOUN b c d e", "a b c d e_", "_ b c d e", "a__X b c d e", "a_b_X b c d e", "a  b c d e", " a b c d e ", "a b c d", "a b c d e f", "é_X b c d e", "a b c d e", "a \x1c b c d", "._. b c d e", "$1 \\ c d e"]
    bad = ["a b c d e\tx\t1\t1", "a b c d e\t1\t1", "a b c d e\t1\t1\t1\t1", "a b c d e\t1\t\t1", "a b c d e\t1\t1\t1.5", None]
    lines = spark.createDataFrame([(f"{o}\t 1999 \t{i}\t1",) for i, o in enumerate(odd)] + [(b,) for b in bad], "value string")
    rows = ngrams.clean(ngrams.parse(lines))
    got = {r.match_count: (r.ngram, r.year, r.book_count, r.ngram_cleaned) for r in rows.collect()}
    want = {0: "a b c d e", 1: "a b c d e", 3: "a_ b c d e", 4: "a_b b c d e", 5: "a b c d e", 6: "a b c d e", 9: "é b c d e", 10: "a b c d e", 12: ". b c d e", 13: "$1 \\ c d e"}
    assert got == {i: (odd[i], 1999, 1, w) for i, w in want.items()}
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_ngram_files_are_packed(spark, monkeypatch):
    from lexiloom import file_queries

    made = []
    folder = file_queries.folder
    monkeypatch.setattr(file_queries, "folder", lambda *a: made.append(folder(*a)) or made[-1])
    file_queries.ngram_files(spark, "/root/testdata/sf0.001")
    files = [f.name for f in Path(made[0].removeprefix("file://")).rglob("part*")]
    assert files and all(f.endswith(".gz") for f in files)
