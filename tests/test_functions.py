import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import age, language, terms, text


def values(spark, data, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_tokens_split_like_python(spark):
    data = ["A b c\x1cd", "", None, " x ", "İ ΣΑΣ"]
    assert values(spark, data, text.tokens) == [x.lower().split() if x is not None else None for x in data]


def test_clean_newlines(spark):
    assert values(spark, [" a\r\n\nb   c ", None, ""], text.clean_newlines) == ["a b c", None, ""]


def test_strip_pos_tags(spark):
    assert values(spark, ["dog_NOUN runs_VERB ._.", "_NOUN_ plain", "a_b_C"], text.strip_pos_tags) == ["dog runs .", "_NOUN plain", "a_b"]


def test_created_at_year(spark):
    data = ["Wed Apr 01 14:35:59 +0000 2020", "2015-04-10T02:47:38.000Z", " 2015-04-10T02:47:38 ", "2015-13-10T02:47:38Z", "x", "", None]
    assert values(spark, data, text.created_at_year) == [2020, 2015, 2015, None, None, None, None]


def test_epoch_year(spark):
    assert values(spark, ["0", "1577836799", "1577836800", "x", None], text.epoch_year) == [1970, 2019, 2020, None, None]


def test_id_text(spark):
    assert values(spark, ["12.0", " a ", "nan", "", "1.5", None], text.id_text) == ["12", "a", None, None, "1.5", None]


def test_sanitize(spark):
    data = ["a &amp;lt;b&amp;gt; <i>c</i>\n d&#39;e &#x41; &hellip;", None]
    assert values(spark, data, lambda c: text.sanitize(c, strip_tags=True)) == ["a c d'e A …", None]


def test_field(spark):
    xml = ['<a x="1">q</a><ns:a>n</ns:a><a> p&amp;r </a>', "<ns:a>n</ns:a>", "<b/>"]
    assert values(spark, xml, lambda c: text.field(c, "a")) == ["p&r", "n", None]


def test_to_bool_and_number(spark):
    assert values(spark, ["1", " FALSE ", "1.0", "yes", None], text.to_bool) == [True, False, True, None, None]
    assert values(spark, ["3.7", "x", " 5 "], lambda c: text.to_number(c, "int")) == [3, None, 5]


def test_dates(spark):
    data = ["Wed, 01 Apr 2020 10:00:00 +0200", "2020-04-01", "2020-04-01T10:00:00Z", "junk"]
    assert [str(v) if v else None for v in values(spark, data, text.to_datetime)] == ["2020-04-01 08:00:00", "2020-04-01 00:00:00", "2020-04-01 10:00:00", None]


def test_distinct_ignoring_case(spark):
    assert values(spark, [["A", "b", "a", "B", "c"], []], text.distinct_ignoring_case, "array<string>") == [["A", "b", "c"], []]


@pytest.mark.parametrize("verb, form", [("be", "being"), ("die", "dying"), ("see", "seeing"), ("make", "making"), ("plan", "planning"), ("fix", "fixing"), ("think", "thinking"), ("go", "going")])
def test_ing(verb, form):
    assert terms.ing(verb) == form


def test_derived_terms():
    assert terms.nationalities(["India", "Canada", "Lapland", "Italy", "Peru", "France"]) == ["Indian", "Canadan", "Laper", "Lapish", "Italian", "Peruian", "Peruese", "french"]
    assert terms.adherents(["Islam", "Taoism", "Unity", "Druze"]) == ["muslim", "Taoist", "Un", "Druze", "Druzeist"]
    assert terms.group(["a b", "abc", "u.s."]) == r"(\Qu.s.\E|a\s+b|abc)"
    assert terms.group([]) is None


def resolved(matches, year):
    """Plain-Python twin: weights are summed from left to right."""
    found = []
    for m in matches:
        if len(m) == 3 and m[0] == "'" and m[1:].isdigit():
            y = int(m[1:])
            found.append((1900 + y if y > year % 100 else 2000 + y, 1.0))
        elif m.isdigit():
            v = int(m)
            if 1900 <= v <= year:
                found.append((v, 1.0))
            elif 13 <= v <= 99:
                found.append((year - v, 0.8))
    groups = []
    for y, w in found:
        group = next((g for g in groups if abs(y - g[0][0]) <= 2), None)
        if group is None:
            groups.append(group := [])
        group.append((y, w))
    best, top = None, 0.0
    for g in groups:
        total = 0.0
        for _, w in g:
            total += w
        if total + len(g) * 0.1 > top:
            best, top = g, total + len(g) * 0.1
    if best is None:
        return None
    sw = sy = 0.0
    for y, w in best:
        sw += w
        sy += y * w
    years = year - round(sy / sw)
    return (years, min(1.0, top / len(matches))) if 13 <= years <= 99 else None


def test_age_resolution_against_plain_python(spark):
    rng = random.Random(7)
    pool = ["12", "13", "30", "31", "52", "51", "99", "1985", "1987", "1990", "2031", "'85", "'05", "x", ""]
    cases = [[rng.choice(pool) for _ in range(rng.randint(0, 6))] for _ in range(1500)]
    got = values(spark, cases, lambda c: age.resolve(c, F.lit(2021)), "array<string>")
    assert [(r.age, round(r.confidence, 9)) if r else None for r in got] == [(w[0], round(w[1], 9)) if (w := resolved(c, 2021)) else None for c in cases]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["30", "31", "1990", "60"]), min_size=1, max_size=4))
def test_unreadable_matches_change_only_the_confidence(spark, xs):
    a, b = values(spark, [xs, [*xs, "zz"]], lambda c: age.resolve(c, F.lit(2020)), "array<string>")
    assert (a and a.age) == (b and b.age)


def test_no_reference_year(spark):
    assert values(spark, [["30"]], lambda c: age.resolve(c, F.lit(None).cast("int")), "array<string>") == [None]


def test_language_gate_follows_the_lang_column(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 250")
    right = df.select(F.avg((language.is_english(F.col("text")) == (F.col("lang") == "en")).cast("int"))).first()[0]
    assert right > 0.95
    assert values(spark, [None, ""], language.is_english) == [False, False]
