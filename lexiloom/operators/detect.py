"""Self-identification: statements of age, occupation, gender, country, city and religion.

A statement is a lead, a captured term (or number) and a tail. Small term lists become alternations in the
pattern. For large ones (all cities of the world) ``detected`` matches the leads only and looks the words that
follow up in a dictionary table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import terms as T
from lexiloom.functions.text import FLAGS, strip

CATEGORIES = ("age", "occupation", "gender", "country", "city", "religion")
#: Longer lists are looked up in a table; ``detected`` sees to that.
PATTERN_TERMS = 5_000


@dataclass(frozen=True)
class Terms:
    """Term lists; nationalities and adherents are derived."""

    occupations: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    religions: tuple[str, ...] = ()
    stopwords: frozenset[str] = field(default_factory=frozenset)

    def lists(self) -> dict[str, list[str]]:
        return {
            "occupation": list(self.occupations),
            "gender": list(self.genders),
            "country": list(self.countries),
            "nationality": T.nationalities(list(self.countries)),
            "city": usable_cities(self.cities, self.countries, self.stopwords),
            "religion": list(self.religions),
            "adherent": T.adherents(list(self.religions)),
        }


def usable_cities(cities, countries, stopwords) -> list[str]:
    """Names of five characters or more that are neither a stop word nor a country."""
    no = {c.lower() for c in countries} | {s.lower() for s in stopwords}
    return [c for c in cities if len(c) > 4 and c.lower() not in no]


def gap(text: str) -> str:
    """Blanks of a phrase match any white space."""
    return text.replace(" ", r"\s+")


def unless(*phrases: str) -> str:
    return "(?!" + "|".join(gap(" " + p) for p in phrases) + ")"


def before(words: str) -> str:
    """At the end, before punctuation, or before one of the words."""
    return rf"(?=\s*(?:$|[,.!?]|\b(?:{words})\b))"


# The grammar of statements. (list of terms, or None for numbers; lead; tail)
AM = r"\bI(?:\s+am|'m)"
BORN_AM = r"\bI(?:\s+was|\s+am|'m)\s+born\s+in\s+"
YEAR = r"(19\d{2}|20(?:0\d|1\d|2[0-4]))"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DAY = r"\d{1,2}(?:st|nd|rd|th)?"
AT = r"(?:\s+at\s+[\w\s.-]+)?"
HERE = unless("not", "just visiting", "originally")
DEVOUT = r"\s+(?:a|an|a\s+devout|a\s+practicing)?\s+"
SURE = unless("not", "sure if I'm")
END = r"\b"
GRAMMAR: dict[str, list[tuple[str | None, str, str]]] = {
    "age": [
        (None, AM + r"\s+(\d{1,2})\s+years?\s+old", END),
        (None, AM + r"\s+(\d{1,2})", r"(?=\s*(?:$|[,.!?]|(?:and|but|so|yet)\s))"),
        (None, BORN_AM + YEAR, END),
        (None, BORN_AM + r"'(\d{2})", END),
        (None, rf"\bI\s+was\s+born\s+on\s+(?:{DAY}\s+)?(?:{MONTHS})\s+(?:{DAY},?\s+)?" + YEAR, END),
        (None, r"\bI\s+was\s+born\s+on\s+\d{1,2}[/\-]\d{1,2}[/\-]" + YEAR, END),
    ],
    "occupation": [
        ("occupation", AM + unless("not", "looking for") + r"\s+(?:a|an|the)?\s+", AT + before("and|but|so|or|yet|while|when|because")),
        ("occupation", AM + unless("not", "looking for") + r"\s+(?:a|an|the)?\s+", AT + END),
        ("occupation", r"\bI\s+work\s+as\s+(?:a|an|the)?\s+", AT + END),
        ("occupation", r"\bMy\s+(?:job|occupation|profession|role)\s+is\s+(?:to\s+be\s+)?(?:a|an|as)?\s*", END),
        ("occupation", r"\bI'm\s+(?:currently\s+)?employed\s+as\s+(?:a|an|the)?\s+", END),
    ],
    "gender": [
        ("gender", AM + unless("not") + r"\s+(?:a|an)?\s+", before("and|but|so|or|yet|because")),
        ("gender", AM + unless("not") + r"\s+(?:a|an)?\s+", END),
        ("gender", r"\bI\s+identify\s+as\s+(?:a|an)?\s*", END),
        ("gender", r"\bMy\s+gender(?:\s+identity)?\s+is\s+", END),
        ("gender", r"\b(?:I'm|I\s+am)\s+(?:a\s+)?(?:transgender|trans)\s+", END),
    ],
    "country": [
        ("country", AM + HERE + r"\s+from\s+(?:the\s+)?", END),
        ("country", AM + r"\s+from\s+(?:the\s+)?", END),
        ("nationality", AM + unless("not") + r"\s+(?:a|an|the)?\s*", before("and|but|so|or|yet|who")),
        ("nationality", AM + unless("not") + r"\s+(?:a|an|the)?\s*", END),
        ("country", r"\bI\s+live\s+(?:in|at)\s+(?:the\s+)?", END),
        ("country", r"\bI\s+come\s+from\s+(?:the\s+)?", END),
        ("nationality", r"\bMy\s+(?:nationality|citizenship)\s+is\s+", END),
        ("country", r"\bI(?:\s+was|'m)\s+born\s+and\s+(?:raised|grew\s+up)\s+in\s+(?:the\s+)?", END),
        ("country", AM + r"\s+originally\s+from\s+(?:the\s+)?", END),
    ],
    "city": [
        ("city", AM + HERE + r"\s+from\s+", before("and|but|so|or|yet")),
        ("city", AM + HERE + r"\s+from\s+", END),
        ("city", r"\bI\s+live\s+(?:in|at)\s+", r"\b(?!\s+(?:fear|hope|a\s+state\s+of|sin|poverty|luxury))"),
        ("city", r"\b(?:I'm\s+|I\s+am\s+)?(?:currently\s+)?(?:residing|based)\s+in\s+", END),
        ("city", r"\bMy\s+(?:current\s+|home\s+)?(?:city|town)\s+is\s+", END),
        ("city", r"\bI\s+(?:grew\s+up|was\s+raised)\s+in\s+", END),
    ],
    "religion": [
        ("adherent", AM + SURE + DEVOUT, before("and|but|so|or|yet|who")),
        ("adherent", AM + SURE + DEVOUT, END),
        ("religion", r"\bMy\s+(?:religion|faith)\s+is\s+", END),
        ("religion", r"\bI\s+(?:actively\s+)?practice\s+", END),
        ("religion", AM + r"\s+a\s+follower\s+of\s+", END),
        ("religion", r"\bI\s+converted\s+to\s+", END),
        ("adherent", r"\bI\s+was\s+(?:raised|born)\s+(?:as\s+(?:a|an))?\s*", END),
        # one statement with two kinds of terms, as two, so that either's term is captured
        ("adherent", r"\bI\s+identify\s+as\s+", END),
        ("religion", r"\bI\s+identify\s+with\s+(?:the\s+)?", END),
    ],
}


def long_lists(terms: Terms) -> frozenset[str]:
    """Categories with a list too long for a pattern."""
    lists = terms.lists()
    return frozenset(c for c, rules in GRAMMAR.items() if any(xs and len(lists[xs]) > PATTERN_TERMS for xs, _, _ in rules))


def patterns(terms: Terms, categories: tuple[str, ...] = CATEGORIES) -> dict[str, list[str]]:
    """Regular expressions of each category; none where a list is empty. Lists too long for a pattern are refused: see ``detected``."""
    if big := long_lists(terms).intersection(categories):
        raise ValueError(f"lists of more than {PATTERN_TERMS} terms need detected(): {sorted(big)}")
    lists = terms.lists()
    groups = {xs: T.group(lists[xs]) for c in categories for xs, _, _ in GRAMMAR[c] if xs}
    return {c: [FLAGS + lead + (groups[xs] if xs else "") + tail for xs, lead, tail in GRAMMAR[c] if not xs or groups[xs]] for c in categories}


def matches(text: Column, regexes: list[str]) -> Column:
    """Captured terms of all patterns, in order, each once."""
    if not regexes:
        return F.array().cast("array<string>")
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in regexes]
    return F.filter(F.array_distinct(F.flatten(F.array(*found))), lambda x: x != "")


def detect(text: Column, terms: Terms, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """struct of an array<string> per category; empty arrays where nothing matches, also for NULL."""
    text, regexes = strip(F.coalesce(text, F.lit(""))), patterns(terms, categories)
    return F.struct(*[matches(text, regexes[c]).alias(c) for c in categories])


def any_match(detected: Column, categories: tuple[str, ...] = CATEGORIES) -> Column:
    out = F.lit(False)
    for c in categories:
        out = out | (F.size(detected[c]) > 0)
    return out


def detected(df: DataFrame, text: Column, terms: Terms, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``df`` with _found, the struct of ``detect``. Categories with a list too long for a pattern look its terms up in a table.

    Both ways give the same rows. Each different text is looked up once; a 256-bit digest stands for it in the join.
    """
    big = long_lists(terms)
    short = tuple(c for c in categories if c not in big)
    if len(short) == len(categories):
        return df.withColumn("_found", detect(text, terms, categories))
    body, lists, own = F.coalesce(text, F.lit("")), terms.lists(), df.columns
    out = df.withColumn("__text", body).withColumn("__digest", F.sha2(F.col("__text").cast("binary"), 256))
    kinds = out.select("__digest", "__text").dropDuplicates(["__digest"])
    for c in categories:
        if c in big:
            rows = sorted({(xs, " ".join(t.lower().split())) for xs, _, _ in GRAMMAR[c] for t in lists[xs]})
            table = df.sparkSession.createDataFrame(rows, "list string, term string")
            got = dictionary_matches(kinds, "__digest", "__text", c, table, max(len(t.split(" ")) for _, t in rows))
            out = out.join(got.withColumnRenamed("matches", f"__{c}"), "__digest", "left")
    here = detect(F.col("__text"), terms, short)
    none = F.array().cast("array<string>")
    return out.select(*own, F.struct(*[(F.coalesce(F.col(f"__{c}"), none) if c in big else here[c]).alias(c) for c in categories]).alias("_found"))


#: How a term may end inside the text's last word: anywhere whole, before its punctuation, before its last mark, or after its first letters.
ENDINGS = (r"\S+", r"\S*\w", r"\S+(?=[^\s\w](?:\s|\z))", r"\w+")


def dictionary_matches(df: DataFrame, key: str, text: str, category: str, dictionary: DataFrame, longest: int) -> DataFrame:
    """(key, matches) for a dictionary (list, term) too large for a pattern; terms in lower case, of ``longest`` words at most.

    The leads are matched; of what follows, every beginning that ends in one of the next ``longest`` words
    is looked up (a hash join), and the longest known one whose rest meets the tail is the match, as in a
    longest-first alternation that backs off.
    """
    rules = [(xs, lead, tail) for xs, lead, tail in GRAMMAR[category] if xs]
    body = strip(F.coalesce(F.col(text), F.lit("")))

    def spot(n: int, xs: str, lead: str) -> Column:
        tails = F.regexp_extract_all(body, F.lit(rf"{FLAGS}{lead}(?=((?s:.+)))"), F.lit(1))
        return F.transform(tails, lambda s: F.struct(F.lit(n).alias("rule"), F.lit(xs).alias("list"), s.alias("s")))

    spots = [spot(n, xs, lead) for n, (xs, lead, _) in enumerate(rules)]
    found = df.select(key, F.posexplode(F.concat(*spots)).alias("at", "spot")).select(key, "at", "spot.*")
    heads = F.array(*[F.regexp_extract("s", rf"(?U)\A((?:\S+\s+){{{n}}}{end})", 1) for n in range(longest) for end in ENDINGS])
    tries = found.select(key, "at", "rule", "list", "s", F.explode(F.array_distinct(heads)).alias("head")).where("head <> ''")
    tries = tries.withColumn("term", F.regexp_replace(F.lower("head"), r"(?U)\s+", " "))
    known = tries.join(dictionary.distinct(), ["list", "term"])
    ok = F.lit(False)
    for n, (_, _, tail) in enumerate(rules):
        # the tail is tried where it stands, behind the head
        ok = ok | ((F.col("rule") == n) & F.regexp_like("s", F.concat(F.lit(rf"{FLAGS}\A"), F.lit(r"\Q"), F.replace("head", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), F.lit(tail))))
    best = known.where(ok).groupBy(key, "at").agg(F.max_by("head", F.length("head")).alias("head"))
    return best.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "head"))), lambda x: x["head"])).alias("matches"))


def mapped(df: DataFrame, key: str, column: str, dictionary: DataFrame, values: tuple[str, ...], *, keep_unknown: bool = True) -> DataFrame:
    """(key, column, *values): array elements with what the dictionary (term, *values) says of them, in order."""
    spread = df.select(key, F.posexplode_outer(column).alias("at", "term")).withColumn("term", F.lower("term"))
    joined = spread.join(dictionary.withColumn("known", F.lit(True)), "term", "left")
    if not keep_unknown:
        joined = joined.withColumn("term", F.when(F.col("known"), F.col("term")))
    item = F.when(F.col("term").isNotNull(), F.struct("at", "term", *values))
    rows = joined.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("x"))
    take = lambda name: F.transform("x", lambda x: x[name])
    return rows.select(key, take("term").alias(column), *[take(v).alias(v) for v in values])


def religion_dictionary(religions: DataFrame) -> DataFrame:
    """(term, main, category) with the adherents' forms: x for x + "ism", then for x + "ity", then two by name.

    ``religions`` has (term, main, category), terms in lower case. Of several readings the first counts, for each
    value by itself.
    """
    cut = lambda end, rank: religions.where(F.col("term").endswith(end)).select(F.expr(f"left(term, length(term) - {len(end)})").alias("term"), "main", "category", F.lit(rank).alias("rank"))
    named = religions.where(F.col("term").isin("atheism", "agnosticism")).select(F.when(F.col("term") == "atheism", "atheist").otherwise("agnostic").alias("term"), "main", "category", F.lit(3).alias("rank"))
    every = religions.select("term", "main", "category", F.lit(0).alias("rank")).unionByName(cut("ism", 1)).unionByName(cut("ity", 2)).unionByName(named)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c)
    return every.where("term <> ''").groupBy("term").agg(first("main"), first("category"))
