"""Lexicon scoring of texts: 102 fixed columns and one flag per cognition category.

Word scores come from one wide lexicon table (one row per word). Tokens are exploded, joined to it and folded back per
document; a document's tokens are in one partition, so what is shuffled is one row of sums per document. The
rest (pronouns, body parts, tense modals, phrases) are expressions on the row itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import terms as T
from lexiloom.functions.text import FLAGS, distinct_ignoring_case, strip, tokens

# Fixed values.
DIMENSIONS = ("valence", "arousal", "dominance")
HIGH, LOW = 0.67, 0.33
EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "negative", "positive", "sadness", "surprise", "trust")
BONDS = (("moral", "MoralTrust"), ("social", "SocialWarmth"), ("warm", "Warmth"))
PRONOUNS = ("I", "Me", "My", "Mine", "We", "Our", "Ours", "Us", "You", "Your", "Yours", "She", "Her", "Hers", "He", "Him", "His", "It", "They", "Them", "Their", "Theirs")
OWNERS = ("my", "your", "her", "his", "their")
MODALS = ("will", "shall", "should", "going to")
FUTURE = ("tomorrow", "next day", "next year", "next month")
SUBJECTS = (("I", "ICOG"), ("you", "YouCOG"), ("we", "WeCOG"), ("he", "HeCOG"), ("she", "SheCOG"), ("they", "TheyCOG"))
APOSTROPHE = "(?:'|’)"
AUXILIARY = rf"(?:{APOSTROPHE}m|am|are|{APOSTROPHE}re|is|{APOSTROPHE}s|was|were|have\s+been|{APOSTROPHE}ve\s+been|has\s+been|had\s+been|(?:might|may|can|could|should|would|will|shall|must)\s+be|be|been|being)"
BETWEEN = r"(?:\s+(?:not|\w+(?:-\w+)?)){0,3}"
#: Above this many words a lexicon is not hinted for broadcast.
BROADCAST_WORDS = 500_000


@dataclass(frozen=True)
class Lexicons:
    """``words``: the wide table (see ``sources.lexicons.wide``); term lists for the row-local features."""

    words: DataFrame
    body_parts: tuple[str, ...] = ()
    verbs: tuple[str, ...] = ()
    categories: tuple[str, ...] = field(default=())

    def joined(self) -> DataFrame:
        return F.broadcast(self.words) if self.words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else self.words


def _flag(count: Column) -> Column:
    return (count > 0).cast("int")


def _average(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def score_columns(categories: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """Aggregates over a document's joined tokens, and the feature columns made of them."""
    aggs, cols = [], []

    def total(name: str, c: Column) -> Column:
        aggs.append(F.coalesce(F.sum(c), F.lit(0)).alias(name))
        return F.col(name)

    def count(name: str, cond: Column) -> Column:
        aggs.append(F.count_if(cond).cast("int").alias(name))
        return F.col(name)

    for d in DIMENSIONS:
        v, name = F.col(d), d.capitalize()
        cols.append(_average(total(f"_{d}", v), count(f"_n_{d}", v.isNotNull())).alias(f"NRCAvg{name}"))
        for level, cond in (("High", v > HIGH), ("Low", v < LOW)):
            n = count(f"_{level}_{d}", cond)
            cols += [_flag(n).alias(f"NRCHas{level}{name}Word"), n.alias(f"NRCCount{level}{name}Words")]
    for e in EMOTIONS:
        n, name = count(f"_{e}", F.col(e) == 1), e.capitalize()
        cols += [_flag(n).alias(f"NRCHas{name}Word"), n.alias(f"NRCCount{name}Words")]
    w = F.col("worry")
    for name, side, top in (("Anxiety", w > 0, w == 3), ("Calmness", w < 0, w == -3)):
        n = count(f"_n_{name}", side)
        t = total(f"_{name}", F.when(side, w).cast("double"))
        high = count(f"_high_{name}", top)
        cols += [_flag(n).alias(f"NRCHas{name}Word"), _average(t, n).alias(f"NRCAvg{name}"), _flag(high).alias(f"NRCHasHigh{name}Word"), high.alias(f"NRCCountHigh{name}Words")]
    for c, name in BONDS:
        v = F.col(c)
        for level, cond in (("High", v == 3), ("Low", v == -3)):
            n = count(f"_{level}_{c}", cond)
            cols += [_flag(n).alias(f"NRCHas{level}{name}Word"), n.alias(f"NRCCount{level}{name}Word")]
        cols.append(_average(total(f"_{c}", v.cast("double")), count(f"_n_{c}", v.isNotNull())).alias(f"NRCAvg{name}Word"))
    past, present = (total(f"_{c}", F.col(c)).cast("int") for c in ("n_pst", "n_prs"))
    cols += [_flag(past).alias("TIMEHasPastVerb"), past.alias("TIMECountPastVerbs"), _flag(present).alias("TIMEHasPresentVerb"), present.alias("TIMECountPresentVerbs")]
    for c in categories:
        cols.append(_flag(count(f"_cog_{c}", F.col(f"cog_{c}") == 1)).alias(f"COGHas{c}Word"))
    return aggs, cols


def scores(df: DataFrame, text: str, key: str, lexicons: Lexicons) -> DataFrame:
    """(key, word-score features) of every row; ``key`` must be unique."""
    aggs, cols = score_columns(lexicons.categories)
    spread = df.select(key, F.explode_outer(tokens(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    sums = spread.join(lexicons.joined(), "word", "left").groupBy(key).agg(*aggs)
    return sums.select(key, *cols)


def pronouns(words: Column) -> dict[str, Column]:
    return {f"PRNHas{p}": F.array_contains(words, p.lower()).cast("int") for p in PRONOUNS}


def body_parts(text: Column, parts: tuple[str, ...]) -> dict[str, Column]:
    """Substrings of the lower-case text, in list order; no word boundaries."""
    low = F.lower(text)
    if not parts:
        return {f"{o.capitalize()}BPM": F.lit("") for o in OWNERS} | {"HasBPM": F.lit(False)}
    terms = lambda lead: F.array(*[F.lit(lead + p) for p in parts])
    out = {f"{o.capitalize()}BPM": F.array_join(F.filter(terms(f"{o} "), lambda t: F.contains(low, t)), ", ") for o in OWNERS}
    return out | {"HasBPM": F.exists(terms(""), lambda t: F.contains(low, t))}


def future(words: Column) -> dict[str, Column]:
    modal = F.size(F.filter(words, lambda w: w.isin(*MODALS)))
    joined = F.array_join(words, " ")
    mention = F.lit(False)
    for phrase in FUTURE:
        mention = mention | F.contains(joined, F.lit(phrase))
    return {"TIMEHasFutureModal": _flag(modal), "TIMECountFutureModals": modal, "TIMEHasFutureReference": mention.cast("int")}


def thinking(text: Column, verbs: tuple[str, ...]) -> dict[str, Column]:
    """Phrases "subject auxiliary ... verb-ing", each once per text whatever its case."""
    ings = sorted({T.ing(v) for v in verbs}, key=len, reverse=True)
    out: dict[str, Column] = {}
    for subject, name in SUBJECTS:
        if not ings:
            out[name] = F.lit("")
            continue
        pattern = rf"{FLAGS}\b{subject}\b\s+{AUXILIARY}{BETWEEN}\s+({'|'.join(ings)})\b"
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip)
        out[name] = F.array_join(distinct_ignoring_case(hits), ", ")
    some = F.lit(False)
    for name in list(out):
        some = some | (out[name] != "")
    return out | {"HasCOG": some}


def annotate(df: DataFrame, text: str, lexicons: Lexicons) -> DataFrame:
    """``df`` with all features of column ``text``. Blank texts get NULL features.

    Each different text is scored once, whatever keys its rows have; a 256-bit digest stands for it in the join.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = tokens(t)
    local = pronouns(words) | body_parts(t, lexicons.body_parts) | future(words) | thinking(t, lexicons.verbs) | {"WordCount": F.size(words)}
    own = df.columns
    keyed = df.withColumn("__digest", F.sha2(t.cast("binary"), 256))
    kinds = keyed.select("__digest", text).dropDuplicates(["__digest"])
    out = keyed.join(scores(kinds, text, "__digest", lexicons), "__digest", "left").withColumns(local)
    out = out.withColumn("TIMEHasPresentNoFuture", ((F.col("TIMECountPresentVerbs") > 0) & (F.col("TIMECountFutureModals") == 0)).cast("int"))
    made = feature_names(lexicons.categories)
    blank = strip(t) == ""
    return out.select(*own, *[F.when(~blank, F.col(c)).alias(c) for c in made])


def feature_names(categories: tuple[str, ...] = ()) -> list[str]:
    """All feature columns in output order."""
    out = [f"NRCAvg{d.capitalize()}" for d in DIMENSIONS]
    for d in DIMENSIONS:
        out += [f"NRC{kind}{level}{d.capitalize()}{end}" for level in ("High", "Low") for kind, end in (("Has", "Word"), ("Count", "Words"))]
    out += [f"NRC{kind}{e.capitalize()}{end}" for e in EMOTIONS for kind, end in (("Has", "Word"), ("Count", "Words"))]
    out.append("WordCount")
    for n in ("Anxiety", "Calmness"):
        out += [f"NRCHas{n}Word", f"NRCAvg{n}", f"NRCHasHigh{n}Word", f"NRCCountHigh{n}Words"]
    for _, n in BONDS:
        out += [f"NRC{kind}{level}{n}Word" for level in ("High", "Low") for kind in ("Has", "Count")] + [f"NRCAvg{n}Word"]
    out += [f"PRNHas{p}" for p in PRONOUNS] + [f"{o.capitalize()}BPM" for o in OWNERS] + ["HasBPM"]
    out += ["TIMEHasPastVerb", "TIMECountPastVerbs", "TIMEHasPresentVerb", "TIMECountPresentVerbs", "TIMEHasFutureModal", "TIMECountFutureModals", "TIMEHasPresentNoFuture", "TIMEHasFutureReference"]
    return out + [f"COGHas{c}Word" for c in categories] + [n for _, n in SUBJECTS] + ["HasCOG"]


def annotate_columns(df: DataFrame, columns: tuple[str, ...], lexicons: Lexicons) -> DataFrame:
    """Features of several text columns, prefixed with the column's name if there is more than one."""
    if len(columns) == 1:
        return annotate(df, columns[0], lexicons)
    names, out = feature_names(lexicons.categories), df
    for c in columns:
        out = annotate(out, c, lexicons).withColumnsRenamed({n: f"{c}_{n}" for n in names})
    return out
