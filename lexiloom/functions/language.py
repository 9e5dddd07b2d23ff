"""Is a text English? A native score over frequent function words of the first 4,000 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words that few other languages share.
WORDS = {
    "en": "the of and to in is that for it was on with be as by this are at from or have an not which you his her they we but were had has been their there what will would can if all one more who when do so no my me she he i",
    "fr": "le la les des un une et est que qui dans pour pas sur au avec ce il elle sont plus par ne se mais nous vous leur ou été aux cette",
    "de": "der die das und ist nicht ein eine zu den mit von sich auf für dem im als auch es an werden aus er hat dass sie nach wird bei",
    "es": "el la los las de que y en un una es por con no se para su al lo como más pero sus le ya o este sí porque del",
}


def shares(text: Column) -> dict[str, Column]:
    """Share of a language's function words among the text's words."""
    words = F.filter(F.split(F.lower(F.substring(text, 1, 4000)), r"[^\p{L}]+"), lambda w: w != "")
    n = F.greatest(F.lit(1), F.size(words))
    known = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    return {lang: known(xs.split()) / n for lang, xs in WORDS.items()}


def is_english(text: Column, least: float = 0.1) -> Column:
    """English scores highest and reaches ``least``; NULL and empty texts are not English."""
    s = shares(F.coalesce(text, F.lit("")))
    best = s["en"] >= least
    for lang in WORDS:
        if lang != "en":
            best = best & (s["en"] > s[lang])
    return best
