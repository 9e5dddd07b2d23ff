"""Text functions as column expressions.

White space and word characters follow Unicode, and ``$`` ends a text only there or before a final line
feed; Java needs the flags ``(?Ud)`` for that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\x1c-\x1f]"
FLAGS = "(?iuUd)"


def strip(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def split_words(c: Column) -> Column:
    """Words between white space; punctuation stays."""
    return F.filter(F.split(c, rf"(?U){BLANK}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case words between white space."""
    return split_words(F.lower(c))


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def clean_newlines(c: Column) -> Column:
    """Line breaks and runs of blanks become one blank; outer white space goes; NULL stays."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), " +", " "))


def strip_pos_tags(c: Column) -> Column:
    """Every word without its last ``_TAG``, words parted by single blanks."""
    words = strip(F.regexp_replace(c, rf"(?U){BLANK}+", " "))
    return F.regexp_replace(words, r"_[^_ ]*(?= |\z)", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def created_at_year(c: Column) -> Column:
    """Year of ``Wed Apr 01 14:35:59 +0000 2020`` or of an ISO timestamp; NULL if neither."""
    c = strip(c)
    feed = F.regexp_extract(c, r"^[A-Za-z]{3} ([A-Za-z]{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})$", 1)
    written = F.when(F.try_to_timestamp(feed, F.lit("MMM dd HH:mm:ss Z yyyy")).isNotNull(), F.substring(feed, -4, 4))
    iso = F.regexp_extract(c, r"^(\d{4})-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$", 1)
    valid = F.when(F.try_to_timestamp(F.regexp_replace(c, "Z$", "")).isNotNull(), iso)
    return F.coalesce(F.nullif(written, F.lit("")), F.nullif(valid, F.lit(""))).try_cast("int")


def epoch_year(c: Column) -> Column:
    """UTC year of epoch seconds given as number or text."""
    return F.year(F.timestamp_seconds(c.cast("string").try_cast("bigint")))


#: Named entities that feeds use; numeric ones are decoded by rule.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "bull": "•", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "deg": "°", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ"}


def unescape(c: Column) -> Column:
    """HTML entities: numeric ones up to U+FFFF and the named ones above; ``&amp;`` last, once."""
    # split into text and numeric entities, decode the latter one by one
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&#x?[0-9a-fA-F]+;|[^&]+|&"), F.lit(0))
    hexa = lambda p: F.conv(F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,6});", 1), 16, 10)
    deci = lambda p: F.regexp_extract(p, r"^&#([0-9]{1,7});", 1)
    code = lambda p: F.coalesce(F.nullif(deci(p), F.lit("")).try_cast("int"), hexa(p).try_cast("int"))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 4, "0")), "UTF-16BE")
    one = lambda p: F.when(p.rlike(r"^&#[xX]?[0-9a-fA-F]+;") & code(p).between(9, 65535), char(code(p))).otherwise(p)
    out = F.array_join(F.transform(parts, one), "")
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def sanitize(c: Column, strip_tags: bool = False) -> Column:
    """Twice unescaped, without left numeric entities (and tags), white space collapsed, stripped."""
    out = F.regexp_replace(unescape(unescape(c)), r"(?i)&#x?[0-9a-f]+;", "")
    if strip_tags:
        out = F.regexp_replace(out, "<[^>]+>", "")
    return strip(F.regexp_replace(out, rf"(?U){BLANK}+", " "))


def field(xml: Column, tag: str) -> Column:
    """First ``<tag>``, ``<ns:tag>`` or ``<tag attr>`` content, unescaped; NULL without one."""
    shapes = [rf"(?s)<{tag}>(.*?)</{tag}>", rf"(?s)<[^:>]*:{tag}>(.*?)</[^:>]*:{tag}>", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"]
    found = [F.when(xml.rlike(s), F.regexp_extract(xml, s, 1)) for s in shapes]
    return unescape(strip(F.coalesce(*found)))


def to_bool(c: Column) -> Column:
    """0, 1, true, false in any case (and 0.0, 1.0), else NULL."""
    c = F.lower(F.trim(c.cast("string")))
    return F.when(c.isin("1", "true", "1.0"), True).when(c.isin("0", "false", "0.0"), False)


def to_number(c: Column, kind: str = "double") -> Column:
    return F.trim(c.cast("string")).try_cast("double").try_cast(kind)


#: Date layouts that occur in feeds and exports; weekdays are cut off first.
DATES = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "dd MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss z", "MMM dd HH:mm:ss Z yyyy", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy")


def to_datetime(c: Column) -> Column:
    """Timestamp of any known layout, else NULL."""
    bare = F.regexp_replace(F.trim(c.cast("string")), r"^[A-Za-z]{3},? ", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(d)) for d in DATES])


def id_text(c: Column) -> Column:
    """An identifier as text: stripped, without the ``.0`` of a number that was once a float; blank or nan: NULL."""
    c = F.regexp_replace(strip(c.cast("string")), r"^(\d+)\.0$", "$1")
    return F.when(~F.lower(c).isin("", "nan", "none"), c)


def distinct_ignoring_case(xs: Column) -> Column:
    """First occurrences in order, compared in lower case."""
    low = F.transform(xs, F.lower)
    return F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
