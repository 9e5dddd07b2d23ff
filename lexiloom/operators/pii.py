"""Personal data: recognisers from public standards, as patterns with check digits.

e-mail (RFC 5322 subset), IPv4 and IPv6, IBAN (ISO 13616, modulo 97), DEA numbers of medical licences (check digit),
phone numbers (E.164 and North American shapes), Bitcoin addresses (bech32 shapes; base58 with its double SHA-256
checksum, the one function that needs Python).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.schema import PII_TYPES

# Patterns without look-around, so that other engines read them alike; the value is group 1.
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b({OCTET}\.{OCTET}\.{OCTET}\.{OCTET})\b"
IPV6 = r"\b((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})\b"
IBAN = r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"
DEA = r"\b([ABCDEFGHJKLMPRSTUXabcdefghjklmprstux][A-Za-z9][0-9]{7})\b"
PHONE = r"(\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b)"
BECH32 = r"\b(bc1[ac-hj-np-z02-9]{11,71})\b"
BASE58 = r"\b([13][1-9A-HJ-NP-Za-km-z]{25,34})\b"
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def every(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def iban_ok(value: Column) -> Column:
    """Length 15 to 34 and the ISO 7064 remainder is 1, folded digit by digit."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    chars = F.split(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4))), "")
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (r * 100 + F.ascii(c) - 55) % 97).otherwise(r)
    return F.length(bare).between(15, 34) & (F.aggregate(chars, F.lit(0), step) == 1)


def dea_ok(value: Column) -> Column:
    """Sum of digits 1, 3, 5 and twice that of digits 2, 4, 6 ends in digit 7."""
    d = lambda i: F.substring(value, i + 2, 1).try_cast("int")
    return (d(1) + d(3) + d(5) + 2 * (d(2) + d(4) + d(6))) % 10 == d(7)


def base58_valid(address: str) -> bool:
    n = 0
    for c in address:
        n = n * 58 + ALPHABET.index(c)
    raw = b"\0" * (len(address) - len(address.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _checked(found: pd.Series) -> pd.Series:
    return found.map(lambda xs: [x for x in xs if base58_valid(x)])


def recognise(text: Column, crypto: bool = True) -> dict[str, Column]:
    """Distinct values of each type, in order of appearance. ``crypto=False`` leaves Python out altogether."""
    out = {
        "EMAIL_ADDRESS": every(text, EMAIL),
        "IBAN_CODE": F.filter(every(text, IBAN), iban_ok),
        "IP_ADDRESS": F.array_distinct(F.concat(every(text, IPV4), every(text, IPV6))),
        "MEDICAL_LICENSE": F.filter(every(text, DEA), dea_ok),
        "PHONE_NUMBER": every(text, PHONE),
    }
    base58 = every(text, BASE58)
    return out | {"CRYPTO": F.array_distinct(F.concat(every(text, BECH32), F.when(F.size(base58) > 0, _checked(base58)).otherwise(base58))) if crypto else every(text, BECH32)}


def detect(df: DataFrame, text: Column, *, only_found: bool = True, crypto: bool = True) -> DataFrame:
    """``df`` with a ``; ``-joined column per type, the sorted types, the number of values and a flag."""
    text = F.coalesce(text, F.lit(""))
    out = df.withColumns({f"_{t}": c for t, c in recognise(text, crypto).items()})
    names = F.array_sort(F.filter(F.array(*[F.when(F.size(f"_{t}") > 0, F.lit(t)) for t in PII_TYPES]), lambda t: t.isNotNull()))
    total = F.lit(0)
    for t in PII_TYPES:
        total = total + F.size(f"_{t}")
    cols = {f"PII_{t}": F.array_join(f"_{t}", "; ") for t in PII_TYPES} | {"PII_Types_Found": F.array_join(names, "; "), "PII_Count": total, "Has_PII": total > 0}
    out = out.withColumns(cols).drop(*[f"_{t}" for t in PII_TYPES])
    return out.where("Has_PII") if only_found else out
