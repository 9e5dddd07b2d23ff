"""Age resolution: several age or birth-year statements become one age, by folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = 13, 99


def candidates(matches: Column, year: Column) -> Column:
    """array<struct<y,w>>: birth years that the matches mean, in order. Unreadable matches are left out."""

    def one(m: Column) -> Column:
        v, short = m.try_cast("int"), F.regexp_extract(m, r"^'(\d\d)$", 1)
        yy = F.nullif(short, F.lit("")).try_cast("int")
        born = lambda y, w: F.struct(y.cast("int").alias("y"), F.lit(w).cast("double").alias("w"))
        return (
            F.when(yy.isNotNull(), born(F.when(yy > year % 100, yy + 1900).otherwise(yy + 2000), 1.0))
            .when(v.between(F.lit(1900), year), born(v, 1.0))
            .when(v.between(LOW, HIGH), born(year - v, 0.8))
        )

    return F.filter(F.transform(F.when(year.isNotNull(), matches), one), lambda c: c.isNotNull())


def clusters(found: Column) -> Column:
    """array<struct<k,sw,swy,n>>: each candidate joins the first cluster whose first member is within two years."""
    kind = "struct<k:int,sw:double,swy:double,n:int>"

    def add(acc: Column, c: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda x: F.abs(c["y"] - x["k"]) <= 2), True)
        grown = F.transform(acc, lambda x, i: F.when(i + 1 == at, F.struct(x["k"].alias("k"), (x["sw"] + c["w"]).alias("sw"), (x["swy"] + c["y"] * c["w"]).alias("swy"), (x["n"] + 1).alias("n"))).otherwise(x))
        new = F.struct(c["y"].alias("k"), c["w"].alias("sw"), (c["y"] * c["w"]).alias("swy"), F.lit(1).alias("n")).cast(kind)
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(found, F.array().cast(f"array<{kind}>"), add)


def resolve(matches: Column, year: Column) -> Column:
    """struct<age:int, confidence:double>, or NULL where nothing resolves to an age from 13 to 99."""
    kind = "struct<score:double,sw:double,swy:double>"
    best = F.aggregate(
        clusters(candidates(matches, year)),
        F.lit(None).cast(kind),
        lambda b, x: F.when(b.isNull() | (x["sw"] + x["n"] * F.lit(0.1) > b["score"]), F.struct((x["sw"] + x["n"] * F.lit(0.1)).alias("score"), x["sw"].alias("sw"), x["swy"].alias("swy"))).otherwise(b),
    )
    age = (year - F.rint(F.try_divide(best["swy"], best["sw"])).cast("int")).cast("int")
    sure = F.least(F.lit(1.0), F.try_divide(best["score"], F.size(matches).cast("double")))
    return F.when(age.between(LOW, HIGH), F.struct(age.alias("age"), sure.alias("confidence")))


def birthyear(value: Column, year: Column) -> Column:
    """Birth year of a single number: a year of someone aged 13 to 99, or such an age; else NULL."""
    v = value.try_cast("int")
    return F.when(v.between(year - HIGH, year - LOW), v).when(v.between(LOW, HIGH), year - v)


def birthyears(matches: Column, year: Column) -> Column:
    return F.filter(F.transform(matches, lambda m: birthyear(m, year)), lambda y: y.isNotNull())


def majority_birthyear(matches: Column, resolved: Column, year: Column) -> Column:
    """Year of the resolved age; unresolved, of the first match alone."""
    return F.when(resolved.isNotNull(), year - resolved["age"]).otherwise(birthyear(F.get(matches, 0), year))
