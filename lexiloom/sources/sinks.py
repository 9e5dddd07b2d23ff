"""Sinks. Executors write their own files; output columns are fixed beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_SEPARATOR = "|"


def flat(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The given columns in order (absent ones NULL), arrays as ``|``-joined text."""
    columns = columns or tuple(df.columns)
    df = df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns})
    kinds = dict(df.dtypes)
    return df.select(*[F.array_join(F.transform(F.col(f"`{c}`"), lambda x: x.cast("string")), LIST_SEPARATOR).alias(c) if kinds[c].startswith("array") else F.col(f"`{c}`") for c in columns])


def tsv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Tab-separated with a header in every file; an empty table writes one file with the header alone."""
    flat(df, columns).write.mode(mode).options(sep="\t", header="true", quote='"', escape='"').partitionBy(*partition_by).csv(path)


def csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    flat(df, columns).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def raw_lines(df: DataFrame) -> int:
    """How many rows hold a raw line break or tab in any text column."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        if kind == "string":
            bad = bad | F.coalesce(F.col(f"`{name}`").rlike("[\n\r\t]"), F.lit(False))
    return df.where(bad).count()


def escaped_tsv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    r"""Tab-separated without quotes, escaped by backslashes; raw line breaks and tabs raise ``ValueError``.

    A backslash is ``\\``, U+0000 is ``\0``, NULL is ``\N``, an empty text is an empty field; ``readers.escaped_table`` reads all of it back.
    """
    out = flat(df, columns)
    if n := raw_lines(out):
        raise ValueError(f"{n} rows hold raw line breaks or tabs")
    # Spark's reader takes U+0000 as its quote
    texts = {c: F.replace(F.replace(F.col(f"`{c}`"), F.lit("\\"), F.lit("\\\\")), F.lit("\0"), F.lit("\\0")) for c, kind in out.dtypes if kind == "string"}
    first = out.columns[0]
    if first in texts:  # a blank line would not be read, and Spark's writer quotes lines that begin with #
        plain = texts[first].rlike(r"[^\x00-\x20]") & texts[first].rlike(r"\A[^#]")
        texts[first] = F.when(plain, texts[first]).otherwise(F.concat(F.lit("\\&"), texts[first]))
    options = {"sep": "\t", "header": "true", "quote": "", "escape": "\\", "emptyValue": "", "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    out.select(*[texts.get(c, F.col(f"`{c}`")).alias(c) for c in out.columns]).write.mode("overwrite").options(**options).csv(path)


def parquet(df: DataFrame, path: str, by_month: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*(("Year", "Month") if by_month else ())).parquet(path)


def single_file(df: DataFrame, path: str) -> None:
    """All rows in one TSV file: only for results that one task can write."""
    flat(df).coalesce(1).write.mode("overwrite").options(sep="\t", header="true").csv(path)
