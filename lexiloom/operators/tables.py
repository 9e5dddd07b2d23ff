"""Small pieces that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; a column that a table lacks is NULL in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
