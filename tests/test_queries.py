"""Every registered query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from lexiloom import queries as Q

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, tables, name):
    got = Q.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in Q.SQL:
        assert len(got.columns)
        return
    want = tables.execute(Q.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got.where(got.notna(), None), columns) == rows(want.astype(object).where(want.notna(), None), columns)
