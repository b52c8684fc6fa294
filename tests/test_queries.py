"""Every registered query of the grid operators against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from cubespark.plans import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[list]:
    """Rows of the columns in order of their names, sorted with numbers rounded, so that rounding moves no row."""
    one = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    near = lambda x: (x is None, isinstance(x, str), round(x, 5) if isinstance(x, float) else x or "")
    return sorted(([one(x) for x in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: ([near(x) for x in r if not isinstance(x, float)], [near(x) for x in r]))


def same(x, y) -> bool:
    return abs(x - y) <= 2e-6 * max(1, abs(y)) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, duck, key):
    got = QUERIES[key](spark, SF).toPandas()
    want = duck.sql(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    off = [(a, b) for a, b in zip(rows(got), rows(want), strict=True) if not all(map(same, a, b))]
    assert not off, off[:3]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
