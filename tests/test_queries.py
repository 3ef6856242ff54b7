"""Registered market queries against their SQL in DuckDB."""

import math

import duckdb
import pytest

from tidebar import catalogue

#: All on the smallest tables; where ties and long history matter, on ten times as many rows too.
SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
TIES = ["daily_bars", "weekly_bars", "moving_averages", "trend_gate", "relative_strength", "market_change"]


@pytest.fixture(scope="module")
def duck():
    """Connections by folder."""
    found = {}
    for folder in (SMALL, LARGER):
        found[folder] = duckdb.connect()
        for t in TABLES:
            found[folder].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return found


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name, folder", [(n, SMALL) for n in sorted(catalogue.queries())] + [(n, LARGER) for n in TIES])
def test_query_equals_its_sql(spark, duck, name, folder):
    mine = catalogue.queries()[name](spark, folder)
    columns = sorted(mine.columns)
    theirs = duck[folder].execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    rows = sorted((tuple(value(r[c]) for c in columns) for r in mine.collect()), key=str)
    assert rows == sorted((tuple(map(value, r)) for r in theirs), key=str)


def test_catalogue_is_whole():
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) == set(queries) and catalogue.FLAGSHIP in queries
