"""Every registered query of the library against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "null"
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def rows(frame):
    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
