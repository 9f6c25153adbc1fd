"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from cutloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, tables, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(tables.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
