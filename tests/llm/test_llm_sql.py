"""The subpackage's queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from cutloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(row[i] for i in order) for row in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())
