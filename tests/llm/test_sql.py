"""The operators' queries that have SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pagelathe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, sf_dir)
    rel = con.sql(queries.oracle_sql()[name])
    columns = sorted(rel.columns)
    assert sorted(set(df.columns) & set(columns)) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    order = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(x[i] for i in order) for x in rel.fetchall()), key=repr) and got
