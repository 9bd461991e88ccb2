"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pyarrow.dataset as ds
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.register("documents", ds.dataset(f"{SF}/documents.parquet").to_table())
    want, got = con.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
