"""Every query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pyarrow.dataset as ds
import pytest

from tidemark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.register(p.stem, ds.dataset(str(p)).to_table())
    return con


def rows(pdf):
    def plain(v):
        if pd.isna(v):
            return None
        return str(int(v)) if isinstance(v, (bool, int, float)) and float(v).is_integer() else str(v)

    return sorted([tuple(plain(v) for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("audit_")] + ["audit_orphan_head_revision", "audit_revision_chain_mismatch", "audit_observation_disposition_mismatch", "audit_clean"])
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
