"""Every query with an oracle against DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from tallyloom.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if v is None or isinstance(v, float) and v != v or v is pd.NaT:
        return None
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, pd.Timestamp) else v


def rows(pdf):
    return sorted(repr([plain(v) for v in r]) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
