"""Every registered query against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as contract

SF = os.environ.get("CONTRACT_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(float(v) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine = contract.queries()[name](spark, SF).toPandas()
    other = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
    assert len(mine) > 0


@pytest.mark.parametrize("name", [n for n in contract.queries() if n not in contract.oracle_sql()])
def test_rows_without_sql(spark, name):
    assert len(contract.queries()[name](spark, SF).toPandas()) > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
