"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from ledgerflow.plans import catalogue, durability  # noqa: F401

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", catalogue.SQL)
def test_query(spark, data, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, data), duck.sql(catalogue.SQL[name])
    assert {c: TYPES.get(t, t) for c, t in ours.dtypes} == {c: str(t) for c, t in zip(theirs.columns, theirs.types, strict=True)}
    assert rows(ours.toPandas()) == rows(theirs.df())


def test_all_have_sql():
    assert catalogue.QUERIES.keys() == catalogue.SQL.keys()
