"""The queries with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from ledgerflow.llm import queries


def rows(frame: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, data, name):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    ours = queries.queries()[name](spark, data).toPandas()
    theirs = con.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) > 0
    assert rows(ours) == rows(theirs)


def test_lower_casing_is_of_ascii_only(spark, tmp_path):
    """Letters whose lower case is ASCII, as the Kelvin sign, stay as they are."""
    texts = ["Under The MIT License", "SEE LICENSE FOR DETAILS Keep", "İ CC BY NC İ", "GNÜ GNU General Public License Version 2", None, ""]
    path = str(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    ours = queries.queries()["op2_license_scan"](spark, str(tmp_path)).toPandas()
    assert rows(ours) == rows(con.sql(queries.oracle_sql()["op2_license_scan"]).df())
    assert ours.set_index("doc_id").loc[[0, 2], "n_base"].tolist() == [1, 1]
