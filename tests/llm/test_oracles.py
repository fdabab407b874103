"""Operators that SQL can express, over whole tables against DuckDB."""

import duckdb
import pytest

from pelagia import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, sf, name):
    other = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        other.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = other.sql(f"SELECT {quoted} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == sorted(want, key=str)
