"""Every query of the engine against DuckDB on the same tables."""

import math

import duckdb
import pytest

from pelagia import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, other, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    r = other.sql(sql)
    assert sorted(r.columns) == cols
    want = other.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({sql})").fetchall()
    assert got == sorted((tuple(map(norm, x)) for x in want), key=str)
