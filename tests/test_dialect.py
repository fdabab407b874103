"""Rules of the dialect that differ from Spark's, with values worked out by hand."""

import math

import pytest

from pelagia.functions import spatial
from pelagia.functions.scalar import parse_pattern
from pelagia.session import Connection


@pytest.fixture(scope="module")
def con(spark):
    return Connection(spark)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7 / 2", 3),
        ("-7 / 2", -3),
        ("7 / 2 / 2", 1),
        ("7 / 2.0", 3.5),
        ("7 / (2 / 1.0)", 3.5),
        ("(7 + 1) / 3 * 2", 4),
        ("CASE WHEN true THEN 9 ELSE 1 END / 2", 4),
        ("9 / CASE WHEN true THEN 2 ELSE 1 END", 4),
        ("CAST(9 AS DOUBLE) / 2", 4.5),
        ("9::INT / 2::BIGINT", 4),
        ("[9, 8][0] / 2", 4),
        ("1.0 / 0", math.inf),
        ("-1.0 / 0", -math.inf),
        ("1 - 8 / 3", -1),
    ],
)
def test_division(con, text, want):
    assert con.sql(f"SELECT {text} AS x").fetchone()[0] == want


def test_division_types_and_groups(con):
    assert con.sql("SELECT 7 / 2 AS x, 7.0 / 2 AS y").types == ["int", "double"]
    assert math.isnan(con.sql("SELECT 0.0 / 0 AS x").fetchone()[0])
    rows = con.sql("SELECT x / 2 AS h, sum(x) / count(*) AS m FROM (VALUES (4), (5), (9)) t(x) GROUP BY x / 2 ORDER BY h").fetchall()
    assert rows == [(2, 4), (4, 9)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        con.sql("SELECT 1 / 0").fetchall()
    with pytest.raises(Exception, match="no_such_column"):
        con.sql("SELECT no_such_column / 2").fetchall()
    assert con.sql("SELECT $1 / $2 AS x", [7, 2]).fetchone() == (3,)


def test_nulls_order(con):
    rows = "(VALUES (1), (NULL), (3)) t(x)"
    assert con.sql(f"SELECT x FROM {rows} ORDER BY x").fetchall() == [(1,), (3,), (None,)]
    assert con.sql(f"SELECT x FROM {rows} ORDER BY x DESC").fetchall() == [(None,), (3,), (1,)]
    assert con.sql(f"SELECT x FROM {rows} ORDER BY x DESC NULLS LAST LIMIT 1").fetchall() == [(3,)]
    assert con.sql(f"SELECT x FROM (SELECT * FROM {rows} ORDER BY x LIMIT 2) ORDER BY 1 DESC").fetchall() == [(3,), (1,)]


def test_patterns():
    assert parse_pattern("%d/%m/%Y") == "d/M/yyyy"
    assert parse_pattern("%Y%m%d") == "yyyyMMdd"
    assert parse_pattern("%Hh%M") == "H'h'm"
    with pytest.raises(ValueError, match="%q"):
        parse_pattern("%q")


def test_regular_expressions(con):
    assert con.sql("SELECT regexp_match('foobarbequebaz', '(bar)(beque)')").fetchone() == (["bar", "beque"],)
    assert con.sql("SELECT regexp_instr('ABCDEF', 'c(.)(..)', 1, 1, 'i', 2), regexp_count('abcABC', 'b', 1, 'i'), regexp_count('', 'a*')").fetchone() == (5, 2, 1)
    assert con.sql("SELECT regexp_instr('a€b€', '€', 1, 2), regexp_instr('abc', 'z', 2)").fetchone() == (4, 0)


def test_spatial_functions_need_no_jdk(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("PATH", str(tmp_path))
    import pyspark

    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "pyspark" / "__init__.py"))
    import zipfile

    names = zipfile.ZipFile(spatial.build_jar(spark)).namelist()
    assert "PelagiaSpatial$st_area.class" in names and len(names) > len(spatial.signatures())


def test_reference_systems(con):
    assert con.sql("SELECT st_srid(st_buffer(st_setsrid(st_point(1, 2), 3857), 1)), st_srid(st_geomfromewkb(st_asewkb(st_setsrid(st_point(1, 2), 4326))))").fetchone() == (3857, 0)
    assert con.sql("SELECT st_area(1), st_area('no geometry'), st_area(NULL)").fetchone() == (None, None, None)


def test_constants_are_prepared_and_equal(con):
    con.spark.range(2000).selectExpr("id", "id % 40 - 10.0D AS x", "id % 23 - 5.0D AS y").createOrReplaceTempView("__prepared")
    shape = "POLYGON ((0 0, 20 0, 20 10, 10 4, 0 10, 0 0))"
    got = con.sql(f"SELECT sum(CASE WHEN st_intersects('{shape}', st_point(x, y)) THEN 1 ELSE 0 END), sum(CASE WHEN st_contains('{shape}', st_point(x, y)) THEN 1 ELSE 0 END), sum(CASE WHEN st_covers('{shape}', st_point(x, y)) THEN 1 ELSE 0 END) FROM __prepared").fetchone()

    def place(x, y):
        top = 10 - 0.6 * x if x <= 10 else 4 + 0.6 * (x - 10)
        if not (0 <= x <= 20 and 0 <= y <= top + 1e-12):
            return 0
        return 1 if 0 < x < 20 and 0 < y < top - 1e-12 else 2

    where = [place(i % 40 - 10.0, i % 23 - 5.0) for i in range(2000)]
    assert got == (sum(w > 0 for w in where), sum(w == 1 for w in where), sum(w > 0 for w in where))


def test_ranges_of_where():
    from pelagia.plans.dialect import ranges
    from pelagia.plans.tokens import tokenize

    of = lambda sql: ranges(tokenize(sql))
    assert of("SELECT * FROM t WHERE a >= 3 AND t.b < -2.5 AND c BETWEEN 1 AND 4 AND d = 'x' AND a <= 9 ORDER BY a") == {"a": (3, 9), "b": (None, -2.5), "c": (1, 4)}
    assert of("SELECT * FROM t WHERE a > 3 OR b < 1") == {}
    assert of("SELECT * FROM t WHERE (a > 3 OR b < 1) AND c = 2 AND NOT e > 5 AND f + 1 > 2") == {"c": (2, 2)}
    assert of("SELECT * FROM t JOIN u USING (k) WHERE a > 3") == {} and of("SELECT * FROM t, u WHERE a > 3") == {}
    assert of("SELECT a FROM t WHERE a > 3 UNION ALL SELECT a FROM u") == {}
    assert of("SELECT a FROM t") == {}


def test_statistics_prune_sql_scans(spark, tmp_path):
    con = Connection(spark, root=str(tmp_path / "root"), datasets=str(tmp_path / "data"))
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).selectExpr("id AS a", f"'{k}' AS b", *(["1.5D AS extra"] if k == 3 else [])).coalesce(1).write.parquet(str(tmp_path / "data" / str(k)))
    con.sql(f"CREATE EXTERNAL TABLE t STORED AS PARQUET LOCATION '{tmp_path}/data/*/*.parquet'")
    con.sql(f"ANALYZE FILES '{tmp_path}/data'")
    for source in (f"read_parquet('{tmp_path}/data/*/*.parquet')", "t"):
        df = con.sql(f"SELECT a, b, extra FROM {source} WHERE a BETWEEN 12 AND 18 AND b <> '9'").df
        assert len(df.inputFiles()) == 1 and sorted(r.a for r in df.collect()) == list(range(12, 19)) and df.columns == ["a", "b", "extra"]
        assert con.sql(f"SELECT count(*) AS n FROM {source} WHERE a > 1000").fetchone() == (0,)
        assert con.sql(f"SELECT count(*) AS n FROM {source} WHERE a > 1000 OR b = '2'").fetchone() == (10,)
        assert len(con.sql(f"SELECT x.a FROM {source} x WHERE x.a < 5").df.inputFiles()) == 1
    assert con.sql("SELECT t.a FROM t WHERE t.a = 25").fetchall() == [(25,)]
    assert con.sql("SELECT count(*) FROM (SELECT a FROM t WHERE a >= 30) q JOIN t ON q.a = t.a").fetchone() == (10,)
