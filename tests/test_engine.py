import json
import math
import os
import zlib

import numpy as np
import pytest

from pelagia.auth import AccessError
from pelagia.catalog import CatalogError
from pelagia.functions import spatial, vocab
from pelagia.plans import jsonquery
from pelagia.plans.dialect import Rewriter
from pelagia.session import Connection


@pytest.fixture()
def con(spark, tmp_path):
    c = Connection(spark, str(tmp_path / "catalog"), datasets=str(tmp_path))
    spark.sql("SELECT * FROM VALUES (1L, 'x'), (2L, 'y'), (3L, 'y'), (4L, 'z') AS t(a, name)").createOrReplaceTempView("jq")
    return c


def rewrite(sql):
    class None_:
        knows = staticmethod(lambda name: False)

    return Rewriter(None, None_(), None, None)(sql)


def test_rewrites():
    assert rewrite('SELECT "a""b", FROM t;') == 'SELECT `a"b` FROM t'
    assert rewrite("SELECT * EXCLUDE (a, b) FROM t") == "SELECT * EXCEPT (a, b) FROM t"
    assert rewrite("SELECT [1, [2]] , x[1] FROM t") == "SELECT array(1, array(2)), x [1] FROM t"
    assert rewrite("SELECT try_arrow_cast(a, 'Int64') FROM t") == "SELECT try_cast(a AS bigint) FROM t"
    assert rewrite("SELECT a FROM t WHERE b = $2") == "SELECT a FROM t WHERE b = :p2"
    assert "__qualify" in rewrite("SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1 ORDER BY a")
    with pytest.raises(ValueError, match="non-empty string literal"):
        rewrite("SELECT try_arrow_cast(a, b) FROM t")


def test_json_query_pins(con):
    q = lambda **b: [tuple(r) for r in con.json_query({k.rstrip("_"): v for k, v in b.items()}).df.collect()]
    assert q(select=["a"], from_="jq", filter={"column": "a", "gt": 2}) == [(3,), (4,)]
    with pytest.raises(jsonquery.QueryError, match="name"):
        q(select=["a"], from_="jq", filter={"column": "name", "eq": "x"})
    with pytest.raises(jsonquery.QueryError, match="avg"):
        q(select=[{"function": "avg", "args": ["a"]}], from_="jq")
    with pytest.raises(jsonquery.QueryError, match="select"):
        q(from_="jq", distinct={"on": ["a"], "select": ["a"]})
    with pytest.raises(jsonquery.QueryError, match="typo"):
        q(select=["a"], from_="jq", typo=1)
    with pytest.raises(jsonquery.QueryError, match="sort_by"):
        q(select=["a"], from_="jq", sort_by=[{"asc": "a"}])
    assert q(select=["a"], from_="jq", filters=[{"column": "a", "min": 2}, {"column": "a", "lt_eq": 3}], sort_by=[{"Desc": "a"}]) == [(3,), (2,)]
    assert q(select=[{"column": "a", "alias": "b"}, {"value": 7, "alias": "c"}], from_="jq", limit=1, offset=3) == [(4, 7)]


def test_statements(con, tmp_path):
    sql = lambda s, *p: [tuple(r) for r in con.sql(s, *p).df.collect()]
    sql("CREATE TABLE t (id BIGINT, name VARCHAR)")
    assert sql("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, NULL)") == [(3,)]
    sql("DELETE FROM t WHERE name = 'a'")  # a null condition keeps its row
    assert sorted(sql("SELECT id FROM t")) == [(2,), (3,)]
    sql("UPDATE t SET name = 'c', id = id * 10 WHERE id = 3")
    assert sorted(sql("SELECT id, name FROM t")) == [(2, "b"), (30, "c")]
    sql("ALTER TABLE t ADD COLUMN extra DOUBLE")
    sql("ALTER TABLE t ALTER COLUMN id TYPE INTEGER")
    sql("ALTER TABLE t RENAME COLUMN name TO label")
    sql("ALTER TABLE t DROP COLUMN extra")
    assert sql("DESCRIBE t") == [("id", "Int32", True), ("label", "Utf8", True)]
    with pytest.raises(CatalogError, match="already exists"):
        sql("CREATE TABLE t (id BIGINT)")
    sql("CREATE TABLE IF NOT EXISTS t (id BIGINT)")
    sql("CREATE VIEW v AS SELECT id FROM t WHERE id > 5")
    assert sql("SELECT * FROM v") == [(30,)]
    sql("CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM t")
    sql("INSERT INTO t VALUES (7, 'd')")
    assert sql("SELECT n FROM m") == [(2,)]
    sql("REFRESH MATERIALIZED VIEW m")
    assert sql("SELECT n FROM m") == [(3,)]
    sql("CREATE INDEX ix ON t (id) USING BTREE")
    assert sql("SHOW INDEXES ON t") == [("t", "ix", ["id"], "btree")]
    assert ("t", "managed") in sql("SHOW TABLES") and ("m", "materialized view") in sql("SHOW TABLES")
    with pytest.raises(CatalogError, match="not a managed table"):
        sql("DELETE FROM v")
    assert sql("SELECT * FROM t WHERE id = $1", [7]) == [(7, "d")]
    assert sql(f"COPY (SELECT id FROM t) TO '{tmp_path}/out.arrow' STORED AS ARROW") == [(3,)]
    assert sorted(sql("SELECT id FROM read_arrow('out.arrow')")) == [(2,), (7,), (30,)]
    again = Connection(con.spark, con.root)
    assert again.sql("SELECT count(*) FROM t").fetchone() == (3,)
    assert con.catalog.vacuum() > 0
    assert again.sql("SELECT count(*) FROM t").fetchone() == (3,)
    sql("DROP TABLE t")
    with pytest.raises(CatalogError, match="does not exist"):
        sql("DROP TABLE t")
    sql("DROP TABLE IF EXISTS t")
    assert [r[0] for r in con.sql("EXPLAIN SELECT * FROM jq").fetchall()] == ["logical_plan", "physical_plan"]


def test_summarize(con):
    con.spark.sql("SELECT * FROM VALUES (10D, 0L, 'A'), (20D, 50L, 'B'), (30D, 100L, 'A'), (NULL, 100L, 'A') AS t(temperature, depth, platform)").createOrReplaceTempView("obs")
    rows = {r.column_name: r for r in con.sql("SUMMARIZE obs").df.collect()}
    t = rows["temperature"]
    assert (t.min, t.max, t.distinct_count, t.avg, t["count"], t.null_percentage) == ("10.0", "30.0", 3, 20.0, 3, 25.0)
    assert list(rows) == ["temperature", "depth", "platform"] and rows["platform"].avg is None and rows["platform"].distinct_count == 2


def test_access(con):
    for s in ("CREATE TABLE s (a BIGINT)", "CREATE TABLE u (a BIGINT)", "CREATE USER bob WITH PASSWORD 'pw'", "CREATE ROLE reader", "GRANT SELECT ON TABLE s TO ROLE reader", "GRANT ROLE reader TO bob"):
        con.sql(s)
    bob = Connection(con.spark, con.root, user="bob")
    assert bob.sql("SELECT * FROM s").fetchall() == []
    for bad in ("SELECT * FROM u", "SELECT * FROM s WHERE a IN (SELECT a FROM u)", "INSERT INTO s VALUES (1)", "DROP TABLE s", "CREATE ROLE x", "SELECT * FROM read_parquet('/root/testdata/sf0.001/nation.parquet')"):
        with pytest.raises(AccessError):
            bob.sql(bad)
    con.sql("DENY SELECT ON TABLE s TO ROLE reader")
    with pytest.raises(AccessError):
        Connection(con.spark, con.root, user="bob").sql("SELECT * FROM s")
    assert con.authority.login("bob", "pw") and not con.authority.login("bob", "no")


def test_crawler_rules():
    from pelagia.crawler import group, table_name

    got = group(["a/y=1/m=2/f.parquet", "a/y=2/m=1/g.parquet", "b/x.csv", "b/y=1/x.csv", "c/_tmp/f.parquet", "d/readme.md"])
    assert got["parquet", "a"]["partitions"] == ["y", "m"] and got["csv", "b"]["partitions"] == []
    assert table_name("2020/x", "csv", "", {"t_2020_x"}) == "t_2020_x_csv"


def test_csv_and_widening(con, tmp_path):
    (tmp_path / "one.csv").write_text("v,name\n1,a\n2,b\n")
    (tmp_path / "two.csv").write_text("v,name\n3.5,c\n")
    (tmp_path / "semi.csv").write_text("a;b;c\n1;2;3\n")
    assert sorted(con.sql("SELECT v, name FROM read_csv(['one.csv', 'two.csv'])").fetchall()) == [(1.0, "a"), (2.0, "b"), (3.5, "c")]
    assert con.sql("SELECT * FROM read_csv('semi.csv', ';')").fetchall() == [(1, 2, 3)]
    assert con.sql("SELECT column_name FROM read_csv_schema('one.csv')").fetchall() == [("v",), ("name",)]
    assert con.json_query({"select": ["v"], "from": {"csv": {"paths": ["one.csv"]}}, "filter": {"column": "v", "gt_eq": 2}}).fetchall() == [(2,)]
    with pytest.raises(FileNotFoundError):
        con.sql("SELECT * FROM read_csv('none.csv')")


def test_zarr_and_netcdf_sources(con, tmp_path):
    group = tmp_path / "g.zarr"
    for name, shape, dims in (("lat", [2], ["lat"]), ("v", [2, 3], ["lat", "lon"])):
        (group / name / "c").mkdir(parents=True)
        meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "attributes": {}, "dimension_names": dims}
        (group / name / "zarr.json").write_text(json.dumps(meta))
        key = "c." + ".".join("0" * len(shape))
        (group / name / key).write_bytes(np.arange(np.prod(shape), dtype="<f8").tobytes())
    (group / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}))
    assert sorted(con.sql("SELECT lat, v FROM read_zarr('g.zarr/zarr.json')").fetchall()) == [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (1.0, 3.0), (1.0, 4.0), (1.0, 5.0)]
    assert con.sql("SELECT count(*) FROM (SELECT lat FROM read_zarr('g.zarr/zarr.json'))").fetchone() == (2,)
    con.spark.range(6).selectExpr("id % 2 AS y", "id DIV 2 AS x", "CAST(id AS DOUBLE) AS v").createOrReplaceTempView("grid")
    con.sql("SELECT * FROM grid").to_nd_netcdf(str(tmp_path / "n.nc"), ["y", "x"])
    con.sql("CREATE EXTERNAL TABLE nc STORED AS NETCDF LOCATION 'n.nc'")
    assert con.sql("SELECT v FROM nc WHERE y = 1 ORDER BY v").fetchall() == [(1.0,), (3.0,), (5.0,)]
    assert con.sql("SELECT y FROM nc").df.count() == 2


def write_zarr(group, rng, arrays, attrs):
    """arrays: name -> (dims, shape, chunk, dtype). Some chunks stay unwritten."""
    files = {"zarr.json": json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attrs}).encode()}
    for name, (dims, shape, chunk, dtype) in arrays.items():
        meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default"}, "fill_value": 7, "codecs": [{"name": "bytes"}, {"name": "gzip"}], "attributes": {"units": name}, "dimension_names": dims}
        files[f"{name}/zarr.json"] = json.dumps(meta).encode()
        for at in np.ndindex(*[-(-s // c) for s, c in zip(shape, chunk)]):
            if rng.random() < 0.8:
                raw = rng.integers(0, 100, chunk).astype(dtype).tobytes()
                files["/".join([name, "c", *map(str, at)])] = zlib.compress(raw, wbits=31)
    for path, content in files.items():
        (group / path).parent.mkdir(parents=True, exist_ok=True)
        (group / path).write_bytes(content)
    return files


@pytest.mark.parametrize(("columns", "dimensions"), [(None, None), (["lat"], None), (["v", "lat"], None), (["w", "v.units", ".title"], None), (["v"], ["t", "y"]), (["lat", "k"], ["y", "x"]), ([".title"], None), (["k"], None)])
def test_zarr_blocks_equal_the_whole(spark, tmp_path, columns, dimensions):
    from pelagia import nd
    from pelagia.sources import formats, readers

    rng = np.random.default_rng(len(str(columns)))
    want = []
    for g in ("a", "b"):
        arrays = {"v": (["t", "y", "x"], [5, 4, 7], [2, 3, 4], "float32"), "w": (["t", "y", "x"], [5, 4, 7], [5, 2, 2], "int16"), "lat": (["y"], [4], [4], "float64"), "lon": (["x"], [7], [3], "float64"), "k": ([], [], [], "int32")}
        files = write_zarr(tmp_path / g, rng, arrays, {"title": g})
        for part in nd.flatten(formats.zarr(files), columns, dimensions):
            want += [tuple(sorted(r.items())) for r in part.to_pylist()]
    df = readers.read_zarr(spark, f"{tmp_path}/*/zarr.json", dimensions, columns)
    assert sorted(tuple(sorted(r.asDict().items())) for r in df.collect()) == sorted(want)


def test_ragged_zarr(spark, tmp_path):
    from pelagia.sources import readers

    files = write_zarr(tmp_path / "r", np.random.default_rng(0), {"t": (["obs"], [5], [2], "float32")}, {})
    meta = json.loads(files["t/zarr.json"]) | {"shape": [2], "data_type": "int32", "attributes": {"sample_dimension": "obs"}, "dimension_names": ["cast"], "fill_value": 2}
    (tmp_path / "r" / "n").mkdir()
    (tmp_path / "r" / "n" / "zarr.json").write_text(json.dumps(meta))
    assert readers.read_zarr(spark, f"{tmp_path}/r/zarr.json").count() == 4


def test_clusters_over_windows(con):
    con.spark.sql("SELECT id AS k, id % 2 AS half, CAST(id DIV 10 * 100 + id % 10 AS DOUBLE) AS x FROM range(40)").createOrReplaceTempView("pts")
    got = con.sql("SELECT p.k, ST_ClusterDBSCAN(ST_Point(p.x, 0), 2.5, 3) OVER () AS c, 1 AS one FROM pts AS p WHERE k < 31 ORDER BY k").fetchall()
    assert got == [(k, k // 10 if k < 30 else None, 1) for k in range(31)]
    got = con.sql("SELECT *, coalesce(st_clusterdbscan(st_point(x, 0), 2.5, 3) OVER (PARTITION BY half), -1) AS c FROM (SELECT k, half, x FROM pts)").df
    assert got.columns == ["k", "half", "x", "c"] and {(r.k, r.c) for r in got.collect()} == {(k, k // 10) for k in range(40)}
    for over in ("", "PARTITION BY half"):
        rows = con.sql(f"WITH q AS (SELECT * FROM pts) SELECT k, half, ST_ClusterKMeans(ST_Point(x, 0), 4) OVER ({over}) AS c FROM q QUALIFY row_number() OVER (ORDER BY k) > 0").fetchall()
        groups = {}
        for k, half, c in rows:
            groups.setdefault((half if over else 0, c), set()).add(k // 10)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == (8 if over else 4)
    with pytest.raises(ValueError, match="OVER"):
        con.sql("SELECT ST_ClusterKMeans(ST_Point(x, 0), 4) FROM pts")


def test_many_csv_files(con, tmp_path):
    from pelagia.sources import readers
    from pelagia.types import WideningError

    d = tmp_path / "many"
    d.mkdir()
    for k in range(20):
        if k % 2:
            (d / f"{k:02}.csv").write_text(f"v,name,day,t\n{k},n {k},2020-01-0{k % 9 + 1},2020-01-01T00:00:0{k % 10}\n,,,\n")
        else:
            (d / f"{k:02}.csv").write_text(f"v,extra,ok\r\n{k}.5,{3_000_000_000 + k},true\r\n")
    df = readers.read_csv(con.spark, f"{d}/*.csv")
    assert dict(df.dtypes) == {"v": "double", "extra": "bigint", "ok": "boolean", "name": "string", "day": "date", "t": "timestamp"}
    assert df.count() == 30 and df.agg({"v": "sum"}).first()[0] == sum(range(20)) + 5 and df.filter("name = 'n 7' AND extra IS NULL").count() == 1
    assert len(df.inputFiles()) == 20 and df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    (d / "20.csv").write_text("v\nword\n")
    with pytest.raises(WideningError, match="20.csv"):
        readers.read_csv(con.spark, f"{d}/*.csv")


def test_csv_types_do_not_depend_on_the_number_of_files(con, tmp_path):
    import gzip

    from pelagia.sources import readers

    rows = [("12345678901234567891", "1", ""), ("12345678901234567892", "2.5", "")]
    for n in (1, 16, 17):
        d = tmp_path / f"n{n}"
        d.mkdir()
        for k in range(n):
            (d / f"{k:02}.csv").write_text("id,v,none\n" + "".join(",".join(r) + "\n" for r in rows))
        df = readers.read_csv(con.spark, f"{d}/*.csv")
        assert df.dtypes == [("id", "decimal(20,0)"), ("v", "double"), ("none", "string")]
        assert sorted(str(r.id) for r in df.select("id").distinct().collect()) == [r[0] for r in rows] and df.count() == 2 * n
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"id\n" + b"9" * 39 + b"\n"))
    assert readers.read_csv(con.spark, f"{tmp_path}/z.csv.gz").dtypes == [("id", "double")]


def test_delta_raises_on_what_it_cannot_read(con, tmp_path):
    d = tmp_path / "delta"
    (d / "_delta_log").mkdir(parents=True)
    con.spark.range(4).coalesce(1).write.parquet(str(d / "p"))
    name = next(f"p/{f}" for f in os.listdir(d / "p") if f.endswith(".parquet"))
    schema = con.spark.range(1).schema.json()
    vector = {"storageType": "i", "pathOrInlineDv": "x", "sizeInBytes": 1, "cardinality": 1}

    def read(protocol=None, conf=None, dv=None, later=()):
        add = {"path": name, "partitionValues": {}} | ({"deletionVector": dv} if dv else {})
        first = [{"metaData": {"schemaString": schema, "partitionColumns": [], "configuration": conf or {}}}, {"add": add}]
        first += [{"protocol": protocol}] if protocol else []
        (d / "_delta_log" / f"{0:020d}.json").write_text("\n".join(map(json.dumps, first)))
        (d / "_delta_log" / f"{1:020d}.json").write_text("\n".join(map(json.dumps, later or [{"commitInfo": {}}])))
        return con.sql("SELECT * FROM read_delta('delta')").fetchall()

    assert len(read({"minReaderVersion": 3, "readerFeatures": ["timestampNtz", "deletionVectors"]})) == 4
    for kwargs, word in (
        ({"protocol": {"minReaderVersion": 3, "readerFeatures": ["variantType"]}}, "variantType"),
        ({"conf": {"delta.columnMapping.mode": "name"}}, "column mapping"),
        ({"dv": vector}, "deletion vectors"),
        ({"later": [{"add": {"path": name, "partitionValues": {}, "deletionVector": vector}}, {"remove": {"path": name}}]}, "deletion vectors"),
    ):
        with pytest.raises(ValueError, match=word):
            read(**kwargs)
    assert len(read(dv=vector, later=[{"remove": {"path": name, "deletionVector": vector}}, {"add": {"path": name, "partitionValues": {}}}])) == 4
    (d / "_delta_log" / f"{0:020d}.json").unlink()
    point = "SELECT CAST(NULL AS STRUCT<path: STRING, partitionValues: MAP<STRING, STRING>>) AS add, CAST(NULL AS STRUCT<schemaString: STRING>) AS metaData, named_struct('path', 's') AS sidecar"
    con.spark.sql(point).coalesce(1).write.parquet(str(tmp_path / "point"))
    os.rename(next((tmp_path / "point").glob("*.parquet")), d / "_delta_log" / f"{0:020d}.checkpoint.parquet")
    with pytest.raises(ValueError, match="sidecars"):
        con.sql("SELECT * FROM read_delta('delta')")


def test_iceberg_raises_on_changed_names(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from pelagia.sources.readers import _iceberg_known

    field = lambda i, n: {"id": i, "name": n, "type": "long"}
    nested = {"id": 5, "name": "s", "type": {"type": "list", "element-id": 6, "element": {"type": "struct", "fields": [field(7, "x")]}}}
    at = lambda i: {"PARQUET:field_id": str(i)}
    inner = pa.list_(pa.field("element", pa.struct([pa.field("x", pa.int64(), metadata=at(7))]), metadata=at(6)))
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table([[1], [[{"x": 2}]]], schema=pa.schema([pa.field("a", pa.int64(), metadata=at(1)), pa.field("s", inner, metadata=at(5))])), path)
    _iceberg_known(spark, "t", [], [field(1, "a"), nested, field(9, "new")], [path])
    renamed = json.loads(json.dumps(nested).replace('"x"', '"y"'))
    for fields in ([field(1, "b"), nested], [field(2, "a"), nested], [field(1, "a"), renamed]):
        with pytest.raises(ValueError, match="named"):
            _iceberg_known(spark, "t", [], fields, [path])
    with pytest.raises(ValueError, match="earlier schema"):
        _iceberg_known(spark, "t", [{"fields": [field(1, "a")]}], [field(1, "b")], [])


def test_iceberg_without_snapshot_and_missing(con, tmp_path):
    (tmp_path / "ice" / "metadata").mkdir(parents=True)
    meta = {"format-version": 2, "location": "x", "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "a", "type": "long", "required": True}]}], "snapshots": []}
    (tmp_path / "ice" / "metadata" / "v1.metadata.json").write_text(json.dumps(meta))
    df = con.sql("SELECT * FROM read_iceberg('ice')").df
    assert df.dtypes == [("a", "bigint")] and df.count() == 0
    with pytest.raises(ValueError, match="snapshot"):
        con.sql("SELECT * FROM read_iceberg('ice', 5)")


def test_spatial_functions(con):
    one = lambda e: con.sql(f"SELECT {e} AS x").fetchone()[0]
    sq = "'POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))'"
    assert one(f"ST_Area({sq})") == 16 and one(f"ST_Perimeter({sq})") == 16 and one("ST_Length('LINESTRING (0 0, 3 4)')") == 5
    assert one(f"ST_Contains({sq}, ST_Point(1, 1))") is True and one(f"ST_Contains({sq}, ST_Point(0, 1))") is False and one(f"ST_Covers({sq}, ST_Point(0, 1))") is True
    assert one(f"ST_AsText(ST_Centroid({sq}))") == "POINT (2 2)" and one("ST_X('nonsense')") is None and one("ST_Z(ST_Point(1, 2, 3))") == 3
    assert one(f"ST_Relate({sq}, ST_Point(1, 1))") == "0F2FF1FF2" and one(f"ST_Relate({sq}, ST_Point(1, 1), 'T*****FF*')") is True
    assert one("ST_GeoHash(ST_Point(-5.6, 42.6), 5)") == "ezs42" and one("ST_IsValidReason('POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))')").startswith("Self-intersection")
    assert one("ST_AsText(ST_LineInterpolatePoint('LINESTRING (0 0, 10 0)', 0.3))") == "POINT (3 0)" and one("ST_LineInterpolatePoint('LINESTRING (0 0, 1 0)', 2.0)") is None
    assert one(f"ST_Envelope({sq})").asDict() == {"xmin": 0, "ymin": 0, "xmax": 4, "ymax": 4}
    assert abs(one("ST_DistanceSpheroid(ST_Point(0, 0), ST_Point(1, 0))") - 111319.4908) < 0.01
    assert abs(one("ST_X(ST_Transform(ST_Point(4.9, 52.4), 4326, 3857))") - 545465.50) < 0.1
    assert abs(one("ST_Y(ST_Transform(ST_Transform(ST_Point(4.9, 52.4), 4326, 32631), 32631, 4326))") - 52.4) < 1e-7
    assert len(one("ST_Dump('MULTIPOINT ((0 0), (1 1))')")) == 2 and one("st_within_point('POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))', 1, 1)") is True
    assert one("st_within_point(CAST(NULL AS STRING), 1, 1)") is False
    assert len(spatial.signatures()) >= 122


def test_spatial_aggregates(con):
    df = con.spark.sql("SELECT id % 2 AS g, concat('POLYGON ((', id, ' 0, ', id + 2, ' 0, ', id + 2, ' 2, ', id, ' 2, ', id, ' 0))') AS geom FROM range(4)")
    got = {r.g: r.extent for r in spatial.extent_of(df, "geom", ["g"]).collect()}
    assert got[0].xmin == 0 and got[0].xmax == 4 and got[1].xmax == 5
    spatial.union_of(df, "geom").createOrReplaceTempView("un")
    assert con.sql("SELECT ST_Area(geom) AS a FROM un").fetchone()[0] == 10
    spatial.collect_of(df, "geom").createOrReplaceTempView("co")
    assert con.sql("SELECT ST_NumGeometries(geom) AS n FROM co").fetchone()[0] == 4


def test_clusters(con):
    rng = np.random.default_rng(0)
    pts = [(i, float(10 * (i % 3) + rng.normal(0, 0.3)), float(rng.normal(0, 0.3))) for i in range(60)] + [(99, 500.0, 500.0)]
    df = con.spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.cluster for r in spatial.cluster_dbscan(df, "id", "x", "y", 1.5, 3).collect()}
    assert got[99] is None and [got[i] for i in range(3)] == [0, 1, 2] and all(got[i] == i % 3 for i in range(60))
    k = {r.id: r.cluster for r in spatial.cluster_kmeans(df.filter("id < 60"), "x", "y", 3).collect()}
    assert len({k[i] for i in range(3)}) == 3 and all(k[i] == k[i % 3] for i in range(60))


def test_dbscan_against_brute_force(con):
    """Random places of both kinds of cells, some twice, some without numbers, and neighbours whose quotients round to cells two apart."""
    rng = np.random.default_rng(2)
    pts = [(i, int(i % 2), float(rng.integers(-8, 8)) / 2 + (i % 5 == 0) * float(rng.normal()), float(rng.integers(-4, 4)) / 3) for i in range(300)]
    pts += [(300, 0, None, 0.0), (301, 0, math.nan, 0.0), (302, 1, math.inf, 0.0)] + [(303 + i, 2, x, 0.0) for i, x in enumerate((-1e-18, 0.1, 0.2))]
    for eps, least in ((0.5, 4), (0.1, 2), (0.0, 2)):
        near = {p[0]: [q[0] for q in pts if p[1] == q[1] and all(v is not None and math.isfinite(v) for v in (p[2], q[2])) and (p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3]) <= eps * eps] for p in pts}
        first = {}
        for k in (k for k in near if len(near[k]) >= least and k not in first):
            reached = [k]
            while reached:
                j = reached.pop()
                if len(near[j]) >= least and j not in first:
                    first[j] = k
                    reached += near[j]
        want = first | {k: min(first[j] for j in v if j in first) for k, v in near.items() if k not in first and any(j in first for j in v)}
        number = {(g, c): i for g in range(3) for i, c in enumerate(sorted({c for k, c in first.items() if pts[k][1] == g}))}
        df = con.spark.createDataFrame(pts, "id long, g int, x double, y double")
        got = {r.id: r.cluster for r in spatial.cluster_dbscan(df, "id", "x", "y", eps, least, by=["g"]).collect()}
        assert got == {k: number[pts[k][1], want[k]] if k in want else None for k in near}


def test_dbscan_of_crowded_cells(con):
    """No pairs of rows: copies of two places, and two crowds of different places that only their nearest places link, or don't."""
    rows = "SELECT id, CAST(id % 2 AS DOUBLE) AS x, 0D AS y FROM range(200000)"
    got = spatial.cluster_dbscan(con.spark.sql(rows), "id", "x", "y", 1.0, 100001).groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [(0, 200000)]
    for gap, clusters in ((1.0, 1), (1.001, 2)):
        rows = f"SELECT id, CAST(id DIV 2 AS DOUBLE) / 1e6 * if(id % 2 = 0, -1, 1) + if(id % 2 = 0, 0, {gap}D) AS x, 0D AS y FROM range(200000)"
        got = spatial.cluster_dbscan(con.spark.sql(rows), "id", "x", "y", 1.0, 5).groupBy("cluster").count().collect()
        assert sorted(map(tuple, got)) == [(c, 200000 // clusters) for c in range(clusters)]


def test_kmeans_of_repeated_points(con):
    """Thousands of copies of a few places: still k clusters, one a place, over the whole input and in every partition."""
    df = con.spark.sql("SELECT id, id % 2 AS half, CAST(if(id < 24000, 0, id % 4) * 10 AS DOUBLE) AS x, CAST(if(id < 24000, 0, id % 4) AS DOUBLE) AS y FROM range(24400)")
    got = {(r.x, r.cluster) for r in spatial.cluster_kmeans(df, "x", "y", 4).select("x", "cluster").distinct().collect()}
    assert len(got) == 4 and {x for x, _ in got} == {0, 10, 20, 30} and {c for _, c in got} == {0, 1, 2, 3}
    df.createOrReplaceTempView("copies")
    for over, k in (("", 4), ("PARTITION BY half", 3)):
        rows = con.sql(f"SELECT DISTINCT {'half' if over else '0'} AS h, x, c FROM (SELECT half, x, ST_ClusterKMeans(ST_Point(x, y), {k}) OVER ({over}) AS c FROM copies)").fetchall()
        # x = 0 stands in both halves: its places are 0 and 20 for even ids, 0, 10 and 30 for odd ones
        assert len(rows) == len({(h, c) for h, _, c in rows}) == (5 if over else 4)
    few = spatial.cluster_kmeans(df.filter("x IN (0, 10)"), "x", "y", 4)
    assert few.select("cluster").distinct().count() == 2


def test_joins_cover_all_rows(con):
    """The as-of and the spatial query against brute force over every row of a small fixture."""
    from pelagia import queries

    spark, rng = con.spark, np.random.default_rng(1)
    events = [(i, int(u), ("click", "view", "error")[t], int(s)) for i, (u, t, s) in enumerate(zip(rng.integers(0, 4, 90), rng.integers(0, 3, 90), rng.integers(0, 40, 90)))]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, s long").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(s) AS ts").createOrReplaceTempView("events")
    spark.range(1, 61).withColumnRenamed("id", "c_custkey").createOrReplaceTempView("customer")
    queries._shown.clear()  # other tests get the tables of their folder again
    want = set()
    for i, u, kind, s in events:
        if kind == "click":
            seen = [(t, j) for j, v, other, t in events if v == u and other != "click" and t <= s]
            want.add((i, max(seen)[1] if seen else None))
    assert {tuple(r) for r in queries.join_asof(con, "").collect()} == want
    at = {k: (k * 37 % 360 - 180, k * 17 % 180 - 90) for k in range(1, 61)}
    near = sorted((a, b) for a in at for b in at if (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 36)
    assert sorted(map(tuple, queries.join_spatial_grid(con, "").collect())) == near and len({b for _, b in near}) == 60


def test_grid_join_is_whole_and_even(con):
    """Neighbours whose quotients round to cells two apart are found; the pairs of one place's copies are dealt over the tasks."""
    from pyspark.sql import functions as F

    from pelagia.operators import joins

    a, b = -1e-18, 0.1
    assert (a - b) * (a - b) <= 0.1 * 0.1
    left = con.spark.createDataFrame([(1, a, 0.0), (2, None, 0.0), (3, math.nan, 0.0), (4, math.inf, 0.0)], "k long, x double, y double")
    right = con.spark.createDataFrame([(5, b, 0.0), (6, math.nan, 0.0), (7, 0.0, None)], "o long, u double, v double")
    assert [(r.k, r.o) for r in joins.grid_join(left, right, "x", "y", "u", "v", 0.1).collect()] == [(1, 5)]
    copies = con.spark.sql("SELECT id AS k, 0.5D AS x, 0.5D AS y FROM range(3000)")
    got = joins.grid_join(copies, copies.selectExpr("k AS o", "x AS u", "y AS v"), "x", "y", "u", "v", 1.0)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 * 3000 and max(sizes) < 0.4 * sum(sizes)
    assert got.select("k", "o").distinct().count() == 3000 * 3000
    rows = con.spark.sql("SELECT 1 AS k, 0.5D AS x, 0.5D AS y FROM range(2500)")  # equal rows share a hash
    assert joins.grid_join(rows, rows.selectExpr("k AS o", "x AS u", "y AS v"), "x", "y", "u", "v", 0.0).count() == 2500 * 2500


def test_projection_and_sort_keep_all_rows(spark, sf):
    from pelagia import queries

    q = queries.queries()
    assert q["scan_project_expr"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    rows = [(r.c_mktsegment, r.c_custkey) for r in q["order_multi"](spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/customer.parquet").count() and rows == sorted(rows, key=lambda r: (r[0], -r[1]))


def test_depth_and_vocabularies(spark):
    from pyspark.sql import functions as F

    from pelagia.functions.util import pressure_to_depth

    row = spark.range(1).select(pressure_to_depth(F.lit(1000.0), F.lit(4.0)).alias("a"), pressure_to_depth(F.lit(10.0), F.lit(4.0)).alias("b")).first()
    assert abs(row.a - 992.0919060719987) < 1e-6 and abs(row.b - 9.9445834469453) < 1e-6
    v = vocab.Vocabulary.of(spark, {"a": "1"})
    assert [r[0] for r in spark.sql("SELECT * FROM VALUES ('a'), ('b') AS t(c)").select(v.map(F.col("c"))).collect()] == ["1", None]
    df = spark.sql("SELECT 'x (12) y (34)' AS s, 'SDN:P35::A = SDN:P01::B, SDN:P35::C = SDN:P01::D' AS p")
    got = df.select(vocab.map_originator_edmo(F.col("s")), vocab.map_p35_contributor_codes_p01(F.col("p"), F.lit("SDN:P35::C"))).first()
    assert tuple(got) == (34, "SDN:P01::D")


def test_file_statistics(con, tmp_path):
    con.spark.range(100).repartitionByRange(4, "id").write.parquet(str(tmp_path / "d"))
    assert con.sql("ANALYZE FILES 'd'").fetchone()[:3] == (4, 0, 4)
    assert con.sql("ANALYZE FILES 'd'").fetchone()[2] == 0
    from pelagia import stats
    from pelagia.sources.readers import expand

    files = expand(con.spark, str(tmp_path / "d" / "*.parquet"))
    assert len(stats.prune(con, files, {"id": (10, 12)})) == 1
    assert stats.read_pruned(con, "d/*.parquet", {"id": (10, 12)}).count() == 3
    assert con.sql("SELECT count(*) FROM file_statistics('d/*.parquet')").fetchone() == (4,)
    assert con.sql("SELECT max(max) FROM view_dataset_statistics('d')").fetchone() == ("99",)
    assert os.path.isdir(f"{con.root}/file_stats")


def test_domain_functions_in_sql(con):
    from pelagia.functions.scalar import load_vocabulary

    one = lambda e: con.sql(f"SELECT {e} AS x").fetchone()[0]
    assert abs(one("pressure_to_depth_teos_10(1000, 4)") - 992.0919060719987) < 1e-6
    assert one("map_units('SDN:P06::UMLL', 'SDN:P06::UPOX', 2)") == 2 * 44.66080 and one("map_units('a', 'a', 2)") is None
    assert one("map_cmems_bigram_l06('CT', '995')") == "SDN:L06::70" and one("map_cmems_bigram_l06('CT', NULL)") == "SDN:L06::30" and one("map_cmems_bigram_l05('XB')") == "SDN:L05::132"
    assert one("map_seadatanet_instrument_l05('ctd (130) x (2)')") == "SDN:L05::130" and one("map_seadatanet_instrument_l05('ctd')") is None
    assert one("map_originator_edmo('a (12) b (34)')") == 34 and one("map_emodnet_chemistry_instrument_l05_multi('(1) (2)')") == "SDN:L05::1 SDN:L05::2"
    assert one("map_emodnet_chemistry_instrument_info_l22('x SDN:P01::A y SDN:L22::Q|SDN:P01::B SDN:L22::R', 'SDN:P01::B')") == "SDN:L22::R"
    assert one("map_emodnet_chemistry_p35_contributor_codes_p01('SDN:P35::A = SDN:P01::B, SDN:P35::C = SDN:P01::D', 'SDN:P35::A')") == "SDN:P01::B"
    assert one("map_c17('35')") is None
    load_vocabulary(con.spark, "map_c17", {"35": "it's"})
    assert one("map_c17('35')") == "it's" and one("map_c17('36')") is None
    assert one("coalesce_label(1, 'a', CAST(NULL AS INT), 'b', 2, 'c')") == "c"
    with pytest.raises(ValueError, match="coalesce_label"):
        con.sql("SELECT coalesce_label(1, 2)")


def test_spatial_aggregates_in_sql(con):
    con.spark.sql("SELECT id AS g, concat('POINT (', id, ' ', id * 2, ')') AS geom FROM range(3)").createOrReplaceTempView("pts")
    assert con.sql("SELECT ST_Extent(geom) AS e FROM pts").fetchone()[0].asDict() == {"xmin": 0, "ymin": 0, "xmax": 2, "ymax": 4}
    assert con.sql("SELECT ST_NumGeometries(ST_Collect(geom)) AS n FROM pts").fetchone() == (3,)
    assert con.sql("SELECT round(ST_Area(ST_MemUnion(ST_Envelope(ST_Buffer(geom, 0.5)))), 6) AS a FROM pts").fetchone() == (3,)


def test_system_tables(con):
    con.sql("CREATE TABLE t (id BIGINT, name VARCHAR)")
    assert con.sql("SELECT table_name, table_type FROM information_schema.tables").fetchall() == [("t", "BASE TABLE")]
    assert con.sql("SELECT column_name, data_type FROM information_schema.columns ORDER BY ordinal_position").fetchall() == [("id", "Int64"), ("name", "Utf8")]
    assert con.sql("SELECT count(*) > 0 FROM system.query_metrics").fetchone() == (True,)
