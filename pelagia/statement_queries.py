"""Queries over statements, sources and system tables: functions of (connection, folder) and what an independent engine says."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fresh(con, *names: str) -> None:
    for n in names:
        con.sql(f"DROP TABLE IF EXISTS {n}")


def alter_table(con, sf: str) -> DataFrame:
    _fresh(con, "altered")
    con.sql("CREATE TABLE altered AS SELECT n_nationkey, n_name, n_regionkey FROM nation")
    con.sql("ALTER TABLE altered ADD COLUMN extra DOUBLE")
    con.sql("UPDATE altered SET extra = n_nationkey / 2.0 WHERE n_regionkey = 1")
    con.sql("ALTER TABLE altered DROP COLUMN n_regionkey")
    con.sql("ALTER TABLE altered ALTER COLUMN n_nationkey TYPE BIGINT")
    return con.sql("SELECT n_nationkey, n_name, extra FROM altered").df


def delete_null_condition(con, sf: str) -> DataFrame:
    """Rows whose condition is null stay."""
    _fresh(con, "kept_rows")
    con.sql("CREATE TABLE kept_rows AS SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer")
    con.sql("DELETE FROM kept_rows WHERE k > 10")
    return con.sql("SELECT c_custkey, k FROM kept_rows").df


def create_columns_insert(con, sf: str) -> DataFrame:
    _fresh(con, "typed")
    con.sql("CREATE TABLE typed (id BIGINT, name VARCHAR, v DOUBLE)")
    con.sql("CREATE TABLE IF NOT EXISTS typed (other INT)")
    con.sql("INSERT INTO typed VALUES (1, 'a', 0.5), (2, NULL, 1.5)")
    con.sql("INSERT INTO typed SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey >= 20")
    return con.sql("SELECT id, name, v FROM typed").df


def views(con, sf: str) -> DataFrame:
    con.sql("CREATE OR REPLACE VIEW european AS SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 3")
    con.sql("CREATE OR REPLACE VIEW european AS SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 3")
    return con.sql("SELECT n_name, n_nationkey * 2 AS k FROM european WHERE n_nationkey > 5").df


def index_statements(con, sf: str) -> DataFrame:
    _fresh(con, "indexed")
    con.sql("CREATE TABLE indexed AS SELECT o_orderkey, o_custkey FROM orders")
    con.sql("CREATE INDEX by_key ON indexed (o_orderkey) USING BTREE")
    con.sql("CREATE INDEX by_cust ON indexed (o_custkey) USING BITMAP")
    con.sql("DROP INDEX by_cust ON indexed")
    return con.sql("SHOW INDEXES ON indexed").df.select("index_name", "type", F.array_join("columns", ",").alias("columns")).crossJoin(con.sql("SELECT sum(o_orderkey) AS s FROM indexed WHERE o_orderkey < 500").df)


def copy_to(con, sf: str) -> DataFrame:
    con.sql(f"COPY (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2) TO '{con.root}/copied.parquet' STORED AS PARQUET")
    return con.sql(f"SELECT n_nationkey, n_name FROM read_parquet('{con.root}/copied.parquet')").df


def describe_and_columns(con, sf: str) -> DataFrame:
    con.sql(f"CREATE OR REPLACE EXTERNAL TABLE region_files STORED AS PARQUET LOCATION '{sf}/region.parquet'")
    a = con.sql("DESCRIBE region_files").df.select(F.lit("describe").alias("via"), "column_name", "data_type")
    b = con.sql("SHOW COLUMNS FROM region_files").df.select(F.lit("show").alias("via"), "column_name", "data_type")
    c = con.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'region_files'").df
    return a.unionByName(b).unionByName(c.select(F.lit("schema").alias("via"), "column_name", "data_type"))


def show_tables(con, sf: str) -> DataFrame:
    _fresh(con, "shown_a", "shown_b")
    con.sql("CREATE TABLE shown_a AS SELECT 1 AS x")
    con.sql("CREATE OR REPLACE VIEW shown_b AS SELECT 2 AS x")
    a = con.sql("SHOW TABLES").df.filter("table_name LIKE 'shown%'").select("table_name", "table_type")
    b = con.sql("SELECT table_name, table_type FROM information_schema.tables WHERE table_name LIKE 'shown%'").df
    return a.unionByName(b)


def users_and_roles(con, sf: str) -> DataFrame:
    from pelagia.session import Connection

    own = Connection(con.spark, f"{con.root}/access-{uuid.uuid4().hex}")
    own.sql("CREATE USER ann PASSWORD 'secret'")
    own.sql("CREATE ROLE reader")
    own.sql("GRANT SELECT ON TABLE a TO ROLE reader")
    own.sql("GRANT ROLE reader TO ann")
    u = own.sql("SHOW USERS").df.filter("user_name = 'ann'").select(F.col("user_name").alias("name"), F.array_join("roles", ",").alias("of"))
    r = own.sql("SELECT role_name, rules FROM system.roles WHERE role_name = 'reader'").df
    return u.unionByName(r.select(F.col("role_name").alias("name"), F.size("rules").cast("string").alias("of")))


def set_statement(con, sf: str) -> DataFrame:
    con.sql("SET pelagia.example = '7'")
    return con.spark.sql(f"SELECT '{con.spark.conf.get('pelagia.example')}' AS v")


def explain_statement(con, sf: str) -> DataFrame:
    plan = con.sql("EXPLAIN SELECT count(*) FROM nation WHERE n_regionkey = 1").df
    measured = con.sql("EXPLAIN ANALYZE SELECT * FROM nation WHERE n_regionkey = 1").df
    return plan.select("plan_type", F.col("plan").contains("n_regionkey").alias("told")).unionByName(measured.select("plan_type", F.col("plan").contains("rows: 5").alias("told")))


def dataset_statistics(con, sf: str) -> DataFrame:
    return con.sql(f"SELECT column_name, min, max FROM view_dataset_statistics('{sf}/nation.parquet')").df


def stored_statistics(con, sf: str) -> DataFrame:
    d = f"{con.root}/statistics"
    con.spark.table("orders").select("o_orderkey", "o_orderstatus").repartitionByRange(3, "o_orderkey").write.mode("overwrite").parquet(d)
    con.sql(f"ANALYZE FILES '{d}' FORCE")
    a = con.sql(f"SELECT column, min(CAST(min AS VARCHAR)) AS lo, sum(row_count) AS n FROM file_statistics('{d}/*.parquet') WHERE column = 'o_orderstatus' GROUP BY column").df
    b = con.sql("SELECT column_name AS column, min(min) AS lo, count(*) AS n FROM view_statistics_cache() WHERE path LIKE '%/statistics/%' AND column_name = 'o_orderkey' GROUP BY column_name").df
    return a.unionByName(b.select("column", F.lit("-").alias("lo"), "n"))


def sql_file_pruning(con, sf: str) -> DataFrame:
    """SQL over analysed files: the scan opens only files whose ranges meet the WHERE clause."""
    d = f"{con.root}/pruned_sql"
    con.spark.table("orders").repartitionByRange(6, "o_orderkey").write.mode("overwrite").parquet(d)
    con.sql(f"ANALYZE FILES '{d}'")
    con.sql(f"CREATE OR REPLACE EXTERNAL TABLE pruned_orders STORED AS PARQUET LOCATION '{d}'")
    text = "SELECT o_orderkey, o_custkey FROM {} WHERE o_orderkey BETWEEN 100 AND 500 AND o_custkey > 3"
    both = [con.sql(text.format(t)).df for t in (f"read_parquet('{d}/*.parquet')", "pruned_orders")]
    fewer = [F.lit(len(df.inputFiles()) < 6) for df in both]
    return both[0].withColumn("fewer_files", fewer[0]).unionByName(both[1].withColumn("fewer_files", fewer[1]))


def list_datasets(con, sf: str) -> DataFrame:
    from pelagia.session import Connection

    return Connection(con.spark, con.root, datasets=sf).sql("SELECT file_path, file_format FROM list_datasets('*n.parquet')").df


def registered_objects(con, sf: str) -> DataFrame:
    import pyarrow as pa

    con.register("given", pa.table({"k": [0, 1, 2], "w": ["x", "y", "z"]}).to_pandas())
    return con.sql("SELECT n.n_name, g.w FROM nation n JOIN given g ON n.n_regionkey = g.k UNION ALL SELECT v, 'v' FROM (VALUES ('a'), ('b')) t(v)").df


def dsl_from_files(con, sf: str) -> DataFrame:
    a = con.json_query({"select": ["n_nationkey"], "from": {"parquet": {"paths": [f"{sf}/nation.parquet"]}}, "filter": {"column": "n_nationkey", "lt": 5}}).df
    con.sql("SELECT r_regionkey AS n_nationkey FROM region").to_csv(f"{con.root}/dsl_csv")
    b = con.json_query({"select": ["n_nationkey"], "from": {"csv": {"paths": [f"{con.root}/dsl_csv/*.csv"]}}}).df
    return a.select(F.col("n_nationkey").cast("int")).unionByName(b.select(F.col("n_nationkey").cast("int")))


def cross_format_join(con, sf: str) -> DataFrame:
    con.sql("SELECT r_regionkey, r_name FROM region").to_ipc(f"{con.root}/regions.arrow")
    return con.sql(f"SELECT n.n_name, r.r_name FROM read_parquet('{sf}/nation.parquet') n JOIN read_arrow('{con.root}/regions.arrow') r ON n.n_regionkey = r.r_regionkey").df


def delta_versions(con, sf: str) -> DataFrame:
    """A Delta table of two commits, read at both."""
    d = f"{con.root}/versions"
    os.makedirs(f"{d}/_delta_log", exist_ok=True)
    meta = {"metaData": {"id": "x", "schemaString": con.spark.table("region").schema.json(), "partitionColumns": [], "format": {"provider": "parquet"}}}
    for k in range(2):
        con.spark.table("region").filter(f"r_regionkey % 2 = {k}").coalesce(1).write.mode("overwrite").parquet(f"{d}/p{k}")
        name = next(f"p{k}/{f}" for f in sorted(os.listdir(f"{d}/p{k}")) if f.endswith(".parquet"))
        with open(f"{d}/_delta_log/{k:020d}.json", "w") as f:
            f.write("\n".join(json.dumps(x) for x in [*[meta] * (k == 0), {"add": {"path": name, "partitionValues": {}}}]))
    first = con.sql(f"SELECT r_regionkey, r_name FROM read_delta('{d}', 0)").df.withColumn("version", F.lit(0))
    return first.unionByName(con.sql(f"SELECT r_regionkey, r_name FROM read_delta('{d}')").df.withColumn("version", F.lit(1)))


def zarr_grid(con, sf: str) -> DataFrame:
    """A region x nation grid in a Zarr v3 group of two chunks along the nations."""
    d = f"{con.root}/grid.zarr"
    for name, dims, shape, chunk, values in (
        ("region", ["region"], [5], [5], np.arange(5, dtype="<f8")),
        ("v", ["region", "nation"], [5, 25], [5, 13], np.arange(125, dtype="<f8").reshape(5, 25)),
    ):
        os.makedirs(f"{d}/{name}/c", exist_ok=True)
        meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], "attributes": {}, "dimension_names": dims}
        with open(f"{d}/{name}/zarr.json", "w") as f:
            json.dump(meta, f)
        for at in np.ndindex(*[-(-s // c) for s, c in zip(shape, chunk)]):
            part = np.zeros(chunk)
            piece = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk))]
            part[tuple(slice(0, n) for n in piece.shape)] = piece
            with open(f"{d}/{name}/c.{'.'.join(map(str, at))}", "wb") as f:
                f.write(zlib.compress(part.astype("<f8").tobytes(), wbits=31))
    with open(f"{d}/zarr.json", "w") as f:
        json.dump({"zarr_format": 3, "node_type": "group", "attributes": {}}, f)
    return con.sql(f"SELECT region, v FROM read_zarr('{d}/zarr.json')").df


def tiff_pixels(con, sf: str) -> DataFrame:
    """An image of 5 x 5 pixels in one uncompressed strip."""
    raw = np.arange(25, dtype="<u2").tobytes()
    tags = [(256, 3, 5), (257, 3, 5), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 5), (279, 4, len(raw))]
    body = b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    with open(f"{con.root}/pixels.tif", "wb") as f:
        f.write(body)
    return con.sql(f"SELECT CAST(\"band.0\" AS INT) AS v, CAST(\"image.width\" AS INT) AS w FROM read_tiff('{con.root}/pixels.tif')").df


def flat_netcdf(con, sf: str) -> DataFrame:
    con.sql("SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) AS r FROM nation").to_netcdf(f"{con.root}/flat.nc")
    return con.sql(f"SELECT n_nationkey, r FROM read_netcdf('{con.root}/flat.nc')").df


def call_signs(con, sf: str) -> DataFrame:
    from pelagia.functions import vocab

    records = con.spark.sql("SELECT CAST(n_regionkey AS STRING) AS call_sign, n_nationkey * 10.0D AS commissioned, CASE WHEN n_nationkey < 20 THEN n_nationkey * 10.0D + 60 END AS decommissioned, n_nationkey AS ordinal, n_name AS c17 FROM nation")
    points = con.spark.sql("SELECT c_custkey, CAST(c_nationkey % 5 AS STRING) AS cs, CAST(c_custkey % 300 AS DOUBLE) AS at FROM customer")
    return vocab.map_call_sign_c17(points, "cs", "at", records, bucket=50.0).select("c_custkey", "c17")


def loaded_codes(con, sf: str) -> DataFrame:
    from pelagia.functions.scalar import load_vocabulary

    load_vocabulary(con.spark, "map_wod_instrument_l05", {str(k): f"SDN:L05::{k}" for k in range(10)})
    load_vocabulary(con.spark, "map_wod_edmo", {str(k): str(100 + k) for k in range(10)})
    return con.sql("SELECT n_nationkey, map_wod_instrument_l05(CAST(n_nationkey AS VARCHAR)) AS l05, map_wod_edmo(CAST(n_nationkey AS VARCHAR)) AS edmo, map_c17('nowhere') AS c17 FROM nation").df


def session_windows(con, sf: str) -> DataFrame:
    from pelagia.streaming.windows import session_counts

    return session_counts(con.spark.table("events"), "user_id", "30 minutes").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def sliding_windows(con, sf: str) -> DataFrame:
    from pelagia.streaming.windows import windowed

    return windowed(con.spark.table("events"), "2 hours", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_EVENT_GAPS = "SELECT user_id, ts, sum(CASE WHEN ts >= last + INTERVAL 30 MINUTE OR last IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)"

BUILT = {
    "alter_table": (alter_table, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN n_nationkey / 2 END AS extra FROM nation"),
    "delete_null_condition": (delete_null_condition, "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer WHERE c_nationkey <= 10"),
    "create_columns_insert": (create_columns_insert, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS v FROM nation WHERE n_nationkey >= 20 UNION ALL VALUES (1, 'a', 0.5), (2, NULL, 1.5)"),
    "views": (views, "SELECT n_name, n_nationkey * 2 AS k FROM nation WHERE n_regionkey = 3 AND n_nationkey > 5"),
    "index_statements": (index_statements, "SELECT 'by_key' AS index_name, 'btree' AS type, 'o_orderkey' AS columns, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 500"),
    "copy_to": (copy_to, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2"),
    "describe_and_columns": (describe_and_columns, "SELECT via, c AS column_name, t AS data_type FROM (VALUES ('describe'), ('show'), ('schema')) v(via), (VALUES ('r_regionkey', 'Int32'), ('r_name', 'Utf8')) x(c, t)"),
    "show_tables": (show_tables, "SELECT * FROM (VALUES ('shown_a', 'managed'), ('shown_b', 'view'), ('shown_a', 'BASE TABLE'), ('shown_b', 'VIEW')) t(table_name, table_type)"),
    "users_and_roles": (users_and_roles, "SELECT * FROM (VALUES ('ann', 'reader'), ('reader', '1')) t(name, of)"),
    "set_statement": (set_statement, "SELECT '7' AS v"),
    "explain_statement": (explain_statement, "SELECT * FROM (VALUES ('logical_plan', true), ('physical_plan', true), ('Plan with Metrics', true)) t(plan_type, told)"),
    "dataset_statistics": (dataset_statistics, "SELECT 'n_nationkey' AS column_name, CAST(min(n_nationkey) AS VARCHAR) AS min, CAST(max(n_nationkey) AS VARCHAR) AS max FROM nation UNION ALL SELECT 'n_name', min(n_name), max(n_name) FROM nation UNION ALL SELECT 'n_regionkey', CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation"),
    "stored_statistics": (stored_statistics, "SELECT 'o_orderstatus' AS column, min(o_orderstatus) AS lo, count(*) AS n FROM orders UNION ALL SELECT 'o_orderkey', '-', 3"),
    "sql_file_pruning": (sql_file_pruning, "SELECT o_orderkey, o_custkey, true AS fewer_files FROM orders, range(2) WHERE o_orderkey BETWEEN 100 AND 500 AND o_custkey > 3"),
    "list_datasets": (list_datasets, "SELECT n || '.parquet' AS file_path, 'parquet' AS file_format FROM (VALUES ('nation'), ('region')) t(n)"),
    "registered_objects": (registered_objects, "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS w FROM nation WHERE n_regionkey < 3 UNION ALL VALUES ('a', 'v'), ('b', 'v')"),
    "dsl_from_files": (dsl_from_files, "SELECT n_nationkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_regionkey FROM region"),
    "cross_format_join": (cross_format_join, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "delta_versions": (delta_versions, "SELECT r_regionkey, r_name, 0 AS version FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, r_name, 1 FROM region"),
    "zarr_grid": (zarr_grid, "SELECT CAST(r AS DOUBLE) AS region, CAST(r * 25 + n AS DOUBLE) AS v FROM range(5) a(r), range(25) b(n)"),
    "tiff_pixels": (tiff_pixels, "SELECT CAST(v AS INTEGER) AS v, 5 AS w FROM range(25) t(v)"),
    "flat_netcdf": (flat_netcdf, "SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) AS r FROM nation"),
    "fn_call_signs": (call_signs, "SELECT c_custkey, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_regionkey = c_nationkey % 5 AND n_nationkey * 10 <= c_custkey % 300 AND (n_nationkey >= 20 OR c_custkey % 300 < n_nationkey * 10 + 60)) AS c17 FROM customer"),
    "fn_loaded_codes": (loaded_codes, "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 'SDN:L05::' || n_nationkey END AS l05, CASE WHEN n_nationkey < 10 THEN CAST(100 + n_nationkey AS BIGINT) END AS edmo, CAST(NULL AS VARCHAR) AS c17 FROM nation"),
    "session_windows": (session_windows, f"SELECT min(ts) AS start, user_id, count(*) AS n FROM ({_EVENT_GAPS}) GROUP BY user_id, s"),
    "sliding_windows": (sliding_windows, "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, (date_trunc('hour', ts) - INTERVAL 1 HOUR)::TIMESTAMP]) AS start, event_type FROM events) GROUP BY 1, 2"),
}
