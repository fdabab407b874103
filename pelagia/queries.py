"""Queries over the benchmark tables, one for each operator family, with the SQL an independent engine runs.

SAME: the dialect text runs on both. PAIRS: dialect text and the other engine's text. BUILT: functions of
(connection, folder) and the other engine's text (None where SQL cannot say it).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia import function_queries, statement_queries
from pelagia.functions import spatial, util, vocab
from pelagia.operators import joins, sets
from pelagia.session import Connection

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

LON, LAT = "(CAST((c_custkey * 37) % 360 AS DOUBLE) - 180.0)", "(CAST((c_custkey * 17) % 180 AS DOUBLE) - 90.0)"

SAME = {
    # scans, projections, predicates
    "scan_count_all": "SELECT count(*) AS n FROM lineitem",
    "scan_project_expr": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2, l_quantity + l_linenumber AS s FROM lineitem",
    "filter_compare": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05 AND l_returnflag <> 'R'",
    "filter_multi": "SELECT count(*) AS n, sum(l_extendedprice) AS s FROM lineitem WHERE l_quantity > 40 AND l_discount BETWEEN 0.02 AND 0.04 AND l_returnflag = 'N'",
    "spatial_box": f"SELECT count(*) AS n FROM (SELECT c_custkey FROM customer WHERE {LON} BETWEEN -20 AND 60 AND {LAT} BETWEEN -20 AND 50) sub",
    "filter_between": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900",
    "filter_in": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 3)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE 'a%'",
    "filter_null": "SELECT count(*) AS n, count(props) AS p FROM events WHERE props IS NOT NULL OR value IS NULL",
    "filter_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), '-') AS st FROM orders",
    "filter_in_subquery": "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)",
    "filter_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "filter_scalar_subquery": "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)",
    "time_window": "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00'",
    "select_exclude": "SELECT * EXCLUDE (n_name) FROM nation",
    "trailing_comma": "SELECT n_nationkey, n_name, FROM nation",
    "quoted_identifier": 'SELECT "n_name" AS "name" FROM "nation"',
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
    "join_right": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_custkey = s.s_suppkey * 7",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_using": "SELECT o_orderkey, l_quantity FROM (SELECT o_orderkey, o_orderkey AS k FROM orders) JOIN (SELECT l_orderkey AS k, l_quantity FROM lineitem) USING (k)",
    "join_natural": "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier)",
    "join_multi_key": "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "join_anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "join_lateral": "SELECT r_name, t.n FROM region r, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r.r_regionkey) t",
    "join_five_tables": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    # aggregation
    "agg_by_platform": "SELECT l_returnflag, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 4) AS p, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_group_all": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_returnflag) AS f FROM lineitem",
    "distinct_platform": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
    "agg_filter": "SELECT count(*) FILTER (WHERE l_quantity > 30) AS big, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "agg_stats": "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 5) AS va, median(l_quantity) AS me FROM lineitem GROUP BY l_returnflag",
    # windows
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders",
    "win_rank_family": "SELECT c_custkey, rank() OVER (ORDER BY c_nationkey) AS r, dense_rank() OVER (ORDER BY c_nationkey) AS d, round(percent_rank() OVER (ORDER BY c_nationkey), 8) AS p, round(cume_dist() OVER (ORDER BY c_nationkey), 8) AS c FROM customer",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_ntile": "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_suppkey) AS t FROM supplier",
    "win_rows_frame": "SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS s FROM orders",
    "win_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "win_groups_frame": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM lineitem",
    "win_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    # order, limit, sets
    "topn_recent": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 1000",
    "order_multi": "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_custkey DESC",
    "limit_offset": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20 OFFSET 30",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_by_name": "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL BY NAME SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS k, 1 AS extra FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    # scalar functions
    "fn_math": "SELECT p_partkey, round(sqrt(p_size), 8) AS a, round(cbrt(p_size), 8) AS b, round(ln(p_size), 8) AS c, floor(p_retailprice) AS d, ceil(p_retailprice) AS e, abs(p_size - 25) AS f, round(power(p_size, 2), 4) AS g, round(sin(p_size), 8) AS h, round(atan2(p_size, 3), 8) AS i, round(degrees(p_size), 6) AS j, round(exp(p_size / 100.0), 6) AS k, round(log10(p_size), 8) AS l, round(log2(p_size), 8) AS m, sign(p_size - 25) AS n FROM part",
    "fn_string": "SELECT p_partkey, upper(p_name) AS a, length(p_name) AS b, substr(p_name, 2, 3) AS c, replace(p_name, 'a', 'X') AS d, reverse(p_brand) AS e, lpad(p_brand, 12, '*') AS f, rpad(p_brand, 12, '-') AS g, split_part(p_name, ' ', 1) AS h, left(p_name, 4) AS i, right(p_name, 3) AS j, trim(p_type) AS k, translate(p_type, 'AE', 'ae') AS m, ascii(p_name) AS n, repeat(p_brand, 2) AS o, starts_with(p_name, 'a') AS p, concat(p_brand, NULL, p_name) AS q, concat_ws('-', p_brand, p_type) AS r, strpos(p_name, 'e') AS s, contains(p_name, 'e') AS t FROM part",
    "fn_conditional": "SELECT c_custkey, coalesce(NULL, c_name) AS a, nullif(c_nationkey, 3) AS b, greatest(c_nationkey, 5) AS c, least(c_nationkey, 5) AS d, ifnull(NULL, 'x') AS e FROM customer",
    "fn_cast_try": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_size::VARCHAR AS b, TRY_CAST(p_name AS INTEGER) AS c FROM part",
    "fn_gcd_lcm": "SELECT p_partkey, gcd(p_partkey, CAST(p_size AS BIGINT)) AS g, lcm(p_partkey, CAST(p_size AS BIGINT)) AS l FROM part",
    "fn_date_trunc": "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(date_part('year', o_orderdate) AS INTEGER) AS y, CAST(extract(DAY FROM o_orderdate) AS INTEGER) AS d FROM orders",
}

PAIRS = {
    "star_replace": ("SELECT * REPLACE (upper(n_name) AS n_name) FROM nation", "SELECT n_nationkey, n_regionkey, upper(n_name) AS n_name FROM nation"),
    "list_literal": ("SELECT n_nationkey, [n_nationkey, n_regionkey][1] AS second FROM nation", "SELECT n_nationkey, n_regionkey AS second FROM nation"),
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "fn_regex": (
        "SELECT p_partkey, regexp_like(p_name, '^[a-m]') AS a, regexp_replace(p_name, '[aeiou]', '_') AS b, regexp_replace(p_name, '[aeiou]', '_', 'g') AS c, regexp_count(p_name, 'e') AS d FROM part",
        "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS a, regexp_replace(p_name, '[aeiou]', '_') AS b, regexp_replace(p_name, '[aeiou]', '_', 'g') AS c, CAST(len(regexp_extract_all(p_name, 'e')) AS INTEGER) AS d FROM part",
    ),
    "fn_date_bin": (
        "SELECT date_bin(INTERVAL '15' MINUTE, ts, TIMESTAMP '2020-01-01 00:00:00') AS bin, count(*) AS n FROM events GROUP BY 1",
        "SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2020-01-01 00:00:00') AS bin, count(*) AS n FROM events GROUP BY 1",
    ),
    "fn_to_char": ("SELECT o_orderkey, to_char(o_orderdate, '%Y-%m-%d') AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"),
    "fn_numbers": (
        "SELECT p_partkey, trunc(p_retailprice, 1) AS t, iszero(p_size - 1) AS z, to_hex(p_partkey) AS h, factorial(p_size % 10) AS f, log(2, p_size) > 3 AS l FROM part",
        "SELECT p_partkey, sign(p_retailprice) * floor(abs(p_retailprice) * 10) / 10 AS t, p_size = 1 AS z, lower(to_hex(p_partkey)) AS h, CAST(factorial(p_size % 10) AS BIGINT) AS f, log2(p_size) > 3 AS l FROM part",
    ),
    "fn_encode": ("SELECT n_nationkey, encode(n_name, 'hex') AS h, decode(encode(n_name, 'base64'), 'base64') AS b, md5(n_name) AS m, sha2(n_name, 256) AS s FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, n_name AS b, md5(n_name) AS m, sha256(n_name) AS s FROM nation"),
    "fn_timestamps": (
        "SELECT event_id, to_unixtime(ts) AS u, to_timestamp_seconds(event_id) AS s, to_timestamp_millis(event_id) AS m, to_timestamp_nanos(event_id * 1000) AS n, make_date(2020, 1, CAST(event_id % 28 AS INT) + 1) AS d FROM events",
        "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS u, make_timestamp(event_id * 1000000) AS s, make_timestamp(event_id * 1000) AS m, make_timestamp(event_id) AS n, make_date(2020, 1, CAST(event_id % 28 AS INT) + 1) AS d FROM events",
    ),
    "fn_try_arrow_cast": ("SELECT p_partkey, try_arrow_cast(p_size, 'Float64') AS f, try_arrow_cast(p_name, 'Int32') AS i FROM part", "SELECT p_partkey, TRY_CAST(p_size AS DOUBLE) AS f, TRY_CAST(p_name AS INTEGER) AS i FROM part"),
    "agg_percentile": ("SELECT l_returnflag, approx_percentile_cont(l_quantity, 0.9) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p FROM lineitem GROUP BY l_returnflag"),
    "agg_arrays": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "unnest": ("SELECT n_nationkey, explode(sequence(0, n_regionkey)) AS x FROM nation", "SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INTEGER AS x FROM nation"),
    "fn_wod_quality_flag": ("SELECT p_partkey, map_wod_quality_flag(p_partkey % 11) AS q FROM part", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '1' WHEN p_partkey % 11 <= 5 THEN '3' WHEN p_partkey % 11 <= 9 THEN '4' END AS q FROM part"),
    "fn_cast_int8_as_char": ("SELECT p_partkey, cast_int8_as_char(CAST(33 + p_size AS TINYINT)) AS c FROM part", "SELECT p_partkey, chr(33 + p_size) AS c FROM part"),
    "fn_feature_type": ("SELECT p_partkey, map_measuring_area_type_feature_type(CASE p_partkey % 3 WHEN 0 THEN 'a curve' WHEN 1 THEN 'point x' ELSE p_name END) AS t FROM part", "SELECT p_partkey, CASE WHEN v LIKE '%curve%' THEN 'trajectory' WHEN v LIKE '%point%' THEN 'profile' END AS t FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a curve' WHEN 1 THEN 'point x' ELSE p_name END AS v FROM part)"),
    "fn_argo_constants": ("SELECT n_nationkey, map_argo_instrument_l05(n_name) AS i, map_argo_platform_l06(n_name) AS p FROM nation", "SELECT n_nationkey, 'SDN:L05::130' AS i, 'SDN:L06::46' AS p FROM nation"),
    "geo_sql_point": (f"SELECT c_custkey, st_x(st_point({LON}, {LAT})) AS x, st_y(st_point({LON}, {LAT})) AS y, st_geometrytype(st_point({LON}, {LAT})) AS t FROM customer", f"SELECT c_custkey, {LON} AS x, {LAT} AS y, 'ST_Point' AS t FROM customer"),
    "geo_sql_intersects": (f"SELECT c_custkey FROM customer WHERE st_intersects(st_point({LON}, {LAT}), 'POLYGON ((-20 -20, 60 -20, 60 50, -20 50, -20 -20))')", f"SELECT c_custkey FROM customer WHERE {LON} BETWEEN -20 AND 60 AND {LAT} BETWEEN -20 AND 50"),
    "geo_sql_measures": (
        "SELECT n_nationkey, st_area(st_makeenvelope(0, 0, n_nationkey + 1, 2)) AS a, st_perimeter(st_makeenvelope(0, 0, n_nationkey + 1, 2)) AS p, st_distance(st_point(0, 0), st_point(3 * n_nationkey, 4 * n_nationkey)) AS d, st_npoints(st_makeenvelope(0, 0, n_nationkey + 1, 2)) AS n, st_x(st_centroid(st_makeenvelope(0, 0, n_nationkey + 1, 2))) AS c FROM nation",
        "SELECT n_nationkey, CAST((n_nationkey + 1) * 2 AS DOUBLE) AS a, CAST(2 * (n_nationkey + 3) AS DOUBLE) AS p, CAST(5 * n_nationkey AS DOUBLE) AS d, 5 AS n, (n_nationkey + 1) / 2 AS c FROM nation",
    ),
    "geo_sql_overlay": ("SELECT n_nationkey, st_area(st_intersection(st_makeenvelope(0, 0, 10, 10), st_makeenvelope(5, 5, 6 + n_nationkey, 15))) AS i, st_area(st_union(st_makeenvelope(0, 0, 10, 10), st_makeenvelope(5, 5, 6 + n_nationkey, 15))) AS u FROM nation", "SELECT n_nationkey, least(5, 1 + n_nationkey) * 5.0::DOUBLE AS i, 100.0::DOUBLE + (1 + n_nationkey) * 10.0::DOUBLE - least(5, 1 + n_nationkey) * 5.0::DOUBLE AS u FROM nation"),
    "geo_sql_cluster_window": (
        "SELECT n_nationkey, ST_ClusterDBSCAN(ST_Point(n_regionkey * 1000, n_nationkey), 500, 3) OVER () AS c FROM nation",
        "SELECT n_nationkey, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INTEGER) AS c FROM (SELECT n_nationkey, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS m FROM nation)",
    ),
    **function_queries.PAIRS,
    "geo_sql_text": ("SELECT n_nationkey, st_astext(st_geomfromtext('LINESTRING (0 0, 1 1)')) AS t, st_asgeojson(st_point(n_nationkey, 2)) AS j FROM nation", "SELECT n_nationkey, 'LINESTRING (0 0, 1 1)' AS t, '{\"type\":\"Point\",\"coordinates\":[' || n_nationkey || ',2]}' AS j FROM nation"),
}


def _coords(con: Connection) -> DataFrame:
    return con.spark.sql(f"SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer")


def dsl(**body) -> Callable[[Connection, str], DataFrame]:
    """A JSON query; `from_` stands for from."""
    body = {k.rstrip("_"): v for k, v in body.items()}
    return lambda con, sf: con.json_query(body).df


def read_parquet_sql(con: Connection, sf: str) -> DataFrame:
    return con.sql(f"SELECT l_returnflag, round(avg(l_quantity), 6) AS q, count(*) AS n FROM read_parquet('{sf}/lineitem.parquet') GROUP BY l_returnflag").df


def params_bind(con: Connection, sf: str) -> DataFrame:
    return con.sql("SELECT n_name FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2", [1, 3]).df


def coalesce_label(con: Connection, sf: str) -> DataFrame:
    df = con.spark.table("orders").withColumn("a", F.when(F.col("o_orderkey") % 2 == 0, 1)).withColumn("b", F.when(F.col("o_orderkey") % 3 == 0, 1))
    return df.select("o_orderkey", util.coalesce_label(("a", "A"), ("b", "B")).alias("label"))


def map_units(con: Connection, sf: str) -> DataFrame:
    p = con.spark.table("part")
    unit = F.element_at(F.array(*map(F.lit, ("SDN:P06::KGUM", "SDN:P06::UPOX", "SDN:P06::UMLL"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", F.round(util.map_units(unit, F.lit("SDN:P06::UPOX"), F.col("p_retailprice")), 6).alias("v"))


def pressure_to_depth(con: Connection, sf: str) -> DataFrame:
    return con.spark.table("part").select("p_partkey", F.round(util.pressure_to_depth(F.col("p_retailprice"), F.col("p_size").cast("double")), 6).alias("depth"))


def cmems_bigram(con: Connection, sf: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("BO", "CT", "XB", "GL", "ZZ"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    wmo = F.when(F.col("p_partkey") % 2 == 0, "995").otherwise("1")
    return con.spark.table("part").select("p_partkey", vocab.map_cmems_bigram_l05(code).alias("l05"), vocab.map_cmems_bigram_l06(code, wmo).alias("l06"))


def bracket_codes(con: Connection, sf: str) -> DataFrame:
    s = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(") and (X"), F.col("p_size").cast("string"), F.lit(")"))
    return con.spark.table("part").select("p_partkey", vocab.map_instrument_l05(s).alias("one"), vocab.map_instrument_l05_multi(s).alias("many"))


def vocabulary_lookup(con: Connection, sf: str) -> DataFrame:
    v = vocab.Vocabulary(con.spark.table("nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value")))
    return v.lookup(con.spark.table("customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code")), "code", "label").select("c_custkey", "label")


def join_callsign_interval(con: Connection, sf: str) -> DataFrame:
    """Validity intervals of users (each event opens one that the user's next event closes) against probe times."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = con.spark.table("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    spans = e.select("user_id", F.col("at").alias("s"), F.lead("at").over(w).alias("e"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("hit"))
    probes = e.select("event_id", "user_id", (F.col("at") + 1800.0).alias("t"))
    return joins.first_match(probes, spans, "user_id", "t", "s", "e", "ordinal", "hit", 86400.0).select("event_id", "hit")


_SPANS = "SELECT user_id, epoch_us(ts) / 1e6 AS s, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, event_id AS hit FROM events"


def join_asof(con: Connection, sf: str) -> DataFrame:
    """Each click with the user's latest event of any other type: every event is on one side."""
    e = con.spark.table("events")
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.filter("event_type IS DISTINCT FROM 'click'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("prev"))
    return joins.asof_join(left, right, "user_id", "ts", "rts", ["prev"]).select("event_id", "prev")


def join_spatial_grid(con: Connection, sf: str) -> DataFrame:
    p = _coords(con)
    q = p.select(F.col("c_custkey").alias("other"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return joins.grid_join(p, q, "lon", "lat", "x", "y", 6.0).select("c_custkey", "other")


def st_extent(con: Connection, sf: str) -> DataFrame:
    return _coords(con).agg(spatial.extent(F.col("lon"), F.col("lat")).alias("b")).select("b.*")


def geo_distance(con: Connection, sf: str) -> DataFrame:
    lon, lat = F.col("lon"), F.col("lat")
    return _coords(con).select(
        "c_custkey", F.round(spatial.distance(lon, lat, F.lit(4.0), F.lit(52.0)), 6).alias("planar"),
        F.round(spatial.distance_sphere(lon, lat, F.lit(4.0), F.lit(52.0)), 2).alias("sphere"),
    )


def within_rectangle(con: Connection, sf: str) -> DataFrame:
    shape = '{"type":"Polygon","coordinates":[[[-20,-20],[60,-20],[60,50],[-20,50],[-20,-20]]]}'
    return _coords(con).filter(spatial.within_polygon(shape, F.col("lon"), F.col("lat"))).select("c_custkey")


def within_triangle(con: Connection, sf: str) -> DataFrame:
    return _coords(con).filter(spatial.within_polygon("POLYGON ((0 0, 100.5 0, 0 100.5, 0 0))", F.col("lon"), F.col("lat"))).select("c_custkey")


def geo_buffer(con: Connection, sf: str) -> DataFrame:
    return con.sql(f"SELECT c_custkey, round(st_area(st_buffer(st_point({LON}, {LAT}), 2)), 6) AS a, st_isvalid(st_buffer(st_point({LON}, {LAT}), 2)) AS v FROM customer").df


def cluster_kmeans(con: Connection, sf: str) -> DataFrame:
    """Four places far apart: a cluster is a place; which number it has is told by its own least key."""
    p = con.spark.sql("SELECT c_custkey, CAST(c_custkey % 4 AS DOUBLE) * 100 + CAST(c_nationkey AS DOUBLE) / 100 AS lon, 0.0D AS lat FROM customer")
    got = spatial.cluster_kmeans(p, "lon", "lat", 4)
    return got.select("c_custkey", F.min("c_custkey").over(Window.partitionBy("cluster")).alias("least"))


def cluster_dbscan(con: Connection, sf: str) -> DataFrame:
    """Points on a coarse grid, so that clusters are whole grid places: rows of a place (least rows of it are core) share one."""
    p = con.spark.sql("SELECT c_custkey, CAST((c_custkey % 12) * 10 AS DOUBLE) AS lon, CAST(c_nationkey % 3 AS DOUBLE) AS lat FROM customer")
    return spatial.cluster_dbscan(p, "c_custkey", "lon", "lat", 1.0, 3).select("c_custkey", "cluster")


def summarize_lineitem(con: Connection, sf: str) -> DataFrame:
    return con.sql("SUMMARIZE SELECT l_quantity, l_linenumber, l_returnflag FROM lineitem").df.select("column_name", "min", "max", "distinct_count", F.round("avg", 6).alias("avg"), "count", "null_percentage")


def _summary_sql(c: str, number: bool) -> str:
    low = f"CAST(min({c}) AS VARCHAR)"
    return f"SELECT '{c}' AS column_name, {low} AS min, CAST(max({c}) AS VARCHAR) AS max, count(DISTINCT {c}) AS distinct_count, {'round(avg(' + c + '), 6)' if number else 'CAST(NULL AS DOUBLE)'} AS avg, count({c}) AS count, CAST(0 AS DOUBLE) AS null_percentage FROM lineitem"


def ctas_insert_update_delete(con: Connection, sf: str) -> DataFrame:
    con.sql("DROP TABLE IF EXISTS nations")
    con.sql("CREATE TABLE nations AS SELECT n_nationkey, n_name, n_regionkey FROM nation")
    con.sql("INSERT INTO nations VALUES (100, 'ATLANTIS', 9)")
    con.sql("UPDATE nations SET n_name = concat(n_name, '!') WHERE n_regionkey = 2")
    con.sql("DELETE FROM nations WHERE n_nationkey < 5")
    con.sql("ALTER TABLE nations RENAME COLUMN n_regionkey TO region")
    return con.sql("SELECT * FROM nations").df


def mv_refresh(con: Connection, sf: str) -> DataFrame:
    con.sql("DROP TABLE IF EXISTS per_flag")
    con.sql("CREATE MATERIALIZED VIEW per_flag AS SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
    con.sql("REFRESH MATERIALIZED VIEW per_flag")
    return con.sql("SELECT * FROM per_flag").df


def csv_roundtrip(con: Connection, sf: str) -> DataFrame:
    d = f"{con.root}/csv"
    con.sql("SELECT p_partkey, p_name, p_size FROM part").to_csv(d)
    return con.sql(f"SELECT * FROM read_csv('{d}/*.csv')").df


def ipc_roundtrip(con: Connection, sf: str) -> DataFrame:
    path = f"{con.root}/x.arrow"
    con.sql("SELECT n_nationkey, n_name FROM nation").to_ipc(path)
    return con.sql(f"SELECT * FROM read_arrow('{path}')").df


def netcdf_grid(con: Connection, sf: str) -> DataFrame:
    """A region x nation grid, written as NetCDF and read back: as many rows as the grid has cells."""
    path = f"{con.root}/grid.nc"
    con.sql("SELECT r_regionkey, n_nationkey, CAST(r_regionkey * 100 + n_nationkey AS DOUBLE) AS v FROM region CROSS JOIN nation").to_nd_netcdf(path, ["r_regionkey", "n_nationkey"])
    return con.sql(f"SELECT r_regionkey, n_nationkey, v FROM read_netcdf('{path}')").df


def netcdf_projection(con: Connection, sf: str) -> DataFrame:
    """Only the axis is selected, so the grid is that axis."""
    path = f"{con.root}/grid2.nc"
    con.sql("SELECT r_regionkey, n_nationkey, CAST(1 AS DOUBLE) AS v FROM region CROSS JOIN nation").to_nd_netcdf(path, ["r_regionkey", "n_nationkey"])
    return con.sql(f"SELECT r_regionkey FROM read_netcdf('{path}')").df


def ragged_explode(con: Connection, sf: str) -> DataFrame:
    e = con.spark.table("nation").withColumn("rows", F.col("n_nationkey") % 4)
    return e.filter("rows > 0").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.col("rows").cast("int") - 1)).alias("i"))


def geoparquet_roundtrip(con: Connection, sf: str) -> DataFrame:
    path = f"{con.root}/x.geo.parquet"
    from pelagia.sources import sinks

    sinks.to_geoparquet(_coords(con), path, "lon", "lat")
    return con.sql(f"SELECT c_custkey, st_x(geometry) AS x, st_y(geometry) AS y FROM read_geoparquet('{path}')").df


def odv_roundtrip(con: Connection, sf: str) -> DataFrame:
    import zipfile

    path = f"{con.root}/x.zip"
    df = con.spark.sql("SELECT n_name AS cruise, CAST(n_nationkey AS DOUBLE) AS lon, CAST(n_regionkey AS DOUBLE) AS lat, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS t, CAST(n_nationkey * 10 AS DOUBLE) AS depth, CAST(n_nationkey AS DOUBLE) AS temp FROM nation")
    from pelagia.sources import sinks

    sinks.to_odv(df, path, ["cruise"], "lon", "lat", "t", "depth", data=["temp"])
    with zipfile.ZipFile(path) as z:
        z.extractall(f"{con.root}/odv")
    return con.sql(f'SELECT "Cruise" AS cruise, "depth", "temp" FROM read_odv_ascii(\'{con.root}/odv/profiles.txt\')').df


def hive_partitions(con: Connection, sf: str) -> DataFrame:
    d = f"{con.root}/hive"
    con.spark.table("nation").write.mode("overwrite").partitionBy("n_regionkey").parquet(d)
    con.sql(f"CREATE OR REPLACE EXTERNAL TABLE parted STORED AS PARQUET LOCATION '{d}' PARTITIONED BY (n_regionkey)")
    return con.sql("SELECT n_nationkey, n_name, n_regionkey FROM parted WHERE n_regionkey = 2").df


def crawler_partitions(con: Connection, sf: str) -> DataFrame:
    d = f"{con.root}/lake"
    con.spark.table("nation").write.mode("overwrite").partitionBy("n_regionkey").parquet(f"{d}/nations")
    con.spark.table("region").write.mode("overwrite").csv(f"{d}/regions", header=True)
    con.sql(f"CREATE OR REPLACE CRAWLER lake ON '{d}' PREFIX 'c_'")
    con.sql("RUN CRAWLER lake")
    return con.sql("SELECT r.r_name, count(*) AS n FROM c_nations n JOIN c_regions r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name").df


def schema_merge(con: Connection, sf: str) -> DataFrame:
    """Two files of one table with different types and columns: widened, missing ones null."""
    d = f"{con.root}/merge"
    con.spark.sql("SELECT CAST(n_nationkey AS INT) AS k, n_name AS name FROM nation").coalesce(1).write.mode("overwrite").parquet(f"{d}/a")
    con.spark.sql("SELECT CAST(r_regionkey AS BIGINT) + 1000 AS k, 1.5D AS extra FROM region").coalesce(1).write.mode("overwrite").parquet(f"{d}/b")
    return con.sql(f"SELECT * FROM read_parquet('{d}/*/*.parquet')").df


def file_pruning(con: Connection, sf: str) -> DataFrame:
    from pelagia import stats

    d = f"{con.root}/pruned"
    con.spark.table("orders").repartitionByRange(6, "o_orderkey").write.mode("overwrite").parquet(d)
    stats.analyze(con, d)
    return stats.read_pruned(con, f"{d}/*.parquet", {"o_orderkey": (100, 500)}).select("o_orderkey", "o_custkey")


def preset(con: Connection, sf: str) -> DataFrame:
    con.sql(f"CREATE OR REPLACE EXTERNAL TABLE nation_files STORED AS PARQUET LOCATION '{sf}/nation.parquet'")
    con.sql("""SET EXTENSION preset ON nation_files '{"filters": [{"column": "n_regionkey", "operator": "="}], "columns": ["n_name"]}'""")
    return con.preset("nation_files", n_regionkey=1).df


def delta_scan(con: Connection, sf: str) -> DataFrame:
    """A Delta table written by hand (two commits, one file removed) and read at its latest version."""
    import json

    d = f"{con.root}/delta"
    os.makedirs(f"{d}/_delta_log", exist_ok=True)
    names = []
    for k in range(3):
        con.spark.table("nation").filter(f"n_nationkey % 3 = {k}").coalesce(1).write.mode("overwrite").parquet(f"{d}/p{k}")
        names.append(next(f"p{k}/{f}" for f in sorted(os.listdir(f"{d}/p{k}")) if f.endswith(".parquet")))
    meta = {"metaData": {"id": "x", "schemaString": con.spark.table("nation").schema.json(), "partitionColumns": [], "format": {"provider": "parquet"}}}
    with open(f"{d}/_delta_log/{0:020d}.json", "w") as f:
        f.write("\n".join(json.dumps(x) for x in [meta, *[{"add": {"path": n, "partitionValues": {}}} for n in names[:2]]]))
    with open(f"{d}/_delta_log/{1:020d}.json", "w") as f:
        f.write("\n".join(json.dumps(x) for x in [{"remove": {"path": names[0]}}, {"add": {"path": names[2], "partitionValues": {}}}]))
    return con.sql(f"SELECT n_nationkey, n_name FROM read_delta('{d}')").df


def schema_function(con: Connection, sf: str) -> DataFrame:
    return con.sql(f"SELECT * FROM read_parquet_schema('{sf}/nation.parquet')").df


def stream_event_windows(con: Connection, sf: str) -> DataFrame:
    from pelagia.streaming.windows import windowed_counts

    return windowed_counts(con.spark, f"{sf}/events.parquet", "1 hour")


def _depth_sql() -> str:
    """The formula of pressure_to_depth, by Horner's rule."""
    z, sin2 = "(p_retailprice * 1e-4::DOUBLE)", "pow(sin(radians(p_size)), 2)"
    poly = f"{util._ENTHALPY[-1]!r}::DOUBLE"
    for c in util._ENTHALPY[-2::-1]:
        poly = f"({c!r}::DOUBLE + {z} * {poly})"
    b = f"(9.780327::DOUBLE * (1 + (5.2792e-3::DOUBLE + 2.32e-5::DOUBLE * {sin2}) * {sin2}))"
    return f"SELECT p_partkey, round(2 * h / (b + sqrt(b * b + 4 * 1.13e-7::DOUBLE * b * h)), 6) AS depth FROM (SELECT p_partkey, {z} * {poly} * 1e8::DOUBLE AS h, {b} AS b FROM part)"


BUILT: dict[str, tuple[Callable[[Connection, str], DataFrame], str | None]] = {
    "read_parquet_sql": (read_parquet_sql, "SELECT l_returnflag, round(avg(l_quantity), 6) AS q, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "params_bind": (params_bind, "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3"),
    "dsl_filter_and_or": (dsl(select=["n_nationkey", "n_regionkey"], from_="nation", filter={"or": [{"and": [{"column": "n_regionkey", "gt_eq": 1}, {"column": "n_regionkey", "lt": 3}]}, {"column": "n_nationkey", "eq": 0}]}), "SELECT n_nationkey, n_regionkey FROM nation WHERE (n_regionkey >= 1 AND n_regionkey < 3) OR n_nationkey = 0"),
    "dsl_between": (dsl(select=["o_orderkey", {"column": "o_totalprice", "alias": "p"}], from_="orders", filter={"column": "p", "min": 1000, "max": 50000}), "SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "dsl_sort_offset_limit": (dsl(select=["c_custkey", "c_acctbal"], from_="customer", sort_by=[{"Desc": "c_acctbal"}, {"Asc": "c_custkey"}], offset=10, limit=25), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey NULLS LAST LIMIT 25 OFFSET 10"),
    "dsl_distinct_on": (dsl(select=["o_custkey", "o_orderkey"], from_="orders", sort_by=[{"Asc": "o_orderkey"}], distinct={"on": ["o_custkey"], "select": ["o_custkey", "o_orderkey"]}), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey"),
    "dsl_scalar_fn": (dsl(select=["n_nationkey", {"function": "upper", "args": ["n_name"], "alias": "u"}], from_="nation"), "SELECT n_nationkey, upper(n_name) AS u FROM nation"),
    "dsl_geojson": (lambda con, sf: (_coords(con).createOrReplaceTempView("coords"), dsl(select=["c_custkey", "lon", "lat"], from_="coords", filter={"longitude_column": "lon", "latitude_column": "lat", "geometry": {"type": "Polygon", "coordinates": [[[-20, -20], [60, -20], [60, 50], [-20, 50], [-20, -20]]]}})(con, sf))[1], f"SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer WHERE {LON} > -20 AND {LON} < 60 AND {LAT} > -20 AND {LAT} < 50"),
    "fn_coalesce_label": (coalesce_label, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'B' WHEN o_orderkey % 2 = 0 THEN 'A' END AS label FROM orders"),
    "fn_map_units": (map_units, "SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_retailprice * 1.025 WHEN 2 THEN p_retailprice * 44.66080 END, 6) AS v FROM part"),
    "fn_pressure_to_depth": (pressure_to_depth, _depth_sql()),
    "fn_cmems_bigram": (cmems_bigram, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'SDN:L05::30' WHEN 1 THEN 'SDN:L05::130' WHEN 2 THEN 'SDN:L05::132' END AS l05, CASE p_partkey % 5 WHEN 0 THEN 'SDN:L06::30' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'SDN:L06::70' ELSE 'SDN:L06::30' END WHEN 2 THEN 'SDN:L06::30' WHEN 3 THEN 'SDN:L06::27' END AS l06 FROM part"),
    "fn_bracket_codes": (bracket_codes, "SELECT p_partkey, 'SDN:L05::' || p_size AS one, 'SDN:L05::' || p_size || ' SDN:L05::X' || p_size AS many FROM part"),
    "fn_vocabulary": (vocabulary_lookup, "SELECT c_custkey, n_name AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "join_callsign_interval": (join_callsign_interval, f"WITH s AS ({_SPANS}) SELECT p.event_id, min(s.hit) AS hit FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6 + 1800 AS t FROM events) p LEFT JOIN s ON s.user_id = p.user_id AND s.s <= p.t AND (s.e IS NULL OR p.t < s.e) GROUP BY p.event_id"),
    "join_asof": (join_asof, "SELECT l.event_id, (SELECT max(r.event_id) FROM events r WHERE r.user_id = l.user_id AND r.event_type IS DISTINCT FROM 'click' AND r.ts = (SELECT max(q.ts) FROM events q WHERE q.user_id = l.user_id AND q.event_type IS DISTINCT FROM 'click' AND q.ts <= l.ts)) AS prev FROM events l WHERE l.event_type = 'click'"),
    "join_spatial_grid": (join_spatial_grid, f"WITH p AS (SELECT c_custkey, {LON} AS lon, {LAT} AS lat FROM customer) SELECT a.c_custkey, b.c_custkey AS other FROM p a JOIN p b ON (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= 36"),
    "st_extent": (st_extent, f"SELECT min({LON}) AS xmin, min({LAT}) AS ymin, max({LON}) AS xmax, max({LAT}) AS ymax FROM customer"),
    "geo_distance": (geo_distance, f"SELECT c_custkey, round(sqrt(power({LON} - 4, 2) + power({LAT} - 52, 2)), 6) AS planar, round(2 * 6371008.771415059 * asin(least(1, sqrt(power(sin(radians(52 - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(52)) * power(sin(radians(4 - {LON}) / 2), 2)))), 2) AS sphere FROM customer"),
    "geo_within_rectangle": (within_rectangle, f"SELECT c_custkey FROM customer WHERE {LON} > -20 AND {LON} < 60 AND {LAT} > -20 AND {LAT} < 50"),
    "geo_within_polygon": (within_triangle, f"SELECT c_custkey FROM customer WHERE {LON} > 0 AND {LAT} > 0 AND {LON} + {LAT} < 100.5"),
    "geo_buffer": (geo_buffer, "SELECT c_custkey, round(64 * sin(pi() / 16), 6) AS a, true AS v FROM customer"),
    "geo_cluster_kmeans": (cluster_kmeans, "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_custkey % 4) AS least FROM customer"),
    "geo_cluster_dbscan": (cluster_dbscan, "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INTEGER) AS cluster FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_custkey % 12) AS m FROM customer)"),
    "summarize_lineitem": (summarize_lineitem, " UNION ALL ".join(_summary_sql(c, n) for c, n in (("l_quantity", True), ("l_linenumber", True), ("l_returnflag", False)))),
    "ctas_insert_update_delete": (ctas_insert_update_delete, "SELECT * FROM (SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey AS region FROM nation UNION ALL SELECT 100, 'ATLANTIS', 9) WHERE n_nationkey >= 5"),
    "mv_refresh": (mv_refresh, "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "csv_roundtrip": (csv_roundtrip, "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, p_size FROM part"),
    "ipc_roundtrip": (ipc_roundtrip, "SELECT n_nationkey, n_name FROM nation"),
    "nd_netcdf_grid": (netcdf_grid, "SELECT r_regionkey, n_nationkey, CAST(r_regionkey * 100 + n_nationkey AS DOUBLE) AS v FROM region CROSS JOIN nation"),
    "nd_netcdf_projection": (netcdf_projection, "SELECT r_regionkey FROM region"),
    "nd_ragged_explode": (ragged_explode, "SELECT n_nationkey, CAST(unnest(range(0, n_nationkey % 4)) AS INTEGER) AS i FROM nation"),
    "geoparquet_roundtrip": (geoparquet_roundtrip, f"SELECT c_custkey, {LON} AS x, {LAT} AS y FROM customer"),
    "odv_roundtrip": (odv_roundtrip, "SELECT n_name AS cruise, CAST(n_nationkey * 10 AS DOUBLE) AS depth, CAST(n_nationkey AS DOUBLE) AS temp FROM nation"),
    "hive_partitions": (hive_partitions, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "crawler_partitions": (crawler_partitions, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "schema_merge": (schema_merge, "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(NULL AS DOUBLE) AS extra FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 1000, NULL, 1.5 FROM region"),
    "file_pruning": (file_pruning, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 500"),
    "preset": (preset, "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "delta_scan": (delta_scan, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 <> 0"),
    "schema_function": (schema_function, "SELECT column_name, CASE data_type WHEN 'INTEGER' THEN 'Int32' WHEN 'VARCHAR' THEN 'Utf8' ELSE data_type END AS data_type, is_nullable = 'YES' AS nullable FROM information_schema.columns WHERE table_name = 'nation'"),
    **statement_queries.BUILT,
    "stream_event_windows": (stream_event_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}

_made: dict[int, Connection] = {}
_shown: dict[int, str] = {}  # the folder whose tables a connection's session shows


def connection(spark: SparkSession, sf_dir: str) -> Connection:
    """A connection whose session sees the tables of the folder as views."""
    con = _made.get(id(spark))
    if con is None or con.spark is not spark or con.spark.sparkContext._jsc is None:
        con = _made[id(spark)] = Connection(spark)
    if _shown.get(id(con)) != sf_dir:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        _shown[id(con)] = sf_dir
    return con


def _of_text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: connection(spark, sf_dir).sql(text).df


def _of_function(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(connection(spark, sf_dir), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _of_text(t) for n, t in SAME.items()}
    out |= {n: _of_text(t) for n, (t, _) in PAIRS.items()}
    return out | {n: _of_function(f) for n, (f, _) in BUILT.items()}


def oracle_sql() -> dict[str, str]:
    return {**SAME, **{n: o for n, (_, o) in PAIRS.items()}, **{n: o for n, (_, o) in BUILT.items() if o}}
