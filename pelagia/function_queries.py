"""Queries over every documented scalar and spatial function: dialect text, and what an independent engine says.

No value of the second text comes from Spark: it is the other engine's own function, or a constant or formula worked out by hand.
"""

# a line of three points, a square with a hole and a point, all of them sized by k = r_regionkey + 1 in 1..5
_K = "(r_regionkey + 1)"
_LINE = f"st_geomfromtext(concat('LINESTRING (0 0, ', CAST({_K} AS VARCHAR), ' 0, ', CAST({_K} AS VARCHAR), ' 3)'))"
_BOX = f"st_makeenvelope(0, 0, {_K}, {_K})"
_HOLED = "'POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))'"
_POINT = f"st_point({_K}, 2)"
_k = "(r_regionkey + 1)"
_line = f"'LINESTRING (0 0, ' || {_k} || ' 0, ' || {_k} || ' 3)'"
_square = f"'POLYGON ((0 0, 0 ' || {_k} || ', ' || {_k} || ' ' || {_k} || ', ' || {_k} || ' 0, 0 0))'"

FUNCTIONS = {
    "fn_trigonometry": (
        "SELECT p_partkey, round(acos(x), 9) AS a, round(acosh(x + 1), 9) AS b, round(asin(x), 9) AS c, round(asinh(x), 9) AS d, round(atan(x), 9) AS e, round(atanh(x / 2), 9) AS f, round(cos(x), 9) AS g, round(cosh(x), 9) AS h, round(cot(x + 1), 9) AS i, round(sinh(x), 9) AS j, round(tan(x), 9) AS k, round(tanh(x), 9) AS l, round(radians(x), 9) AS m, round(pi() + x, 9) AS n, signum(x - 0.5) AS o FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)",
        "SELECT p_partkey, round(acos(x), 9) AS a, round(acosh(x + 1), 9) AS b, round(asin(x), 9) AS c, round(asinh(x), 9) AS d, round(atan(x), 9) AS e, round(atanh(x / 2), 9) AS f, round(cos(x), 9) AS g, round(cosh(x), 9) AS h, round(cot(x + 1), 9) AS i, round(sinh(x), 9) AS j, round(tan(x), 9) AS k, round(tanh(x), 9) AS l, round(radians(x), 9) AS m, round(pi() + x, 9) AS n, CAST(sign(x - 0.5::DOUBLE) AS DOUBLE) AS o FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 50 AS x FROM part)",
    ),
    "fn_float_cases": (
        "SELECT p_partkey, isnan(x) AS n, nanvl(x, -1.0) AS v, iszero(x) AS z, pow(y, 2) AS w, power(2, y) AS p, ln(y - y) AS l0, isnan(ln(-1 - y)) AS l1, y / 0 AS d, isnan(0.0 / (y - y)) AS q FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_partkey % 3 - 1 AS DOUBLE) END AS x, CAST(p_size AS DOUBLE) AS y FROM part)",
        "SELECT p_partkey, p_partkey % 3 = 0 AS n, CASE WHEN p_partkey % 3 = 0 THEN -1.0::DOUBLE ELSE CAST(p_partkey % 3 - 1 AS DOUBLE) END AS v, p_partkey % 3 = 1 AS z, pow(CAST(p_size AS DOUBLE), 2) AS w, pow(2::DOUBLE, p_size) AS p, '-inf'::DOUBLE AS l0, true AS l1, 'inf'::DOUBLE AS d, true AS q FROM part",
    ),
    "fn_integer_division": (
        "SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS a, (0 - l_orderkey) / 7 AS b, l_orderkey / l_linenumber / 2 AS c, l_quantity / l_linenumber AS d, l_linenumber / 2.0 AS e, sum(l_linenumber) OVER (PARTITION BY l_orderkey) / 3 AS f FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS a, -(l_orderkey // 7) AS b, l_orderkey // l_linenumber // 2 AS c, l_quantity / l_linenumber AS d, l_linenumber / 2 AS e, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey) // 3 AS BIGINT) AS f FROM lineitem",
    ),
    "fn_random": ("SELECT count(*) AS n, min(r >= 0 AND r < 1) AS inside, count(DISTINCT r) > 1 AS varied, min(length(u)) AS short, max(length(u)) AS long, count(DISTINCT u) AS different FROM (SELECT random() AS r, uuid() AS u FROM part)", "SELECT count(*) AS n, true AS inside, true AS varied, 36 AS short, 36 AS long, count(*) AS different FROM part"),
    "fn_min_max": ("SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS a, max(o_orderpriority) AS b FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS a, max(o_orderpriority) AS b FROM orders GROUP BY o_orderstatus"),
    "fn_trim": (
        "SELECT p_partkey, trim('xax', 'x') AS a, ltrim(concat('xx', p_name), 'x') AS b, rtrim(concat(p_name, 'yy'), 'y') AS c, btrim(concat('xy', p_name, 'yx'), 'xy') AS d, trim('  a ') AS e, btrim('  a ') AS f, ltrim('  a ') AS g, rtrim('  a ') AS h FROM part",
        "SELECT p_partkey, 'a' AS a, ltrim('xx' || p_name, 'x') AS b, rtrim(p_name || 'yy', 'y') AS c, trim('xy' || p_name || 'yx', 'xy') AS d, 'a' AS e, 'a' AS f, 'a ' AS g, '  a' AS h FROM part",
    ),
    "fn_text_lengths": (
        "SELECT p_partkey, bit_length(p_name) AS a, char_length(p_name) AS b, character_length(concat(p_name, 'é')) AS c, octet_length(concat(p_name, 'é')) AS d, length(p_type) AS e, levenshtein(p_name, p_type) AS f, ascii('é') AS g, chr(8364) AS h, chr(65 + p_size % 26) AS i FROM part",
        "SELECT p_partkey, bit_length(p_name) AS a, length(p_name) AS b, length(p_name) + 1 AS c, strlen(p_name) + 2 AS d, length(p_type) AS e, levenshtein(p_name, p_type) AS f, 233 AS g, '€' AS h, chr(65 + p_size % 26) AS i FROM part",
    ),
    "fn_text_parts": (
        "SELECT p_partkey, ends_with(p_name, 'e') AS a, find_in_set(p_brand, concat('x,', p_brand)) AS b, initcap(lower(n)) AS c, instr(p_name, 'e') AS d, lower(p_type) AS e, overlay(p_name PLACING 'ZZ' FROM 2 FOR 3) AS f, overlay(p_name PLACING 'ZZ' FROM 2) AS f2, position('a' IN p_name) AS g, substr_index(p_type, ' ', 1) AS h, substring(p_name, 2) AS i, substring_index(p_type, ' ', 2) AS j, to_hex(p_partkey) AS k FROM (SELECT part.*, 'ab CD' AS n FROM part)",
        "SELECT p_partkey, ends_with(p_name, 'e') AS a, 2 AS b, 'Ab Cd' AS c, instr(p_name, 'e') AS d, lower(p_type) AS e, substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 5) AS f, substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 4) AS f2, position('a' IN p_name) AS g, split_part(p_type, ' ', 1) AS h, substr(p_name, 2) AS i, CASE WHEN len(string_split(p_type, ' ')) > 1 THEN split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) ELSE p_type END AS j, lower(to_hex(p_partkey)) AS k FROM part",
    ),
    "fn_null_choice": ("SELECT c_custkey, nvl(nullif(c_nationkey, 3), -1) AS a, nvl2(nullif(c_nationkey, 3), 'some', 'none') AS b FROM customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, CASE WHEN c_nationkey = 3 THEN 'none' ELSE 'some' END AS b FROM customer"),
    "fn_regex_flags": (
        "SELECT p_partkey, regexp_like(upper(p_name), '^[a-m]', 'i') AS a, regexp_count(upper(p_name), 'e', 1, 'i') AS b, regexp_count(p_name, 'e', 3) AS c, regexp_instr(p_name, 'e') AS d, regexp_instr(p_name, '[aeiou]', 2, 2) AS e, regexp_instr(upper(p_name), '([aeiou])([^aeiou])', 1, 1, 'i', 2) AS f, regexp_match('foobarbequebaz', '(bar)(beque)')[1] AS g, regexp_match(p_name, '^.')[0] AS h, regexp_match('ABC', 'b', 'i')[0] AS i, regexp_replace(upper(p_name), 'E', '-', 'gi') AS j FROM part",
        "SELECT p_partkey, regexp_matches(p_name, '^[a-mA-M]') AS a, CAST(len(regexp_extract_all(lower(p_name), 'e')) AS INTEGER) AS b, CAST(len(regexp_extract_all(substr(p_name, 3), 'e')) AS INTEGER) AS c, instr(p_name, 'e') AS d, "
        "CAST(coalesce(list_filter(range(2, length(p_name) + 1), lambda x: substr(p_name, x, 1) IN ('a', 'e', 'i', 'o', 'u'))[2], 0) AS INTEGER) AS e, CAST(coalesce(list_filter(range(1, length(p_name)), lambda x: substr(lower(p_name), x, 1) IN ('a', 'e', 'i', 'o', 'u') AND substr(lower(p_name), x + 1, 1) NOT IN ('a', 'e', 'i', 'o', 'u'))[1] + 1, 0) AS INTEGER) AS f, 'beque' AS g, substr(p_name, 1, 1) AS h, 'B' AS i, replace(upper(p_name), 'E', '-') AS j FROM part",
    ),
    "fn_date_parts": (
        "SELECT event_id, date_part('dow', ts) AS a, datepart('doy', ts) AS b, date_part('epoch', ts) AS c, extract(hour FROM ts) AS d, date_part('minute', ts) AS e, date_part('second', ts) AS f, date_part('quarter', ts) AS g, date_part('month', ts) AS h, date_part('week', ts) AS i, datetrunc('day', ts) AS j, date_part('isodow', ts) AS k, extract(dow FROM ts) AS l, date_part('millisecond', ts) AS m FROM events",
        "SELECT event_id, CAST(dayofweek(ts) AS INTEGER) AS a, CAST(dayofyear(ts) AS INTEGER) AS b, epoch(ts) AS c, CAST(hour(ts) AS INTEGER) AS d, CAST(minute(ts) AS INTEGER) AS e, CAST(second(ts) AS INTEGER) AS f, CAST(quarter(ts) AS INTEGER) AS g, CAST(month(ts) AS INTEGER) AS h, CAST(weekofyear(ts) AS INTEGER) AS i, date_trunc('day', ts)::TIMESTAMP AS j, CAST(isodow(ts) - 1 AS INTEGER) AS k, CAST(dayofweek(ts) AS INTEGER) AS l, CAST(millisecond(ts) AS INTEGER) AS m FROM events",
    ),
    "fn_date_parsing": (
        "SELECT o_orderkey, to_date(to_char(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS a, to_timestamp(to_char(o_orderdate, '%d-%m-%Y %H:%M'), '%d-%m-%Y %H:%M') AS b, to_date(date_format(o_orderdate, '%Y%m%d'), '%d.%m.%Y', '%Y%m%d') AS c, to_timestamp(86400 + o_orderkey) AS d, to_timestamp('2020-02-03T04:05:06') AS e, to_date('2021-03-04') AS f, to_timestamp_micros(o_orderkey) AS g, to_timestamp_millis('2020-01-02 03:04:05.6789') AS h, from_unixtime(o_orderkey) AS i, to_local_time(to_timestamp(o_orderkey)) AS j FROM orders",
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, date_trunc('minute', o_orderdate)::TIMESTAMP AS b, CAST(o_orderdate AS DATE) AS c, make_timestamp((86400 + o_orderkey) * 1000000) AS d, TIMESTAMP '2020-02-03 04:05:06' AS e, DATE '2021-03-04' AS f, make_timestamp(o_orderkey) AS g, TIMESTAMP '2020-01-02 03:04:05.678' AS h, make_timestamp(o_orderkey * 1000000) AS i, make_timestamp(o_orderkey * 1000000) AS j FROM orders",
    ),
    "fn_times": (
        "SELECT n_nationkey, CAST(make_time(n_nationkey % 24, 30, 5) AS VARCHAR) AS a, CAST(to_time('12:30:05') AS VARCHAR) AS b, CAST(to_time('12h30', '%Hh%M') AS VARCHAR) AS c, from_unixtime(0, 'Asia/Tokyo') AS d, current_time() IS NOT NULL AS e, now() >= TIMESTAMP '2020-01-01 00:00:00' AS f, today() = current_date() AS g, current_timestamp() = now() AS h FROM nation",
        "SELECT n_nationkey, lpad(CAST(n_nationkey % 24 AS VARCHAR), 2, '0') || ':30:05' AS a, '12:30:05' AS b, '12:30:00' AS c, TIMESTAMP '1970-01-01 09:00:00' AS d, true AS e, true AS f, true AS g, true AS h FROM nation",
    ),
    "fn_base64": ("SELECT n_nationkey, encode(concat(n_name, 'x'), 'base64') AS a, decode('5aC0', 'base64') AS b, decode(encode(n_name, 'hex'), 'hex') AS c FROM nation", "SELECT n_nationkey, rtrim(base64(encode(n_name || 'x')), '=') AS a, '場' AS b, n_name AS c FROM nation"),
    "order_nulls": (
        "SELECT c_custkey, row_number() OVER (ORDER BY v, c_custkey) AS up, row_number() OVER (ORDER BY v DESC, c_custkey) AS down FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS v FROM customer)",
        "SELECT c_custkey, row_number() OVER (ORDER BY v NULLS LAST, c_custkey) AS up, row_number() OVER (ORDER BY v DESC NULLS FIRST, c_custkey) AS down FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS v FROM customer)",
    ),
    "order_nulls_limit": (
        "SELECT c_custkey, v FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS v FROM customer) ORDER BY v DESC, c_custkey LIMIT 10",
        "SELECT c_custkey, v FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS v FROM customer) ORDER BY v DESC NULLS FIRST, c_custkey LIMIT 10",
    ),
    "fn_units_sql": ("SELECT p_partkey, round(map_units('SDN:P06::KGUM', 'SDN:P06::UPOX', p_retailprice), 6) AS a, map_units('SDN:P06::UPOX', 'SDN:P06::UPOX', p_retailprice) AS b FROM part", "SELECT p_partkey, round(p_retailprice * 1.025, 6) AS a, CAST(NULL AS DOUBLE) AS b FROM part"),
    "fn_coalesce_label_sql": ("SELECT o_orderkey, coalesce_label(CASE WHEN o_orderkey % 2 = 0 THEN 1 END, 'A', CASE WHEN o_orderkey % 3 = 0 THEN 1 END, 'B') AS l FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'B' WHEN o_orderkey % 2 = 0 THEN 'A' END AS l FROM orders"),
    "fn_emodnet": (
        "SELECT p_partkey, map_emodnet_chemistry_instrument_l05(s) AS a, map_emodnet_chemistry_instrument_l05_multi(s) AS b, map_emodnet_chemistry_platform_l06(s) AS c, map_emodnet_chemistry_originator_edmo(s) AS d, map_seadatanet_instrument_l05(s) AS e, map_seadatanet_platform_l06(s) AS f, map_emodnet_chemistry_instrument_info_l22(i, 'SDN:P01::A1') AS g, map_cora_platform_l06('CT', '1') AS h FROM (SELECT p_partkey, concat('x (', CAST(p_size AS VARCHAR), ') and (', CAST(p_size + 1 AS VARCHAR), ')') AS s, 'SDN:P01::A1 SDN:L22::T9|SDN:P01::B2 SDN:L22::T8' AS i FROM part)",
        "SELECT p_partkey, 'SDN:L05::' || p_size AS a, 'SDN:L05::' || p_size || ' SDN:L05::' || (p_size + 1) AS b, 'SDN:L06::' || p_size AS c, CAST(p_size + 1 AS BIGINT) AS d, 'SDN:L05::' || p_size AS e, 'SDN:L06::' || p_size AS f, 'SDN:L22::T9' AS g, 'SDN:L06::30' AS h FROM part",
    ),
}

SPATIAL = {
    "geo_accessors": (
        f"SELECT r_regionkey, st_z(st_pointz({_K}, 1, 2)) AS z, st_z({_POINT}) AS z0, st_m({_POINT}) AS m, st_srid(st_setsrid({_POINT}, 4326)) AS s, st_srid({_POINT}) AS s0, st_dimension({_LINE}) AS d, st_coorddim(st_makepoint(1, 2, 3)) AS c, st_numpoints({_LINE}) AS np, st_numgeometries('MULTIPOINT ((0 0), (1 1))') AS ng, st_numinteriorrings({_HOLED}) AS nr, st_isempty('POINT EMPTY') AS e, st_isclosed({_LINE}) AS ic, st_isring('LINESTRING (0 0, 1 0, 1 1, 0 0)') AS ir, st_issimple('LINESTRING (0 0, 2 2, 2 0, 0 2)') AS si, st_npoints({_HOLED}) AS n FROM region",
        "SELECT r_regionkey, 2.0::DOUBLE AS z, NULL::DOUBLE AS z0, NULL::DOUBLE AS m, 4326 AS s, 0 AS s0, 1 AS d, 3 AS c, 3 AS np, 2 AS ng, 1 AS nr, true AS e, false AS ic, true AS ir, false AS si, 10 AS n FROM region",
    ),
    "geo_parts": (
        f"SELECT r_regionkey, st_astext(st_startpoint({_LINE})) AS a, st_astext(st_endpoint({_LINE})) AS b, st_astext(st_pointn({_LINE}, 2)) AS c, st_astext(st_exteriorring({_HOLED})) AS d, st_astext(st_interiorringn({_HOLED}, 1)) AS e, st_astext(st_geometryn('MULTIPOINT ((0 0), (1 1))', 2)) AS f, st_pointn({_LINE}, 9) IS NULL AS g, st_astext(st_dump('MULTIPOINT ((0 0), (1 1))')[1]) AS h FROM region",
        f"SELECT r_regionkey, 'POINT (0 0)' AS a, 'POINT (' || {_k} || ' 3)' AS b, 'POINT (' || {_k} || ' 0)' AS c, 'LINESTRING (0 0, 10 0, 10 10, 0 10, 0 0)' AS d, 'LINESTRING (2 2, 2 4, 4 4, 4 2, 2 2)' AS e, 'POINT (1 1)' AS f, true AS g, 'POINT (1 1)' AS h FROM region",
    ),
    "geo_constructors": (
        f"SELECT r_regionkey, st_astext({_POINT}) AS a, st_astext(st_makepoint({_K}, 1)) AS b, st_astext(st_pointz(1, 2, {_K})) AS c, st_astext(st_makeline(st_point(0, 0), {_POINT})) AS d, st_astext(st_makepolygon('LINESTRING (0 0, 2 0, 2 2, 0 0)')) AS e, st_astext({_BOX}) AS f, st_xmax(st_makebox2d(0, 0, {_K}, 1)) AS g, st_astext(st_point(1, 2, 3)) AS h FROM region",
        f"SELECT r_regionkey, 'POINT (' || {_k} || ' 2)' AS a, 'POINT (' || {_k} || ' 1)' AS b, 'POINT Z(1 2 ' || {_k} || ')' AS c, 'LINESTRING (0 0, ' || {_k} || ' 2)' AS d, 'POLYGON ((0 0, 2 0, 2 2, 0 0))' AS e, {_square} AS f, CAST({_k} AS DOUBLE) AS g, 'POINT Z(1 2 3)' AS h FROM region",
    ),
    "geo_formats": (
        f"SELECT r_regionkey, hex(st_asbinary(st_point(1, 2))) AS a, hex(st_asewkb(st_setsrid(st_point(1, 2), 4326))) AS b, st_astext(st_geomfromwkb(st_asbinary({_LINE}))) AS c, st_srid(st_geomfromewkb(st_asewkb(st_setsrid({_POINT}, 4326)))) AS d, st_astext(st_geomfromgeojson('{{\"type\":\"LineString\",\"coordinates\":[[0,0],[1,2]]}}')) AS e, st_asgeojson({_BOX}) AS f, st_geohash(st_point(-5.6, 42.6), 5) AS g, round(st_x(st_pointfromgeohash('ezs42')), 1) AS h, st_geojson_as_wkt('{{\"type\":\"Point\",\"coordinates\":[1,2]}}') AS i, length(st_geohash({_POINT})) AS j FROM region",
        f"SELECT r_regionkey, '00000000013FF00000000000004000000000000000' AS a, '0020000001000010E63FF00000000000004000000000000000' AS b, {_line} AS c, 0 AS d, 'LINESTRING (0 0, 1 2)' AS e, '{{\"type\":\"Polygon\",\"coordinates\":[[[0,0],[0,' || {_k} || '],[' || {_k} || ',' || {_k} || '],[' || {_k} || ',0],[0,0]]]}}' AS f, 'ezs42' AS g, -5.6::DOUBLE AS h, 'POINT (1 2)' AS i, 20 AS j FROM region",
    ),
    "geo_predicates": (
        f"SELECT r_regionkey, st_intersects({_BOX}, st_point(3, 3)) AS a, st_disjoint({_BOX}, st_point(3, 3)) AS b, st_contains({_BOX}, st_point(2, 1)) AS c, st_containsproperly({_BOX}, st_point(0, 0)) AS d, st_within(st_point(2, 1), {_BOX}) AS e, st_covers({_BOX}, st_point(0, 0)) AS f, st_coveredby(st_point(2, 2), {_BOX}) AS g, st_touches({_BOX}, st_makeenvelope({_K}, 0, 9, 1)) AS h, st_crosses('LINESTRING (-1 0.5, 9 0.5)', {_BOX}) AS i, st_overlaps({_BOX}, st_makeenvelope(0.5, 0.5, 9, 9)) AS j, st_equals({_BOX}, st_makeenvelope(0, 0, 2, 2)) AS k, st_relate({_POINT}, {_POINT}) AS l, st_relate({_BOX}, st_point(0.5, 0.5), '0FFFFF212') AS l1, st_relate({_BOX}, st_point(0.5, 0.5), 'T********') AS l2, st_dwithin({_BOX}, st_point(10, 0), 7) AS m, st_dfullywithin({_BOX}, st_point(0, 0), 4) AS n, st_bboxintersects('LINESTRING (0 0, 5 5)', st_makeenvelope(3, 0, 4, {_K} * 0.1)) AS o FROM region",
        f"SELECT r_regionkey, {_k} >= 3 AS a, {_k} < 3 AS b, {_k} > 2 AS c, false AS d, {_k} > 2 AS e, true AS f, {_k} >= 2 AS g, true AS h, true AS i, true AS j, {_k} = 2 AS k, '0FFFFFFF2' AS l, false AS l1, true AS l2, {_k} >= 3 AS m, {_k} * sqrt(2) <= 4 AS n, true AS o FROM region",
    ),
    "geo_measures": (
        f"SELECT r_regionkey, st_area({_HOLED}) AS a, st_length({_LINE}) AS b, st_perimeter({_BOX}) AS c, st_distance({_BOX}, st_point(10, 0)) AS d, round(st_maxdistance({_BOX}, st_point(0, 0)), 9) AS e, st_hausdorffdistance('LINESTRING (0 0, 2 0)', concat('LINESTRING (0 ', CAST({_K} AS VARCHAR), ', 2 ', CAST({_K} AS VARCHAR), ')')) AS f, st_frechetdistance('LINESTRING (0 0, 2 0)', concat('LINESTRING (0 ', CAST({_K} AS VARCHAR), ', 2 ', CAST({_K} AS VARCHAR), ')')) AS g, round(st_distancesphere(st_point(0, 0), st_point(0, {_K})), 3) AS h, round(st_distancespheroid(st_point(0, 0), st_point({_K}, 0)), 3) AS i, st_length({_BOX}) AS j FROM region",
        f"SELECT r_regionkey, 96.0::DOUBLE AS a, {_k} + 3.0::DOUBLE AS b, 4.0::DOUBLE * {_k} AS c, 10.0::DOUBLE - {_k} AS d, round({_k} * sqrt(2), 9) AS e, {_k}::DOUBLE AS f, {_k}::DOUBLE AS g, round(6371008.771415059 * radians({_k}), 3) AS h, round(6378137 * radians({_k}), 3) AS i, 0.0::DOUBLE AS j FROM region",
    ),
    "geo_locate": (
        f"SELECT r_regionkey, st_astext(st_closestpoint({_BOX}, st_point(9, 0))) AS a, st_astext(st_shortestline(st_point(0, 0), st_point({_K}, 0))) AS b, round(st_linelocatepoint('LINESTRING (0 0, 10 0)', {_POINT}), 9) AS c, st_astext(st_lineinterpolatepoint('LINESTRING (0 0, 10 0)', {_K} / 10.0)) AS d, round(st_azimuth(st_point(0, 0), st_point({_K}, 0)), 9) AS e, round(st_y(st_project(st_point(0, 0), 0, 0)), 9) AS f, round(st_x(st_project(st_point(0, 0), 111319.49079327358 * {_K}, pi() / 2)), 6) AS g FROM region",
        f"SELECT r_regionkey, 'POINT (' || {_k} || ' 0)' AS a, 'LINESTRING (0 0, ' || {_k} || ' 0)' AS b, round({_k} / 10, 9) AS c, 'POINT (' || {_k} || ' 0)' AS d, round(pi() / 2, 9) AS e, 0.0::DOUBLE AS f, {_k}::DOUBLE AS g FROM region",
    ),
    "geo_overlay": (
        f"SELECT r_regionkey, st_area(st_union({_BOX}, st_makeenvelope(0, 0, 1, 9))) AS a, st_area(st_intersection({_BOX}, st_makeenvelope(0, 0, 1, 9))) AS b, st_area(st_difference({_BOX}, st_makeenvelope(0, 0, 1, 9))) AS c, st_area(st_symdifference({_BOX}, st_makeenvelope(0, 0, 1, 9))) AS d, st_intersection({_BOX}, {_POINT}) IS NULL AS e FROM region",
        f"SELECT r_regionkey, 9.0::DOUBLE + {_k} * {_k} - {_k} AS a, {_k}::DOUBLE AS b, ({_k} * {_k} - {_k})::DOUBLE AS c, 9.0::DOUBLE + {_k} * {_k} - 2 * {_k} AS d, true AS e FROM region",
    ),
    "geo_derived": (
        f"SELECT r_regionkey, st_area(st_convexhull('MULTIPOINT ((0 0), (2 0), (2 2), (0 2), (1 1))')) AS a, st_area(st_concavehull('MULTIPOINT ((0 0), (2 0), (2 2), (0 2))', 1)) AS b, round(st_area(st_orientedenvelope('MULTIPOINT ((0 0), (2 0), (2 1), (0 1))')), 9) AS c, st_length(st_boundary({_BOX})) AS d, st_astext(st_centroid({_BOX})) AS e, st_within(st_pointonsurface({_HOLED}), {_HOLED}) AS f, round(st_area(st_buffer({_POINT}, 2)) / (2 * 2 * 8 * 4 * sin(pi() / 16) / 2), 9) AS g, st_isvalid({_HOLED}) AS h, st_isvalid('POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))') AS i, st_isvalidreason({_BOX}) AS j, st_isvalidreason('POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))') AS k, st_area(st_makevalid('POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))')) AS l FROM region",
        f"SELECT r_regionkey, 4.0::DOUBLE AS a, 4.0::DOUBLE AS b, 2.0::DOUBLE AS c, 4.0::DOUBLE * {_k} AS d, 'POINT (' || CASE WHEN {_k} % 2 = 0 THEN CAST({_k} // 2 AS VARCHAR) ELSE ({_k} // 2) || '.5' END || ' ' || CASE WHEN {_k} % 2 = 0 THEN CAST({_k} // 2 AS VARCHAR) ELSE ({_k} // 2) || '.5' END || ')' AS e, true AS f, 1.0::DOUBLE AS g, true AS h, false AS i, 'Valid Geometry' AS j, 'Self-intersection[1 1]' AS k, 2.0::DOUBLE AS l FROM region",
    ),
    "geo_processing": (
        f"SELECT r_regionkey, st_astext(st_simplify('LINESTRING (0 0, 1 0.1, 2 0)', 0.5)) AS a, st_astext(st_simplifyvw('LINESTRING (0 0, 1 0.1, 2 0)', 0.5)) AS b, st_npoints(st_segmentize('LINESTRING (0 0, 10 0)', {_K})) AS c, st_segmentize('LINESTRING (0 0, 10 0)', 0) IS NULL AS c0, st_astext(st_removerepeatedpoints('LINESTRING (0 0, 0 0, 1 1)')) AS d, st_astext(st_reverse('LINESTRING (0 0, 1 1)')) AS e, st_astext(st_forcepolygonccw({_BOX})) AS f, st_astext(st_forcepolygoncw('POLYGON ((0 0, 1 0, 1 1, 0 0))')) AS g, st_astext(st_force2d('POINT Z (1 2 3)')) AS h, st_astext(st_force3d(st_point(1, 2))) AS i, st_astext(st_flipcoordinates({_POINT})) AS j, st_astext(st_snaptogrid(st_point(1.2, 3.7), 0.5)) AS k, st_astext(st_chaikinsmoothing('LINESTRING (0 0, 4 0, 4 4)', 1)) AS l FROM region",
        f"SELECT r_regionkey, 'LINESTRING (0 0, 2 0)' AS a, 'LINESTRING (0 0, 2 0)' AS b, CAST(ceil(10 / {_k}) + 1 AS INTEGER) AS c, true AS c0, 'LINESTRING (0 0, 1 1)' AS d, 'LINESTRING (1 1, 0 0)' AS e, 'POLYGON ((0 0, ' || {_k} || ' 0, ' || {_k} || ' ' || {_k} || ', 0 ' || {_k} || ', 0 0))' AS f, 'POLYGON ((0 0, 1 1, 1 0, 0 0))' AS g, 'POINT (1 2)' AS h, 'POINT Z(1 2 0)' AS i, 'POINT (2 ' || {_k} || ')' AS j, 'POINT (1 3.5)' AS k, 'LINESTRING (0 0, 1 0, 3 0, 4 1, 4 3, 4 4)' AS l FROM region",
    ),
    "geo_affine": (
        f"SELECT r_regionkey, st_astext(st_translate({_POINT}, 1, 2)) AS a, st_astext(st_scale({_POINT}, 2, 3)) AS b, round(st_y(st_rotate({_POINT}, pi() / 2)), 9) AS c, st_astext(st_affine({_POINT}, 1, 2, 3, 4, 5, 6)) AS d FROM region",
        f"SELECT r_regionkey, 'POINT (' || ({_k} + 1) || ' 4)' AS a, 'POINT (' || (2 * {_k}) || ' 6)' AS b, {_k}::DOUBLE AS c, 'POINT (' || ({_k} + 4 + 5) || ' ' || (3 * {_k} + 8 + 6) || ')' AS d FROM region",
    ),
    "geo_boxes": (
        f"SELECT r_regionkey, st_xmin(st_envelope({_LINE})) AS a, st_ymax(st_envelope({_LINE})) AS b, st_xmax(st_expand({_BOX}, 1)) AS c, st_xmin({_BOX}) AS d, st_ymin(st_expand({_BOX}, 1)) AS e, st_zmin('LINESTRING Z (0 0 3, 1 1 5)') AS f, st_zmax('LINESTRING Z (0 0 3, 1 1 5)') AS g, st_zmin({_POINT}) AS h FROM region",
        f"SELECT r_regionkey, 0.0::DOUBLE AS a, 3.0::DOUBLE AS b, {_k} + 1.0::DOUBLE AS c, 0.0::DOUBLE AS d, -1.0::DOUBLE AS e, 3.0::DOUBLE AS f, 5.0::DOUBLE AS g, NULL::DOUBLE AS h FROM region",
    ),
    "geo_diagrams": (
        f"SELECT r_regionkey, st_numgeometries(st_delaunaytriangles('MULTIPOINT ((0 0), (2 0), (2 2), (0 2.1))')) AS a, st_numgeometries(st_voronoipolygons('MULTIPOINT ((0 0), (4 0), (4 4), (0 4))')) AS b, st_isempty(st_voronoilines('MULTIPOINT ((0 0), (4 0), (4 4), (0 4))')) AS c, st_astext(st_multi({_POINT})) AS d, st_numgeometries(st_points({_LINE})) AS e FROM region",
        f"SELECT r_regionkey, 2 AS a, 4 AS b, false AS c, 'MULTIPOINT ((' || {_k} || ' 2))' AS d, 3 AS e FROM region",
    ),
    "geo_line_edits": (
        f"SELECT r_regionkey, st_astext(st_addpoint('LINESTRING (0 0, 1 1)', {_POINT})) AS a, st_astext(st_addpoint('LINESTRING (0 0, 1 1)', {_POINT}, 1)) AS b, st_astext(st_removepoint('LINESTRING (0 0, 1 1, 2 2)', 1)) AS c, st_astext(st_setpoint('LINESTRING (0 0, 1 1)', 0, {_POINT})) AS d FROM region",
        f"SELECT r_regionkey, 'LINESTRING (0 0, 1 1, ' || {_k} || ' 2)' AS a, 'LINESTRING (0 0, ' || {_k} || ' 2, 1 1)' AS b, 'LINESTRING (0 0, 2 2)' AS c, 'LINESTRING (' || {_k} || ' 2, 1 1)' AS d FROM region",
    ),
    "geo_transform": (
        f"SELECT r_regionkey, round(st_x(st_transform(st_setsrid(st_point({_K}, 0), 4326), 3857)), 4) AS a, st_srid(st_transform(st_setsrid(st_point({_K}, 0), 4326), 3857)) AS s, round(st_y(st_transform(st_transform(st_setsrid(st_point({_K}, 52), 4326), 3857), 4326)), 7) AS b, round(st_x(st_transform(st_setsrid(st_point(3, {_K}), 4326), 32631)), 3) AS c, round(st_x(st_transform(st_transform(st_setsrid(st_point({_K}, 50), 4326), 32631), 4326)), 6) AS d FROM region",
        f"SELECT r_regionkey, round(6378137 * radians({_k}), 4) AS a, 3857 AS s, 52.0::DOUBLE AS b, 500000.0::DOUBLE AS c, {_k}::DOUBLE AS d FROM region",
    ),
    "geo_aggregates": (
        "SELECT n_regionkey, st_xmin(st_extent(st_point(n_nationkey, n_regionkey))) AS w, st_xmax(st_extent(st_point(n_nationkey, n_regionkey))) AS e, st_numgeometries(st_collect(st_point(n_nationkey, 0))) AS n, st_area(st_memunion(st_makeenvelope(n_nationkey, 0, n_nationkey + 1, 1))) AS a, st_numgeometries(st_memunion(st_point(n_nationkey % 2, 0))) AS p FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, min(n_nationkey)::DOUBLE AS w, max(n_nationkey)::DOUBLE AS e, CAST(count(*) AS INTEGER) AS n, count(*)::DOUBLE AS a, CAST(count(DISTINCT n_nationkey % 2) AS INTEGER) AS p FROM nation GROUP BY n_regionkey",
    ),
    "geo_within_point_sql": (
        "SELECT c_custkey FROM customer WHERE st_within_point('POLYGON ((0 0, 100.5 0, 0 100.5, 0 0))', CAST((c_custkey * 37) % 360 AS DOUBLE) - 180.0, CAST((c_custkey * 17) % 180 AS DOUBLE) - 90.0)",
        "SELECT c_custkey FROM (SELECT c_custkey, CAST((c_custkey * 37) % 360 AS DOUBLE) - 180.0 AS lon, CAST((c_custkey * 17) % 180 AS DOUBLE) - 90.0 AS lat FROM customer) WHERE lon > 0 AND lat > 0 AND lon + lat < 100.5",
    ),
}

PAIRS = {**FUNCTIONS, **SPATIAL}
