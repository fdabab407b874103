"""The structured JSON query: {"from": .., "select": [..], "filter": .., "sort_by": .., ..} as a DataFrame.

Order of steps: scan (only the mentioned columns), project, filter, sort, distinct on, offset, limit. Filters
see the projected names only; an unknown key anywhere is an error; only scalar functions may be called.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.operators.sets import distinct_on


class QueryError(ValueError):
    pass


_BODY = {"from", "select", "query_parameters", "filter", "filters", "sort_by", "distinct", "limit", "offset", "output"}
_AGGREGATES = {"avg", "sum", "count", "min", "max", "stddev", "variance", "median", "approx_percentile_cont", "count_distinct", "first", "last", "array_agg"}
FORMATS = {
    "csv": "read_csv", "parquet": "read_parquet", "arrow": "read_arrow", "netcdf": "read_netcdf", "odv": "read_odv_ascii",
    "tiff": "read_tiff", "zarr": "read_zarr", "geoparquet": "read_geoparquet", "delta": "read_delta", "iceberg": "read_iceberg",
}


def _only(d: dict, allowed: set[str], what: str) -> None:
    if extra := set(d) - allowed:
        raise QueryError(f"{what}: unknown field {sorted(extra)[0]}")


def _mentioned(item: object) -> list[str]:
    if isinstance(item, str):
        return [item]
    if isinstance(item, dict):
        names = [item[k] for k in ("column", "column_name") if isinstance(item.get(k), str)]
        return names + [n for a in item.get("args", []) for n in _mentioned(a)]
    return []


def _expression(item: object) -> Column:
    if isinstance(item, str):
        return F.col(f"`{item}`")
    if not isinstance(item, dict):
        raise QueryError(f"select: {item!r} is no column")
    if "function" in item:
        _only(item, {"function", "args", "alias"}, "select")
        name = str(item["function"]).lower()
        if name in _AGGREGATES:
            raise QueryError(f"select: {name} is an aggregate; only scalar functions can be called")
        out = F.call_function(name, *[_expression(a) for a in item.get("args", [])])
        return out.alias(item["alias"]) if item.get("alias") else out
    if "value" in item:
        _only(item, {"value", "alias"}, "select")
        return F.lit(item["value"]).alias(item["alias"]) if item.get("alias") else F.lit(item["value"])
    _only(item, {"column", "column_name", "alias"}, "select")
    name = item.get("column", item.get("column_name"))
    if not isinstance(name, str):
        raise QueryError("select: an item needs column, function or value")
    return F.col(f"`{name}`").alias(item.get("alias") or name)


def _literal(value: object, kind: T.DataType) -> Column:
    """The value in the column's type: integers where exact, else doubles; a string that reads as a time is one."""
    if isinstance(value, bool) or value is None:
        return F.lit(value)
    if isinstance(value, int | float):
        if isinstance(kind, T.IntegralType) and float(value).is_integer():
            top = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(kind)]
            if -(2**top) <= value < 2**top:
                return F.lit(int(value)).cast(kind)
        return F.lit(float(value))
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.lit(value).cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")
    return F.lit(value)


_COMPARE = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "not_eq": lambda c, v: c != v, "not_equal": lambda c, v: c != v,
    "gt": lambda c, v: c > v, "gt_eq": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lt_eq": lambda c, v: c <= v,
}


def compile_filter(f: dict, schema: T.StructType) -> Column:
    """A filter object as a condition over the schema's columns."""
    if not isinstance(f, dict):
        raise QueryError("filter: an object is needed")
    for word, join in (("and", "__and__"), ("or", "__or__")):
        if word in f:
            _only(f, {word}, "filter")
            parts = [compile_filter(x, schema) for x in f[word]]
            out = parts[0] if parts else F.lit(word == "and")
            for p in parts[1:]:
                out = getattr(out, join)(p)
            return out
    if "not" in f:
        _only(f, {"not"}, "filter")
        return ~compile_filter(f["not"], schema)
    tests = [k for k in ("is_null", "is_not_null", "skip_fill_values", "skip_missing") if k in f]
    if tests:
        word = tests[0]
        target = f[word].get("column") if isinstance(f[word], dict) else f[word]
        col = _column(target, schema)[0]
        return col.isNull() if word == "is_null" else col.isNotNull()
    name = f.get("column", f.get("for_query_parameter", f.get("column_name")))
    kinds = {"column", "for_query_parameter", "column_name"}
    if "geometry" in f or "geojson" in f:
        _only(f, {"longitude_column", "latitude_column", "longitude_query_parameter", "latitude_query_parameter", "geometry", "geojson"}, "filter")
        from pelagia.functions.spatial import within_polygon

        lon = _column(f.get("longitude_column", f.get("longitude_query_parameter", "longitude")), schema)[0]
        lat = _column(f.get("latitude_column", f.get("latitude_query_parameter", "latitude")), schema)[0]
        shape = f.get("geometry", f.get("geojson"))
        return within_polygon(shape if isinstance(shape, str) else json.dumps(shape), lon, lat)
    col, kind = _column(name, schema)
    low = next((f[k] for k in ("gt_eq", "min", "low") if k in f), None)
    high = next((f[k] for k in ("lt_eq", "max", "high") if k in f), None)
    if "between" in f:
        low, high = f["between"]
        _only(f, kinds | {"between"}, "filter")
        return col.between(_literal(low, kind), _literal(high, kind))
    if low is not None and high is not None:
        _only(f, kinds | {"gt_eq", "lt_eq", "min", "max", "low", "high"}, "filter")
        return col.between(_literal(low, kind), _literal(high, kind))
    got = [k for k in (*_COMPARE, "min", "max") if k in f]
    if len(got) != 1:
        raise QueryError(f"filter on {name}: one comparison is needed")
    _only(f, kinds | {got[0]}, "filter")
    return _COMPARE[{"min": "gt_eq", "max": "lt_eq"}.get(got[0], got[0])](col, _literal(f[got[0]], kind))


def _column(name: object, schema: T.StructType) -> tuple[Column, T.DataType]:
    if not isinstance(name, str):
        raise QueryError("filter: a column is needed")
    if name not in schema.names:
        raise QueryError(f"filter: column {name} is not in the selected columns")
    return F.col(f"`{name}`"), schema[name].dataType


def compile_query(body: dict | str, scan: Callable[[object, list[str]], DataFrame]) -> DataFrame:
    """The DataFrame of a JSON query. scan(from, columns) gives the source: a table name, a format object, or None."""
    body = json.loads(body) if isinstance(body, str) else body
    _only(body, _BODY, "query")
    select = body.get("select", body.get("query_parameters"))
    if select is None:
        raise QueryError("query: select is required")
    df = scan(body.get("from"), [n for s in select for n in _mentioned(s)])
    df = df.select(*[_expression(s) for s in select])
    for f in [x for x in (body.get("filter"), *(body.get("filters") or [])) if x is not None]:
        df = df.filter(compile_filter(f, df.schema))
    order = []
    for s in body.get("sort_by") or []:
        if not isinstance(s, dict) or len(s) != 1 or next(iter(s)) not in ("Asc", "Desc"):
            raise QueryError('sort_by: {"Asc": column} or {"Desc": column} is needed')
        way, name = next(iter(s.items()))
        col = _column(name, df.schema)[0]
        order.append(col.asc_nulls_last() if way == "Asc" else col.desc_nulls_last())
    if body.get("distinct"):
        d = body["distinct"]
        _only(d, {"on", "select"}, "distinct")
        keys = [_expression(x) for x in d["on"]]
        df = distinct_on(df, keys, order)
        if d.get("select"):
            df = df.select(*[_expression(x) for x in d["select"]])
            order = []
    if order:
        df = df.orderBy(*order)
    if body.get("offset"):
        df = df.offset(int(body["offset"]))
    if body.get("limit") is not None:
        df = df.limit(int(body["limit"]))
    return df
