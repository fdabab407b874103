"""System tables: information_schema and system, as snapshots of the catalog and the stores beside it."""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import DataFrame

from pelagia import stats
from pelagia.catalog import CatalogError
from pelagia.types import spark_to_arrow

_KINDS = {"external": "EXTERNAL", "managed": "BASE TABLE", "view": "VIEW", "mview": "MATERIALIZED VIEW"}


def _visible(con) -> list[tuple[str, dict]]:
    found = [(n, e) for n, e in sorted(con.catalog.entries.items()) if e["kind"] in _KINDS]
    return [(n, e) for n, e in found if con.user is None or con.authority.allowed(con.user, "SELECT", "TABLE", n)]


def tables(con) -> DataFrame:
    rows = [("pelagia", "public", n, _KINDS[e["kind"]]) for n, e in _visible(con)]
    return con.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(con) -> DataFrame:
    rows = []
    for n, _ in _visible(con):
        with suppress(FileNotFoundError, CatalogError):
            for i, f in enumerate(con.catalog.table(n).schema.fields, 1):
                rows.append(("pelagia", "public", n, f.name, i, "YES" if f.nullable else "NO", spark_to_arrow(f.dataType)))
    return con.spark.createDataFrame(
        rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string"
    )


def _admin(con) -> None:
    if con.user is not None and not con.authority.state["users"].get(con.user, {}).get("admin"):
        from pelagia.auth import AccessError

        raise AccessError(f"{con.user} is no administrator")


def users(con) -> DataFrame:
    _admin(con)
    return con.spark.createDataFrame([(n, u["roles"], u["admin"]) for n, u in sorted(con.authority.state["users"].items())], "user_name string, roles array<string>, is_admin boolean")


def roles(con) -> DataFrame:
    _admin(con)
    return con.spark.createDataFrame([(n, [" ".join(x) for x in r["rules"]]) for n, r in sorted(con.authority.state["roles"].items())], "role_name string, rules array<string>")


TABLES = {
    ("information_schema", "tables"): tables, ("information_schema", "columns"): columns, ("system", "users"): users, ("system", "roles"): roles,
    ("system", "query_metrics"): stats.query_metrics, ("system", "file_stats"): stats.stored,
}
