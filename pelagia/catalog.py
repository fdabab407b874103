"""The persistent catalog: external tables, managed tables, views, materialized views, presets, crawlers.

Definitions live in one JSON file; managed tables and materialized views are Parquet folders to which a definition
points: a rewrite makes a new one, an insert adds one. A change writes the new folder first and then replaces the definitions file
atomically, so a reader sees a whole version, old or new. Old versions stay until vacuum().
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.operators.sets import conform
from pelagia.sources import readers
from pelagia.types import arrow_to_spark


class CatalogError(ValueError):
    pass


_SQL_TYPES = {
    "BIGINT": "bigint", "INT": "int", "INTEGER": "int", "SMALLINT": "smallint", "TINYINT": "tinyint", "DOUBLE": "double", "FLOAT": "float",
    "REAL": "float", "VARCHAR": "string", "TEXT": "string", "STRING": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
    "VARBINARY": "binary", "BYTEA": "binary", "BINARY": "binary",
}


def sql_type(name: str) -> T.DataType:
    """A type as DDL writes it."""
    base = name.upper().split("(")[0].strip()
    text = _SQL_TYPES.get(base, None)
    if base in ("DECIMAL", "NUMERIC"):
        text = name.lower().replace("numeric", "decimal")
    with suppress(ValueError):
        text = text or arrow_to_spark(name)
    return T._parse_datatype_string(text or name.lower())


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        os.makedirs(self.root, exist_ok=True)
        self.file = f"{self.root}/catalog.json"
        self.entries: dict[str, dict] = {}
        if os.path.exists(self.file):
            with open(self.file) as f:
                self.entries = json.load(f)
        for name in self.entries:
            self._publish(name)

    def _save(self) -> None:
        temp = f"{self.file}.{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump(self.entries, f, indent=1, sort_keys=True)
        os.replace(temp, self.file)

    # ---------------------------------------------------------------- reading
    def kind(self, name: str) -> str | None:
        return self.entries.get(name, {}).get("kind")

    def get(self, name: str) -> dict:
        if name not in self.entries:
            raise CatalogError(f"table {name} does not exist")
        return self.entries[name]

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        e = self.get(name)
        if e["kind"] in ("managed", "mview"):
            return self.spark.read.schema(T.StructType.fromJson(e["schema"])).parquet(*e["paths"])
        if e["kind"] == "view":
            return self.run(e["sql"])
        return self.external(e, columns)

    run = None  # set by the connection: SQL text to DataFrame

    def external(self, e: dict, columns: list[str] | None = None) -> DataFrame:
        fmt, where, opts = e["format"], e["location"], e.get("options", {})
        name = {"parquet": "read_parquet", "csv": "read_csv", "arrow": "read_arrow", "ipc": "read_arrow", "odv": "read_odv_ascii", "netcdf": "read_netcdf", "hdf5": "read_hdf5", "zarr": "read_zarr", "tiff": "read_tiff", "geotiff": "read_tiff", "geoparquet": "read_geoparquet", "delta": "read_delta", "iceberg": "read_iceberg"}.get(fmt)
        if fmt in ("postgres", "mysql"):
            known = {"postgres": "postgresql", "mysql": "mysql"}[fmt]
            url = opts.get("url") or f"jdbc:{known}://{opts['host']}:{opts.get('port', {'postgres': 5432, 'mysql': 3306}[fmt])}/{opts['database']}"
            return self.spark.read.format("jdbc").options(url=url, dbtable=opts.get("table", where), user=opts.get("user", ""), password=opts.get("password", "")).load()
        if name is None:
            raise CatalogError(f"format {fmt} is not supported")
        if e.get("partitions"):
            reader = self.spark.read.option("basePath", where)
            if fmt == "parquet":
                return reader.parquet(where)
            if fmt == "csv":
                return reader.csv(where, header=True, inferSchema=True, sep=opts.get("delimiter", ","))
            raise CatalogError(f"PARTITIONED BY is not supported for {fmt}")
        args: list = [where]
        if fmt == "csv" and opts.get("delimiter"):
            args.append(opts["delimiter"])
        return readers.call(self.spark, name, args, columns)

    def _publish(self, name: str) -> None:
        """Makes the table visible to Spark SQL; formats whose rows depend on the columns are resolved by the front end."""
        e = self.entries[name]
        if e["kind"] in ("managed", "mview") or e["kind"] == "external" and e["format"] in ("parquet", "csv", "arrow", "ipc", "delta", "iceberg", "geoparquet"):
            with suppress(FileNotFoundError):
                self.table(name).createOrReplaceTempView(f"`{name}`")

    # ---------------------------------------------------------------- defining
    def _check(self, name: str, replace: bool, if_not_exists: bool) -> bool:
        if name.startswith("__"):
            raise CatalogError(f"{name}: names that start with two underscores are internal")
        if name in self.entries and not replace:
            if if_not_exists:
                return False
            raise CatalogError(f"table {name} already exists")
        return True

    def define(self, name: str, entry: dict, replace: bool = False, if_not_exists: bool = False) -> bool:
        if not self._check(name, replace, if_not_exists):
            return False
        self.entries[name] = entry
        self._save()
        self._publish(name)
        return True

    def _version(self, name: str, df: DataFrame) -> str:
        path = f"{self.root}/data/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def create_managed(self, name: str, schema: T.StructType, df: DataFrame | None = None, replace: bool = False, if_not_exists: bool = False) -> bool:
        if not self._check(name, replace, if_not_exists):
            return False
        df = self.spark.createDataFrame([], schema) if df is None else df
        return self.define(name, {"kind": "managed", "paths": [self._version(name, df)], "schema": schema.jsonValue(), "indexes": []}, True)

    def create_view(self, name: str, sql: str, replace: bool = False) -> None:
        self.define(name, {"kind": "view", "sql": sql}, replace)

    def create_materialized(self, name: str, sql: str, replace: bool = False, if_not_exists: bool = False) -> bool:
        if not self._check(name, replace, if_not_exists):
            return False
        df = self.run(sql)
        return self.define(name, {"kind": "mview", "sql": sql, "paths": [self._version(name, df)], "schema": df.schema.jsonValue()}, True)

    def refresh(self, name: str) -> None:
        e = self.get(name)
        if e["kind"] != "mview":
            raise CatalogError(f"{name} is no materialized view")
        df = self.run(e["sql"])
        self.entries[name] = {**e, "paths": [self._version(name, df)], "schema": df.schema.jsonValue()}
        self._save()
        self._publish(name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.entries:
            if if_exists:
                return
            raise CatalogError(f"table {name} does not exist")
        e = self.entries.pop(name)
        self._save()
        self.spark.catalog.dropTempView(name)
        if e["kind"] in ("managed", "mview"):
            shutil.rmtree(f"{self.root}/data/{name}", ignore_errors=True)

    # ---------------------------------------------------------------- changing managed tables
    def _managed(self, name: str) -> dict:
        e = self.get(name)
        if e["kind"] != "managed":
            raise CatalogError(f"{name} is not a managed table; only those can be changed")
        return e

    def replace(self, name: str, df: DataFrame, schema: T.StructType | None = None) -> None:
        """A new version with these rows, then the pointer moves."""
        e = self._managed(name)
        schema = schema or T.StructType.fromJson(e["schema"])
        path = self._version(name, conform(df, schema))
        self.entries[name] = {**e, "paths": [path], "schema": schema.jsonValue()}
        self._save()
        self._publish(name)

    def insert(self, name: str, df: DataFrame, columns: list[str] | None = None) -> int:
        """Appends rows by position (or to the named columns) as one more folder of the version; returns their number."""
        e = self._managed(name)
        schema = T.StructType.fromJson(e["schema"])
        target = columns or schema.names
        if len(target) != len(df.columns):
            raise CatalogError(f"INSERT: {len(df.columns)} values for {len(target)} columns")
        path = self._version(name, conform(df.toDF(*target), schema))
        count = self.spark.read.schema(schema).parquet(path).count()  # from the footers
        self.entries[name] = {**e, "paths": [*e["paths"], path]}
        self._save()
        self._publish(name)
        return count

    def delete(self, name: str, condition: str | None) -> None:
        """Rows for which the condition is not true stay (null included, as in standard SQL)."""
        df = self.table(name)
        self.replace(name, df.limit(0) if condition is None else df.filter(~F.coalesce(F.expr(condition), F.lit(False))))

    def update(self, name: str, changes: dict[str, str], condition: str | None) -> None:
        df = self.table(name)
        unknown = set(changes) - set(df.columns)
        if unknown:
            raise CatalogError(f"UPDATE: column {sorted(unknown)[0]} does not exist")
        hit = F.lit(True) if condition is None else F.coalesce(F.expr(condition), F.lit(False))
        cols = [F.when(hit, F.expr(changes[c]).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in df.columns]
        self.replace(name, df.select(*cols))

    def alter(self, name: str, change: str, column: str, value: str | None = None) -> None:
        """change: add, drop, rename, type."""
        df = self.table(name)
        if change != "add" and column not in df.columns:
            raise CatalogError(f"ALTER TABLE: column {column} does not exist")
        if change == "add":
            if column in df.columns:
                raise CatalogError(f"ALTER TABLE: column {column} already exists")
            df = df.withColumn(column, F.lit(None).cast(sql_type(value)))
        elif change == "drop":
            df = df.drop(column)
        elif change == "rename":
            df = df.withColumnRenamed(column, value)
        else:
            df = df.withColumn(column, F.col(f"`{column}`").cast(sql_type(value)))
        self.replace(name, df, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]))

    def vacuum(self) -> int:
        """Deletes versions that no definition points to; returns how many."""
        live, gone = {p for e in self.entries.values() for p in e.get("paths", [])}, 0
        base = f"{self.root}/data"
        for name in os.listdir(base) if os.path.isdir(base) else []:
            for v in os.listdir(f"{base}/{name}"):
                if f"{base}/{name}/{v}" not in live:
                    shutil.rmtree(f"{base}/{name}/{v}")
                    gone += 1
        return gone
