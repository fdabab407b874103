"""File statistics: collected by ANALYZE FILES, kept as Parquet, used to leave files out before they are listed."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.sources import readers
from pelagia.types import spark_to_arrow

SCHEMA = (
    "path string, size long, modified timestamp, column_name string, data_type string, min string, max string, null_count long, "
    "row_count long, lo double, hi double"
)


def _store(con) -> str:
    return f"{con.root}/file_stats"


def _footer_rows(path: str, f) -> list[tuple]:
    """One row for each column of a Parquet file, from its footer."""
    import datetime as dt

    import pyarrow.parquet as pq

    def number(v) -> float | None:
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=v.tzinfo or dt.UTC).timestamp()
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None

    file = pq.ParquetFile(f)
    meta, arrow, rows = file.metadata, file.schema_arrow, []
    for i in range(meta.num_columns):
        name = meta.schema.column(i).path
        low = high = None
        nulls, known = 0, True
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(i).statistics
            if s is None or not s.has_min_max:
                known = known and s is not None and s.null_count == meta.row_group(g).num_rows
                nulls += s.null_count if s is not None and s.has_null_count else 0
                continue
            low = s.min if low is None else min(low, s.min)
            high = s.max if high is None else max(high, s.max)
            nulls += s.null_count or 0
        if not known:
            low = high = None
        kind = str(arrow.field(name).type) if name in arrow.names else str(meta.schema.column(i).physical_type)
        text = [None if v is None else str(v) for v in (low, high)]
        rows.append((path, name, kind, *text, nulls, meta.num_rows, number(low), number(high)))
    return rows


def _footers(con, files: list[str]) -> DataFrame:
    """One row for each file and column, with the file's size and time."""
    kinds = "path string, column_name string, data_type string, min string, max string, null_count long, row_count long, lo double, hi double"
    marks = con.spark.read.format("binaryFile").load(files).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    norm = F.regexp_replace("path", "^file:/+", "file:/")
    rows = readers.of_footers(con.spark, files, _footer_rows, kinds).withColumn("path", norm)
    return rows.join(marks.withColumn("path", norm), "path").select(*[c.split()[0] for c in SCHEMA.split(", ")])


def _norm(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def stored(con) -> DataFrame:
    if not os.path.isdir(_store(con)):
        return con.spark.createDataFrame([], SCHEMA)
    return con.spark.read.schema(SCHEMA).parquet(_store(con))


def known(con) -> bool:
    """Whether any statistics are stored."""
    return os.path.isdir(_store(con))


def analyze(con, prefix: str | None = None, force: bool = False) -> DataFrame:
    """Collects statistics of Parquet files below a prefix that are new or changed; counts of what was done."""
    where = con.paths(prefix or (con.datasets or con.root))
    files = [f for f in readers.expand_all(con.spark, where) if f.endswith(".parquet") and "/_" not in f and f"{con.root}/file_stats" not in f]
    known = {r[0]: (r[1], r[2]) for r in stored(con).select("path", "size", "modified").distinct().collect()}
    now = {_norm(r[0]): (r[1], r[2]) for r in con.spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime").collect()} if files else {}
    todo = sorted(f for f, mark in now.items() if force or known.get(f) != mark)
    if todo:
        fresh = _footers(con, todo)
        keep = stored(con).join(F.broadcast(con.spark.createDataFrame([(f,) for f in todo], "path string")), "path", "left_anti")
        temp, old = f"{_store(con)}.new", f"{_store(con)}.old"
        keep.unionByName(fresh).coalesce(4).write.mode("overwrite").parquet(temp)
        import shutil

        shutil.rmtree(old, ignore_errors=True)
        if os.path.isdir(_store(con)):  # what was is there until the new store has its name
            os.rename(_store(con), old)
        os.rename(temp, _store(con))
        shutil.rmtree(old, ignore_errors=True)
    row = (len(files), len([f for f in todo if f in known]), len(todo), 0, 1 if todo else 0, 0)
    return con.spark.createDataFrame([row], "discovered long, requeued long, analyzed long, failed long, segments long, pending long")


def prune(con, files: list[str], bounds: dict[str, tuple[float | None, float | None]]) -> list[str]:
    """Files that may hold rows with every column inside its (low, high); files without statistics stay."""
    out = set()
    short = {_norm(f): f for f in files}
    s = stored(con).join(F.broadcast(con.spark.createDataFrame([(f,) for f in short], "path string")), "path", "left_semi")
    for column, (low, high) in bounds.items():
        miss = F.lit(False)
        if low is not None:
            miss = miss | (F.col("hi") < float(low))
        if high is not None:
            miss = miss | (F.col("lo") > float(high))
        out |= {r[0] for r in s.filter((F.col("column_name") == column) & miss).select("path").collect()}
    return [f for k, f in short.items() if k not in out]


def read_pruned(con, paths, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """A Parquet scan of the files that statistics leave, with the range filters applied again above it."""
    files = readers.expand(con.spark, con.paths(paths))
    left = prune(con, files, bounds)
    df = con.spark.read.parquet(*left) if left else con.spark.read.parquet(files[0]).limit(0)
    for column, (low, high) in bounds.items():
        if low is not None:
            df = df.filter(F.col(column) >= low)
        if high is not None:
            df = df.filter(F.col(column) <= high)
    return df


# ------------------------------------------------------------------ table functions
_FORMATS = {"parquet": "parquet", "csv": "csv", "arrow": "arrow", "ipc": "arrow", "feather": "arrow", "nc": "netcdf", "h5": "hdf5", "hdf5": "hdf5", "tif": "tiff", "tiff": "tiff", "txt": "odv", "json": "json"}


def list_datasets(con, pattern: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Files of the datasets folder: file_path, format, size, modified; by path."""
    base = con.datasets or con.root
    fs, p = readers._hadoop(con.spark, base)
    it, rows = fs.listFiles(p, True), []
    root = fs.makeQualified(p).toString().rstrip("/") + "/"
    while it.hasNext():
        s = it.next()
        name = s.getPath().toString().removeprefix(root)
        if name.rsplit("/", 1)[-1].startswith((".", "_")) or pattern and not fnmatch.fnmatch(name, pattern):
            continue
        rows.append((name, _FORMATS.get(name.rsplit(".", 1)[-1].lower(), "unknown"), s.getLen(), s.getModificationTime()))
    rows.sort()
    rows = rows[offset : None if limit is None else offset + limit]
    df = con.spark.createDataFrame(rows, "file_path string, file_format string, size long, modified_ms long")
    return df.select("file_path", "file_format", "size", F.timestamp_millis("modified_ms").cast("timestamp_ntz").alias("last_modified"))


def _column_statistics(con, df: DataFrame, extra: list | None = None) -> DataFrame:
    ordered = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    fields = [f for f in df.schema.fields]
    aggs = []
    for i, f in enumerate(fields):
        for name in ("min", "max"):
            c = getattr(F, name)(F.col(f"`{f.name}`")).cast("string") if isinstance(f.dataType, ordered) else F.lit(None).cast("string")
            aggs.append(c.alias(f"{name}{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (extra or [])], F.lit(f.name).alias("column_name"), F.lit(spark_to_arrow(f.dataType)).alias("data_type"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.lit(True).alias("is_exact")) for i, f in enumerate(fields)])
    return one.select(F.inline(rows))


def view_dataset_statistics(con, path: str) -> DataFrame:
    name = {"csv": "read_csv", "nc": "read_netcdf", "h5": "read_hdf5", "hdf5": "read_hdf5", "arrow": "read_arrow", "tif": "read_tiff", "txt": "read_odv_ascii"}.get(path.rsplit(".", 1)[-1].lower(), "read_parquet")
    return _column_statistics(con, readers.call(con.spark, name, [con.paths(path)]))


def view_external_table_statistics(con, table: str) -> DataFrame:
    e = con.catalog.get(table)
    out = None
    for f in readers.expand(con.spark, e["location"]):
        df = con.catalog.external({**e, "location": f, "partitions": []})
        one = _column_statistics(con, df, [("path", f)])
        out = one if out is None else out.unionByName(one)
    return out


def view_statistics_cache(con) -> DataFrame:
    return stored(con).select("path", "column_name", "data_type", "min", "max", F.lit(True).alias("is_exact"), F.lit(True).alias("is_valid"))


def file_statistics(con, pattern: str) -> DataFrame:
    """Stored statistics of at most 1000 files that match."""
    files = readers.expand(con.spark, con.paths(pattern))
    if len(files) > 1000:
        raise ValueError("file_statistics: at most 1000 files")
    return stored(con).filter(F.col("path").isin([_norm(f) for f in files])).select("path", F.col("column_name").alias("column"), "data_type", "min", "max", "null_count", "row_count", F.lit(0).alias("segment"))


def query_metrics(con) -> DataFrame:
    return con.spark.createDataFrame([(m["sql"], m["seconds"]) for m in con.metrics], "sql string, seconds double")


FUNCTIONS = {
    "list_datasets": list_datasets, "view_dataset_statistics": view_dataset_statistics, "view_external_table_statistics": view_external_table_statistics,
    "view_statistics_cache": view_statistics_cache, "file_statistics": file_statistics, "query_metrics": query_metrics,
}
