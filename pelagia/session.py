"""connect(): the public entry point. SQL in the engine's dialect, JSON queries, readers, tables, statements."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia import stats
from pelagia.catalog import Catalog
from pelagia.functions import scalar, spatial
from pelagia.operators.sets import union_by_name
from pelagia.operators.summarize import summarize
from pelagia.plans import jsonquery
from pelagia.plans.dialect import Rewriter
from pelagia.plans.division import divisions
from pelagia.sources import readers, sinks

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A Spark session with the engine's settings (identifiers are case-sensitive, times are without zone)."""
    b = SparkSession.builder
    if master:
        b = b.master(master)
    for k, v in {**CONF, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_views = itertools.count()


class _Functions:
    """What the rewriter asks about table functions."""

    def __init__(self, con: Connection):
        self.con = con

    def knows(self, name: str) -> bool:
        base = name.removesuffix("_schema")
        return base in readers.READERS or name in stats.FUNCTIONS

    def table(self, name: str, bounds: dict) -> DataFrame | None:
        """An external Parquet table without the files that stored statistics rule out; None where that is not the case."""
        e = self.con.catalog.entries.get(name)
        if not e or e["kind"] != "external" or e["format"] != "parquet" or e.get("partitions") or not stats.known(self.con):
            return None
        return self._pruned([e["location"]], bounds)

    def _pruned(self, args: list, bounds: dict) -> DataFrame | None:
        files = readers.expand(self.con.spark, args[0])
        left = stats.prune(self.con, files, bounds)
        if len(left) == len(files):
            return None
        whole = readers.call(self.con.spark, "read_parquet", [args[0]])
        if not left:
            return whole.limit(0)
        some = readers.call(self.con.spark, "read_parquet", [left])
        gone = [c for c in whole.columns if c not in some.columns]
        return some.select(*[(F.lit(None) if f.name in gone else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in whole.schema.fields])

    def __call__(self, name: str, args: list, columns: list[str] | None, bounds: dict | None = None) -> DataFrame:
        if name in stats.FUNCTIONS:
            return stats.FUNCTIONS[name](self.con, *args)
        base = name.removesuffix("_schema")
        if args and isinstance(args[0], str | list):
            args = [self.con.paths(args[0]), *args[1:]]
        if base != name:
            return readers.schema_table(self.con.spark, readers.call(self.con.spark, base, args))
        if name == "read_parquet" and bounds and len(args) == 1 and stats.known(self.con):
            pruned = self._pruned(args, bounds)
            if pruned is not None:
                return pruned
        return readers.call(self.con.spark, name, args, columns)


class Relation:
    """A lazy query result: a DataFrame with the engine's sinks."""

    def __init__(self, con: Connection, df: DataFrame):
        self.con, self.df = con, df

    columns = property(lambda self: self.df.columns)
    types = property(lambda self: [t for _, t in self.df.dtypes])

    def filter(self, condition: str) -> Relation:
        return Relation(self.con, self.df.filter(self.con.rewriter(condition)))

    def select(self, *exprs: str) -> Relation:
        return Relation(self.con, self.df.selectExpr(*exprs))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation(self.con, self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def order(self, *exprs: str) -> Relation:
        self.df.createOrReplaceTempView(name := f"__r{next(_views)}")
        return self.con.sql(f"SELECT * FROM {name} ORDER BY {', '.join(exprs)}")

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self.df.collect()]

    def fetchone(self) -> tuple | None:
        r = self.df.first()
        return None if r is None else tuple(r)

    def batches(self):
        return self.df.toLocalIterator(prefetchPartitions=True)

    def arrow(self):
        return self.df.toArrow()

    def pandas(self):
        return self.df.toPandas()

    def explain(self, mode: str = "formatted") -> str:
        return self.df._sc._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), mode)

    def to_parquet(self, path: str, **o) -> None:
        sinks.to_parquet(self.df, path, **o)

    def to_csv(self, path: str, **o) -> None:
        sinks.to_csv(self.df, path, **o)

    def to_ipc(self, path: str, **o) -> None:
        sinks.to_ipc(self.df, path, **o)

    def to_netcdf(self, path: str, **o) -> None:
        sinks.to_netcdf(self.df, path, **o)

    def to_nd_netcdf(self, path: str, dimension_columns: list[str], **o) -> None:
        sinks.to_nd_netcdf(self.df, path, dimension_columns, **o)

    def to_geoparquet(self, path: str, **o) -> None:
        sinks.to_geoparquet(self.df, path, **o)

    def to_odv(self, path: str, **o) -> None:
        sinks.to_odv(self.df, path, **o)


class Connection:
    """root: folder of the catalog. datasets: folder to which relative paths of readers belong."""

    def __init__(self, spark: SparkSession, root: str | None = None, datasets: str | None = None, user: str | None = None):
        from pelagia.auth import Authority

        self.spark = spark
        self.root = root or tempfile.mkdtemp(prefix="pelagia-catalog-")
        self.datasets = datasets
        self.rewriter = Rewriter(
            lambda sql: self._plain(divisions(self._named(sql), self.spark, self._plain)), _Functions(self), self._view, union_by_name, lambda fn, source, *more: spatial.cluster_over(self.sql(source).df, fn, *more)
        )
        self.catalog = Catalog(spark, self.root)
        self.catalog.run = lambda sql: self.sql(sql).df
        self.authority = Authority(f"{self.root}/auth.json")
        self.user = user
        self.metrics: list[dict] = []
        self.default_table: str | None = None
        spark.conf.set("spark.sql.timeType.enabled", "true")
        scalar.register(spark)

    # ---------------------------------------------------------------- helpers
    def paths(self, where: str | Sequence[str]) -> str | list[str]:
        if isinstance(where, str):
            where = where if "://" in where or where.startswith("/") or not self.datasets else f"{self.datasets.rstrip('/')}/{where}"
            if self.user is not None:
                self.authority.check_path(self.user, where)
            return where
        return [self.paths(w) for w in where]

    def _view(self, df: DataFrame) -> str:
        name = f"__v{next(_views)}"
        df.createOrReplaceTempView(name)
        return name

    def _plain(self, sql: str, args: list | None = None) -> DataFrame:
        return self.spark.sql(sql, args={f"p{i + 1}": v for i, v in enumerate(args)}) if args else self.spark.sql(sql)

    def rewrite(self, sql: str) -> str:
        return self._named(self.rewriter(sql))

    def _named(self, text: str) -> str:
        from pelagia.plans.names import functions, tables

        return tables(functions(text, lambda: spatial.register(self.spark), self.spark), self)

    # ---------------------------------------------------------------- queries
    def sql(self, sql: str, parameters: list | None = None) -> Relation:
        """A query or statement; $1, $2, .. take the parameters."""
        import time

        from pelagia.plans.statements import statement

        began = time.time()
        done = statement(self, sql)
        if done is None:
            text = self.rewrite(sql)
            if self.user is not None:
                self.authority.check_query(self, sql)
            done = self._plain(divisions(text, self.spark, lambda t: self._plain(t, parameters)), parameters)
        self.metrics.append({"sql": sql, "seconds": time.time() - began})
        return Relation(self, done)

    execute = sql

    def json_query(self, body: dict | str) -> Relation:
        def scan(source, columns: list[str]) -> DataFrame:
            if source is None:
                source = self.default_table
            if source is None:
                raise jsonquery.QueryError("query: from is required, as there is no default table")
            if isinstance(source, str):
                return self.table(source, columns).df
            if "format" in source and isinstance(source["format"], dict):
                source = source["format"]
            (fmt, conf), *rest = source.items()
            if rest or fmt not in jsonquery.FORMATS:
                raise jsonquery.QueryError(f"from: unknown format {fmt}")
            args: list = [self.paths(conf["paths"])]
            if fmt == "csv" and conf.get("delimiter"):
                args.append(conf["delimiter"])
            df = readers.call(self.spark, jsonquery.FORMATS[fmt], args, columns)
            return df

        body = dict(body) if isinstance(body, dict) else body
        out = jsonquery.compile_query(body, scan)
        return Relation(self, out)

    def query_to_file(self, query: dict | str, path: str, fmt: str, **options) -> None:
        r = self.json_query(query) if isinstance(query, dict) else self.sql(query)
        sinks.write(r.df, path, fmt, **options)

    def table(self, name: str, columns: list[str] | None = None) -> Relation:
        if name in self.catalog.entries:
            if self.user is not None:
                self.authority.check_table(self.user, name)
            return Relation(self, self.catalog.table(name, columns))
        return Relation(self, self.spark.table(f"`{name}`"))

    def register(self, name: str, data) -> None:
        """A pandas or Arrow table, a list of dicts, or a DataFrame, as a temporary view."""
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        df.createOrReplaceTempView(f"`{name}`")

    def append(self, name: str, data) -> int:
        df = data if isinstance(data, DataFrame) else self.spark.createDataFrame(data)
        return self.catalog.insert(name, df)

    def summarize(self, what: str) -> Relation:
        return Relation(self, summarize(self.table(what).df if what.isidentifier() else self.sql(what).df))

    def preset(self, name: str, **values) -> Relation:
        """The table through its preset: only the listed filters, with these values."""
        from pelagia import presets

        return Relation(self, presets.apply(self.table(name).df, self.catalog.get(name).get("preset"), values))


def _reader(name: str):
    def read(self: Connection, paths, *args, **kw) -> Relation:
        df = getattr(readers, name)(self.spark, self.paths(paths), *args, **kw)
        return Relation(self, df)

    read.__name__ = name
    return read


for _name in readers.READERS:
    setattr(Connection, _name, _reader(_name))


def connect(spark: SparkSession | None = None, root: str | None = None, datasets: str | None = None, user: str | None = None) -> Connection:
    return Connection(spark or session(), root, datasets, user)
