"""Table functions read_x(..) as DataFrames.

Parquet and CSV are plain Spark scans (pruning and pushdown work); files whose schemas differ are read in groups
of one schema, widened by name. Delta and Iceberg tables are resolved to their active Parquet files. Other formats
are read through the binaryFile source, a file a row, and parsed into Arrow batches on the executors, so any file
system that Spark reaches will do; their schemas come from the same parser, run once for each file and merged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from pelagia import nd
from pelagia.operators.sets import conform
from pelagia.sources import formats, hdf5, zarr
from pelagia.types import merge_schemas, spark_to_arrow

READERS = (
    "read_parquet", "read_geoparquet", "read_arrow", "read_csv", "read_odv_ascii", "read_netcdf", "read_hdf5", "read_zarr", "read_tiff",
    "read_delta", "read_iceberg",
)


def as_list(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def expand(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Files that match globs (`**` for any depth), through Hadoop's file system, sorted; no match is an error."""
    out: list[str] = []
    for path in as_list(paths):
        deep = "**" in path
        fs, p = _hadoop(spark, path.split("**")[0].rstrip("/") or "/" if deep else path)
        found = []
        if deep:
            it = fs.listFiles(p, True)
            rest = path.split("**", 1)[1].lstrip("/") or "*"
            want = re.compile("(.*/)?" + re.escape(rest).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$")
            while it.hasNext():
                name = it.next().getPath().toString()
                if want.match(name):
                    found.append(name)
        else:
            for s in fs.globStatus(p) or []:
                if s.isDirectory():
                    it = fs.listFiles(s.getPath(), True)
                    while it.hasNext():
                        found.append(it.next().getPath().toString())
                else:
                    found.append(s.getPath().toString())
        out += [f for f in found if not f.rsplit("/", 1)[-1].startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(f"no file matches {paths}")
    return sorted(dict.fromkeys(out))


def read_text(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _merged(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Frames of one schema each, widened by name; where all agree this is the first frame's plan."""
    schema = merge_schemas([(name, df.schema) for name, df in frames])
    out = None
    for _, df in frames:
        df = conform(df, schema)
        out = df if out is None else out.unionByName(df)
    return out


def read_parquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files grouped by schema (from the footers); one group is one scan."""
    files = expand(spark, paths)
    if len(files) == 1:
        return spark.read.parquet(*as_list(paths))
    schemas = _footers(spark, files)
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(schemas[f], []).append(f)
    return _merged([(fs[0], spark.read.parquet(*fs)) for fs in groups.values()])


def _footers(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Schema text of each Parquet file; many files are inspected on the executors, footers only."""
    if len(files) <= 16:
        return {f: spark.read.parquet(f).schema.json() for f in files}

    def schemas(path: str, f) -> list[tuple]:
        import pyarrow.parquet as pq

        return [(path, from_arrow_schema(pq.read_schema(f), True).json())]

    got = dict(map(tuple, of_footers(spark, files, schemas, "path string, schema string").collect()))
    return {f: got[f] for f in files}


def of_footers(spark: SparkSession, files: list[str], fn, schema: str) -> DataFrame:
    """Rows of fn(path, open file) for each Parquet file, on the executors. Only footers are read where Arrow knows the
    store; files of other stores come whole through Spark's reader."""
    names = [c.split()[0] for c in schema.split(", ")]

    def known(path: str) -> bool:
        return path.startswith(("file:", "/", "s3://", "s3a://", "gs://", "hdfs://"))

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            rows: list[tuple] = []
            for path in b.column("path").to_pylist():
                if path.startswith(("file:", "/")):
                    store, name = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
                else:
                    store, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                with store.open_input_file(name) as f:
                    rows += fn(path, f)
            yield batch(rows)

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield batch(fn(path, pa.BufferReader(content)))

    out = None
    for take, run, cols in ((True, near, ["path"]), (False, far, ["path", "content"])):
        mine = [f for f in files if known(f) == take]
        if mine:
            if take:
                n = min(len(mine), 4 * spark.sparkContext.defaultParallelism)
                df = spark.createDataFrame([(f,) for f in mine], "path string").repartition(n)
            else:
                df = spark.read.format("binaryFile").load(mine).select(*cols)
            df = df.mapInArrow(run, schema)
            out = df if out is None else out.unionByName(df)
    return out


def read_csv(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", infer_records: int | None = None) -> DataFrame:
    """Header required. Types come from whole files (a late string widens its column); infer_records is accepted.

    Files take one job for their headers, one for the types in each, and one scan for each different header."""
    del infer_records
    files = expand(spark, paths)
    options = {"header": True, "sep": delimiter, "enforceSchema": False, "encoding": "UTF-8"}

    def head(path: str, f) -> list[tuple]:
        if codec := {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}.get(path[path.rfind(".") :]):
            f = pa.CompressedInputStream(f, codec)
        return [(path, f.read(1 << 20).split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig", "replace"))]

    groups: dict[str, list[str]] = {}
    for f, line in sorted(map(tuple, of_footers(spark, files, head, "path string, head string").collect())):
        groups.setdefault(line, []).append(f)
    scans, schemas = [], {}
    for fs in groups.values():
        names = spark.read.csv(fs[0], **options).columns
        scans.append((fs, names))
        schemas |= _csv_types(spark, fs, names, options)
    merged = merge_schemas([(f, schemas[f]) for f in files])
    merged = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for f in merged.fields])
    out = None
    for fs, names in scans:
        df = conform(spark.read.csv(fs, schema=T.StructType([merged[n] for n in names]), **options), merged)
        out = df if out is None else out.unionByName(df)
    return out


def _csv_types(spark: SparkSession, files: list[str], names: list[str], options: dict) -> dict[str, T.StructType]:
    """Of each file (all with these columns), the narrowest types that hold every value; columns without values are null."""
    if not names:  # empty files
        return {f: T.StructType([]) for f in files}
    df = spark.read.csv(files, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]), **options)
    tests = (
        ("int", lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("int").isNotNull()),
        ("bigint", lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()),
        ("decimal", lambda c: c.rlike(r"^[+-]?0*\d{1,38}$")),
        ("double", lambda c: c.try_cast("double").isNotNull()),
        ("date", lambda c: c.rlike(r"^\d{4}-\d\d-\d\d$") & c.try_cast("date").isNotNull()),
        ("timestamp", lambda c: c.rlike(r"^\d{4}-\d\d") & c.try_cast("timestamp").isNotNull()),
        ("boolean", lambda c: F.lower(c).isin("true", "false")),
    )
    # nulls take no part; every() of nothing is null: the column has no value
    held = lambda c, fits: F.every(F.when(c.isNotNull(), fits(c)))
    digits = lambda c: F.max(F.length(F.regexp_replace(c, r"^[+-]?0*", ""))).alias("digits")
    aggs = [F.struct(*[held(F.col(f"`{n}`"), fits).alias(kind) for kind, fits in tests], digits(F.col(f"`{n}`"))).alias(f"c{i}") for i, n in enumerate(names)]
    plain = lambda path: re.sub(r"^(\w+):/+", r"\1:/", unquote(path))
    found = {plain(r["path"]): r for r in df.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggs).collect()}
    out = {}
    for f in files:
        fields, row = [], found.get(plain(f))
        for i, n in enumerate(names):
            marks = row[f"c{i}"] if row is not None else None
            if marks is None or marks["int"] is None:
                fields.append(T.StructField(n, T.NullType()))
                continue
            kind = next((k for k, _ in tests if marks[k]), "string")
            if kind == "decimal":
                kind = f"decimal({marks['digits']},0)"
            fields.append(T.StructField(n, T._parse_datatype_string(kind)))
        out[f] = T.StructType(fields)
    return out


def read_geoparquet(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Geometry columns are WKB; a file without geo metadata is plain Parquet."""
    return read_parquet(spark, paths)


def _parsed(spark: SparkSession, files: list[str], parse, schema: T.StructType | None = None) -> DataFrame:
    """Rows of parse(content) (an iterator of batches) of every file, under the merged schema."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                first = next(iter(parse(content)), None)
                text = from_arrow_schema(first.schema, True).json() if first is not None else None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], ["path", "schema"])

    source = spark.read.format("binaryFile").load(files).select("path", "content")
    if schema is None:
        got = sorted(tuple(r) for r in source.mapInArrow(shapes, "path string, schema string").collect() if r[1])
        if not got:
            raise ValueError(f"{files[0]}: no rows and no schema")
        schema = merge_schemas([(p, T.StructType.fromJson(json.loads(s))) for p, s in got])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                for part in parse(content):
                    have = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                    cols = [have[f.name].cast(f.type) if f.name in have else pa.nulls(part.num_rows, f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)

    return source.select("content").mapInArrow(rows, schema)


def _nd_reader(parse):
    def read(spark: SparkSession, paths: str | Sequence[str], dimensions: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        return _parsed(spark, expand(spark, paths), lambda content: nd.flatten(parse(content), columns, dimensions))

    return read


read_netcdf = _nd_reader(formats.netcdf)
read_tiff = _nd_reader(formats.tiff)


def read_hdf5(
    spark: SparkSession, paths: str | Sequence[str], dimensions: Sequence[str] | None = None, convention: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    if convention is not None:
        raise ValueError(f"read_hdf5: the convention {convention} is not supported")
    return _nd_reader(hdf5.parse)(spark, paths, dimensions, columns)


def read_arrow(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return _parsed(spark, expand(spark, paths), lambda content: formats.arrow_ipc(content).combine_chunks().to_batches(65_536))


def read_odv_ascii(spark: SparkSession, paths: str | Sequence[str], fill_down: bool = False) -> DataFrame:
    return _parsed(spark, expand(spark, paths), lambda content: formats.odv(content, fill_down).to_batches(65_536))


def read_zarr(spark: SparkSession, paths: str | Sequence[str], dimensions: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Groups named by the paths of their zarr.json."""
    groups = [f[: -len("/zarr.json")] for f in _zarr_roots(spark, paths)]
    return zarr.read(spark, {g: expand_all(spark, g) for g in groups}, columns, dimensions)


def _zarr_roots(spark: SparkSession, paths) -> list[str]:
    return [f for f in expand(spark, paths) if f.endswith("/zarr.json")]


def expand_all(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _hadoop(spark, folder)
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        out.append(it.next().getPath().toString())
    return sorted(out)


# ------------------------------------------------------------------ Delta and Iceberg
#: Reader features that change nothing here, or whose use is looked for in the log and raises.
_DELTA_FEATURES = {"timestampNtz", "vacuumProtocolCheck", "columnMapping", "deletionVectors", "v2Checkpoint"}


def _delta_known(location: str, protocol: dict, meta: dict, vectors: bool) -> None:
    """Raises on what read_delta() would read wrongly."""
    if other := set(protocol.get("readerFeatures") or []) - _DELTA_FEATURES:
        raise ValueError(f"{location}: reader features {sorted(other)} are not supported")
    if (protocol.get("minReaderVersion") or 1) > 3:
        raise ValueError(f"{location}: reader version {protocol['minReaderVersion']} is not supported")
    if (meta.get("configuration") or {}).get("delta.columnMapping.mode", "none") != "none":
        raise ValueError(f"{location}: column mapping is not supported")
    if vectors:
        raise ValueError(f"{location}: deletion vectors are not supported")


def _delta_key(a: dict) -> tuple:
    """What names a logical file: its path and its deletion vector."""
    v = a.get("deletionVector") or {}
    return a["path"], v.get("storageType"), v.get("pathOrInlineDv"), v.get("offset")


def read_delta(spark: SparkSession, location: str, version: int | str | None = None) -> DataFrame:
    """The table's active files at a version, a time (RFC 3339) or now, from the JSON log and Parquet checkpoints."""
    logs = sorted(f for f in expand_all(spark, f"{location.rstrip('/')}/_delta_log"))
    commits = {int(m[1]): f for f in logs if (m := re.search(r"/(\d{20})\.json$", f))}
    points = sorted({int(m[1]) for f in logs if (m := re.search(r"/(\d{20})\.checkpoint.*\.parquet$", f))})
    if not commits and not points:
        raise FileNotFoundError(f"{location} is no Delta table")
    last = max([*commits, *points])
    if isinstance(version, str):
        import datetime as dt

        limit = dt.datetime.fromisoformat(version.replace("Z", "+00:00"))
        limit = (limit if limit.tzinfo else limit.replace(tzinfo=dt.UTC)).timestamp() * 1000
        fits = []
        for v, f in commits.items():
            lines = [json.loads(x) for x in read_text(spark, f).splitlines() if x.strip()]
            stamp = next((x["commitInfo"]["timestamp"] for x in lines if "timestamp" in x.get("commitInfo", {})), None)
            if stamp is None:
                fs, p = _hadoop(spark, f)
                stamp = fs.getFileStatus(p).getModificationTime()
            if stamp <= limit:
                fits.append(v)
        if not fits:
            raise ValueError(f"{location} has no version at {version}")
        version = max(fits)
    version = last if version is None else int(version)
    if version > last:
        raise ValueError(f"{location} has no version {version}")
    base = max((p for p in points if p <= version), default=None)
    active: dict[tuple, dict] = {}
    meta, protocol = None, {}
    if base is not None:
        files = [f for f in logs if re.search(rf"/{base:020d}\.checkpoint.*\.parquet$", f)]
        df = spark.read.parquet(*files)
        if "sidecar" in df.columns and df.filter("sidecar IS NOT NULL").limit(1).count():
            raise ValueError(f"{location}: checkpoints with sidecars are not supported")
        vector = F.col("add.deletionVector") if "deletionVector" in df.schema["add"].dataType.names else F.lit(None)
        for r in df.filter("add IS NOT NULL").select("add.path", "add.partitionValues", vector.alias("v")).collect():
            active[_delta_key({"path": r[0], "deletionVector": r["v"].asDict() if r["v"] else None})] = dict(r[1] or {})
        if "protocol" in df.columns:
            protocol = next((json.loads(r[0]) for r in df.filter("protocol IS NOT NULL").select(F.to_json("protocol")).collect()), {})
        meta = next((json.loads(r[0]) for r in df.filter("metaData IS NOT NULL").select(F.to_json("metaData")).collect()), None)
    for v in range(0 if base is None else base + 1, version + 1):
        if v not in commits:
            raise ValueError(f"{location}: the log of version {v} is missing")
        for line in read_text(spark, commits[v]).splitlines():
            a = json.loads(line) if line.strip() else {}
            meta, protocol = a.get("metaData", meta), a.get("protocol", protocol)
            if "remove" in a:
                active.pop(_delta_key(a["remove"]), None)
            if "add" in a:
                active[_delta_key(a["add"])] = a["add"].get("partitionValues") or {}
    _delta_known(location, protocol, meta, any(vector for _, vector, *_ in active))
    schema = T.StructType.fromJson(json.loads(meta["schemaString"]))
    parts = meta.get("partitionColumns") or []
    groups: dict[tuple, list[str]] = {}
    for (path, *_), values in active.items():
        full = path if "://" in path else f"{location.rstrip('/')}/{unquote(path)}"
        groups.setdefault(tuple(values.get(p) for p in parts), []).append(full)
    out = None
    stored = T.StructType([f for f in schema.fields if f.name not in parts])
    for values, files in groups.items():
        df = spark.read.schema(stored).parquet(*files)
        for p, v in zip(parts, values):
            df = df.withColumn(p, F.lit(v).cast(schema[p].dataType))
        df = df.select(*[F.col(f"`{n}`") for n in schema.names])
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], schema)


_ICEBERG = {"int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "binary": "binary", "uuid": "string"}


def _iceberg_type(t) -> str:
    if isinstance(t, str):
        return t if t.startswith("decimal") else _ICEBERG.get(t, "binary")
    if t["type"] == "list":
        return f"array<{_iceberg_type(t['element'])}>"
    if t["type"] == "map":
        return f"map<{_iceberg_type(t['key'])},{_iceberg_type(t['value'])}>"
    return "struct<" + ",".join(f"`{f['name']}`:{_iceberg_type(f['type'])}" for f in t["fields"]) + ">"


def _iceberg_ids(fields: list[dict], above: str = "") -> dict[str, int]:
    """Dotted name -> field id of columns and nested fields."""
    out = {}
    for f in fields:
        name, t = above + f["name"], f["type"]
        out[name] = f["id"]
        while isinstance(t, dict) and t["type"] in ("list", "map"):
            if t["type"] == "map" and isinstance(t["key"], dict) and t["key"]["type"] == "struct":
                out |= _iceberg_ids(t["key"]["fields"], f"{name}.key.")
            name, t = (f"{name}.element", t["element"]) if t["type"] == "list" else (f"{name}.value", t["value"])
        if isinstance(t, dict):
            out |= _iceberg_ids(t["fields"], f"{name}.")
    return out


def _parquet_ids(path: str, f) -> list[tuple]:
    """path and the JSON of dotted name -> field id, from the footer; fields without ids are left out."""
    import pyarrow.parquet as pq

    ids: dict[str, int] = {}

    def walk(field: pa.Field, name: str) -> None:
        if b"PARQUET:field_id" in (field.metadata or {}):
            ids[name] = int(field.metadata[b"PARQUET:field_id"])
        t = field.type
        if pa.types.is_struct(t):
            for x in t:
                walk(x, f"{name}.{x.name}")
        elif pa.types.is_map(t):
            walk(t.key_field, f"{name}.key")
            walk(t.item_field, f"{name}.value")
        elif pa.types.is_list(t) or pa.types.is_large_list(t):
            walk(t.value_field, f"{name}.element")

    for field in pq.read_schema(f):
        walk(field, field.name)
    return [(path, json.dumps(ids))]


def _iceberg_known(spark: SparkSession, location: str, schemas: list[dict], fields: list[dict], data: list[str]) -> None:
    """Raises where a column's name has stood, in another schema or in a data file, for another field, or its field for
    another name: files are read by name."""
    want = _iceberg_ids(fields)
    names = {i: n for n, i in want.items()}
    older = [("an earlier schema", _iceberg_ids(s["fields"])) for s in schemas]
    files = [(r["path"], json.loads(r["ids"])) for r in of_footers(spark, data, _parquet_ids, "path string, ids string").collect()] if data else []
    for where, have in (*older, *files):
        for n, i in have.items():
            if names.get(i, n) != n or want.get(n, i) != i:
                raise ValueError(f"{location}: field {i} is named {n} in {where}; renamed columns and names used again are not supported")


def read_iceberg(spark: SparkSession, location: str, snapshot_id: int | None = None) -> DataFrame:
    """The data files of a snapshot (the current one if not named), without delete files and renamed columns (those raise)."""
    location = location.rstrip("/")
    if location.endswith(".metadata.json"):
        chosen = location
        location = location.rsplit("/metadata/", 1)[0]
    else:
        files = expand_all(spark, f"{location}/metadata")
        hint = next((f for f in files if f.endswith("/version-hint.text")), None)
        known = {}
        for f in files:
            if m := re.search(r"/v?(\d+)[^/]*\.metadata\.json$", f):
                known[int(m[1])] = f
        if not known:
            raise FileNotFoundError(f"{location} is no Iceberg table")
        chosen = known.get(int(read_text(spark, hint).strip())) if hint else None
        chosen = chosen or known[max(known)]
    meta = json.loads(read_text(spark, chosen))
    schema = next((s for s in meta.get("schemas", []) if s["schema-id"] == meta.get("current-schema-id")), meta.get("schema"))
    kind = T.StructType([T.StructField(f["name"], T._parse_datatype_string(_iceberg_type(f["type"])), not f.get("required")) for f in schema["fields"]])
    wanted = snapshot_id if snapshot_id is not None else meta.get("current-snapshot-id")
    snapshot = next((s for s in meta.get("snapshots", []) if s["snapshot-id"] == wanted), None)
    if snapshot is None:
        if snapshot_id is not None:
            raise ValueError(f"{location} has no snapshot {snapshot_id}")
        return spark.createDataFrame([], kind)
    root = meta.get("location", location)

    def here(path: str) -> str:
        return location + path[len(root) :] if path.startswith(root) else path

    manifests = [m["manifest_path"] for m in formats.avro(read_text(spark, here(snapshot["manifest-list"])))] if "manifest-list" in snapshot else snapshot["manifests"]
    data = []
    for m in manifests:
        for entry in formats.avro(read_text(spark, here(m))):
            if entry["status"] == 2:
                continue
            f = entry["data_file"]
            if f.get("content", 0):
                raise ValueError(f"{location}: delete files are not supported")
            data.append(here(f["file_path"]))
    _iceberg_known(spark, location, meta.get("schemas", []), schema["fields"], data)
    return spark.read.schema(kind).parquet(*data) if data else spark.createDataFrame([], kind)


def schema_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(f.name, spark_to_arrow(f.dataType), f.nullable) for f in df.schema.fields]
    return spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


def call(spark: SparkSession, name: str, args: list, columns: Sequence[str] | None = None) -> DataFrame:
    """A reader by its SQL name; columns go to the readers whose row count depends on them."""
    fn = globals()[name]
    if name in ("read_netcdf", "read_hdf5", "read_zarr", "read_tiff"):
        return fn(spark, *args, columns=columns)
    return fn(spark, *args)
