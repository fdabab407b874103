"""Query results as files: CSV, Parquet, Arrow IPC, NetCDF (flat and gridded), GeoParquet, ODV.

Parquet and CSV are written by the cluster. The single-file formats take a result that fits one machine (they are
meant for downloads): their rows come to the driver, at most `most_rows` of them, else they raise.
"""

from __future__ import annotations

import io
import json
import os
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.nd import Dataset, Variable
from pelagia.sources import netcdf3

MOST_ROWS = 50_000_000


def _table(df: DataFrame, most_rows: int) -> pa.Table:
    got = df.limit(most_rows + 1).toArrow()
    if got.num_rows > most_rows:
        raise ValueError(f"the result has over {most_rows} rows; write Parquet or CSV instead")
    return got


def to_parquet(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").parquet(path)


def to_csv(df: DataFrame, path: str, delimiter: str = ",", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, sep=delimiter)


def to_ipc(df: DataFrame, path: str, most_rows: int = MOST_ROWS) -> None:
    table = _table(df, most_rows)
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)


def _variable(col: pa.ChunkedArray, dims: tuple[str, ...], at: np.ndarray | None = None, shape: tuple[int, ...] | None = None) -> Variable:
    """A column as a variable; nulls become the fill value, timestamps seconds since 1970. at scatters into shape."""
    attrs: dict[str, object] = {}
    kind = col.type
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        col = col.cast(pa.timestamp("us")).cast(pa.int64())
        x = col.to_numpy().astype(float) / 1e6
        attrs = {"units": "seconds since 1970-01-01T00:00:00", "calendar": "standard"}
    elif pa.types.is_string(kind) or pa.types.is_large_string(kind):
        x = np.array([v or "" for v in col.to_pylist()], dtype=str)
    elif pa.types.is_boolean(kind):
        x = col.cast(pa.int8()).to_numpy()
    elif pa.types.is_decimal(kind):
        x = col.cast(pa.float64()).to_numpy()
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind):
        x = col.to_numpy()
    else:
        raise ValueError(f"NetCDF holds primitive columns only, not {kind}")
    if x.dtype.kind == "U":
        if at is not None:
            full = np.full(int(np.prod(shape)), "", x.dtype)
            full[at] = x
            x = full.reshape(shape)
        return Variable(dims, x, attrs)
    fill: float | int | None = None
    if col.null_count or at is not None:
        x = x.astype(float) if x.dtype.kind == "f" or x.dtype.kind == "O" or np.isnan(x.astype(float)).any() else x
        if x.dtype.kind == "f":
            fill = -9.969209968386869e36
            x = np.where(np.isnan(x), fill, x)
        else:
            fill = int(np.iinfo(np.int32 if x.dtype.itemsize > 2 else x.dtype).min) + 1
            x = x.astype(np.int32) if x.dtype.itemsize > 4 and np.abs(x).max(initial=0) < 2**31 - 1 else x
            if x.dtype.itemsize > 4:
                x, fill = x.astype(float), -9.969209968386869e36
        attrs["_FillValue"] = np.asarray(fill, x.dtype)
    if at is not None:
        full = np.full(int(np.prod(shape)), fill, x.dtype)
        full[at] = x
        x = full.reshape(shape)
    return Variable(dims, x, attrs)


def to_netcdf(df: DataFrame, path: str, most_rows: int = MOST_ROWS) -> None:
    """One `obs` dimension."""
    table = _table(df, most_rows)
    ds = Dataset({"obs": table.num_rows}, {n: _variable(table[n], ("obs",)) for n in table.column_names})
    with open(path, "wb") as f:
        f.write(netcdf3.write(ds))


def to_nd_netcdf(df: DataFrame, path: str, dimension_columns: list[str], most_rows: int = MOST_ROWS) -> None:
    """The named columns become axes of their distinct sorted values; other columns are scattered over the grid."""
    if not dimension_columns:
        raise ValueError("nd_netcdf: dimension_columns must not be empty")
    table = _table(df.dropna(subset=dimension_columns), most_rows)
    axes, index = {}, np.zeros(table.num_rows, np.int64)
    for d in dimension_columns:
        values = table[d].combine_chunks()
        keys = np.array(values.to_pylist(), dtype=object if pa.types.is_string(values.type) else None)
        unique, inverse = np.unique(keys.astype(str) if keys.dtype == object else keys, return_inverse=True)
        axes[d] = unique
        index = index * len(unique) + inverse
    if len(np.unique(index)) != len(index):
        raise ValueError("nd_netcdf: two rows stand at one place of the grid")
    shape = tuple(len(axes[d]) for d in dimension_columns)
    sizes = dict(zip(dimension_columns, shape))
    variables = {}
    for d in dimension_columns:
        first = table.take(pa.array(np.unique(np.array([str(x) for x in table[d].to_pylist()]) if axes[d].dtype.kind == "U" else np.array(table[d].to_pylist()), return_index=True)[1]))
        variables[d] = _variable(first[d], (d,))
    for n in table.column_names:
        if n not in axes:
            variables[n] = _variable(table[n], tuple(dimension_columns), index, shape)
    with open(path, "wb") as f:
        f.write(netcdf3.write(Dataset(sizes, variables)))


def with_geometry(df: DataFrame, lon: str, lat: str, geometry: str = "geometry") -> DataFrame:
    """A WKB point and its covering box from coordinates, as Column expressions.

    WKB of a point is 01 01000000 and two little-endian doubles; Spark has no double-to-bytes function, so the bits
    come from the JVM function registered by spatial."""
    from pelagia.functions import spatial

    spatial.register(df.sparkSession)
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    box = F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
    return df.withColumn(geometry, F.call_function("st_point", x, y)).withColumn("bbox", F.when(x.isNotNull() & y.isNotNull(), box))


def to_geoparquet(df: DataFrame, path: str, lon: str | None = None, lat: str | None = None, geometry: str = "geometry", most_rows: int = MOST_ROWS) -> None:
    """One GeoParquet file: WKB column, covering box, `geo` metadata."""
    if lon and lat:
        df = with_geometry(df, lon, lat, geometry)
    table = _table(df, most_rows)
    column: dict = {"encoding": "WKB", "geometry_types": []}
    if "bbox" in table.column_names:
        column["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
        boxes = table["bbox"].combine_chunks()
        if len(boxes) > boxes.null_count:
            import pyarrow.compute as pc

            column["bbox"] = [
                (pc.min if k.endswith("min") else pc.max)(boxes.field(k)).as_py() for k in ("xmin", "ymin", "xmax", "ymax")
            ]
    geo = {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}
    meta = {**(table.schema.metadata or {}), b"geo": json.dumps(geo).encode()}
    pq.write_table(table.replace_schema_metadata(meta), path)


def to_odv(df: DataFrame, path: str, key: list[str], longitude: str, latitude: str, time: str, depth: str | None = None, meta: list[str] | None = None, data: list[str] | None = None, units: dict[str, str] | None = None, feature: str = "Profiles", most_rows: int = MOST_ROWS) -> None:
    """A zip archive with one ODV spreadsheet; rows are grouped into stations by the key columns."""
    meta, units = meta or [], units or {}
    data = data if data is not None else [c for c in df.columns if c not in {*key, *meta, longitude, latitude, time, depth}]
    order = [*key, time, *([depth] if depth else [])]
    rows = _table(df.orderBy(*order), most_rows).to_pylist()
    name = lambda c: f"{c} [{units[c]}]" if c in units else c
    out = io.StringIO()
    out.write(f"//<Encoding>UTF-8</Encoding>\n//<Version>ODV Spreadsheet V4.8</Version>\n//<DataType>{feature}</DataType>\n//\n")
    for c in meta:
        out.write(f'//<MetaVariable>label="{name(c)}" var_type="METACUSTOM" value_type="INDEXED_TEXT" qf_schema="SEADATANET" comment=""</MetaVariable>\n')
    for c in [*([depth] if depth else []), *data]:
        numeric = dict(df.dtypes)[c] not in ("string",)
        out.write(f'//<DataVariable>label="{name(c)}" var_type="DATA" value_type="{"DOUBLE" if numeric else "INDEXED_TEXT"}" qf_schema="SEADATANET" comment=""</DataVariable>\n')
    head = ["Cruise", "Station", "Type", "yyyy-mm-ddThh:mm:ss.sss", "Longitude [degrees_east]", "Latitude [degrees_north]", *map(name, meta), *([name(depth)] if depth else []), *map(name, data)]
    out.write("\t".join(head) + "\n")
    text = lambda v: "" if v is None else str(v)
    for r in rows:
        stamp = r[time].isoformat(timespec="milliseconds") if hasattr(r[time], "isoformat") else text(r[time])
        station = "_".join(text(r[k]) for k in key)
        cells = [text(r[key[0]]), station, "*", stamp, text(r[longitude]), text(r[latitude]), *[text(r[c]) for c in meta], *([text(r[depth])] if depth else []), *[text(r[c]) for c in data]]
        out.write("\t".join(cells) + "\n")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{feature.lower()}.txt", out.getvalue())


def write(df: DataFrame, path: str, fmt: str, **options) -> None:
    """A result in one of the output formats."""
    fmt = fmt.lower()
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True) if "://" not in path else None
    writers = {
        "csv": to_csv, "parquet": to_parquet, "ipc": to_ipc, "arrow": to_ipc, "netcdf": to_netcdf, "hdf5": to_netcdf, "h5": to_netcdf,
        "ndnetcdf": to_nd_netcdf, "nd_netcdf": to_nd_netcdf, "geoparquet": to_geoparquet, "odv": to_odv,
    }
    if fmt not in writers:
        raise ValueError(f"unknown output format {fmt}")
    writers[fmt](df, path, **options)
