"""Crawlers: find datasets below a folder and define external tables for them.

Files are grouped by format and base folder, where hive folders (`key=value`) belong to the group below them; the keys
of a group's files must agree, else the group has no partitions. A group is named after its base folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pelagia.sources import readers
from pelagia.stats import _FORMATS

_KNOWN = {"parquet", "csv", "arrow", "netcdf", "hdf5", "tiff"}


def group(paths: list[str]) -> dict[tuple[str, str], dict]:
    """(format, base folder) -> {"files", "partitions"} of paths relative to the crawled folder."""
    out: dict[tuple[str, str], dict] = {}
    for p in sorted(paths):
        *folders, name = p.split("/")
        if name.startswith(("_", ".")):
            continue
        if name == "zarr.json":
            fmt = "zarr"
        else:
            fmt = _FORMATS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", "")
            if fmt not in _KNOWN:
                continue
        hive = [f for f in folders if re.fullmatch(r"[^=/]+=[^=/]*", f)]
        base = "/".join(folders[: folders.index(hive[0])] if hive else folders)
        g = out.setdefault((fmt, base), {"files": [], "keys": []})
        g["files"].append(p)
        g["keys"].append(tuple(f.split("=", 1)[0] for f in hive))
    for g in out.values():
        keys = set(g.pop("keys"))
        g["partitions"] = list(keys.pop()) if len(keys) == 1 else []
    return out


def table_name(base: str, fmt: str, prefix: str, taken: set[str]) -> str:
    name = re.sub(r"\W+", "_", base.strip("/")).strip("_").lower() or fmt
    name = prefix + (f"t_{name}" if name[0].isdigit() else name)
    if name in taken:
        name = f"{name}_{fmt}"
    k = 2
    while name in taken:
        name, k = f"{name}_{k}", k + 1
    return name


def run(con, name: str, conf: dict) -> DataFrame:
    """Crawls once: defines tables for new groups, refreshes known ones; rows (table, format, location, action)."""
    folder = con.paths(conf["path"])
    fs, p = readers._hadoop(con.spark, folder)
    root = fs.makeQualified(p).toString().rstrip("/")
    files = [f.removeprefix(root + "/") for f in readers.expand_all(con.spark, folder)]
    owned = {(e["format"], e["location"]): n for n, e in con.catalog.entries.items() if e.get("crawler") == name}
    rows = []
    for (fmt, base), g in group(files).items():
        where = f"{root}/{base}".rstrip("/")
        location = where if g["partitions"] else {"parquet": f"{where}/*.parquet", "csv": f"{where}/*.csv", "netcdf": f"{where}/*.nc", "hdf5": f"{where}/*.h*5", "arrow": f"{where}/*.arrow", "tiff": f"{where}/*.tif*", "zarr": f"{where}/zarr.json"}[fmt]
        known = owned.pop((fmt, location), None)
        table = known or table_name(base, fmt, conf.get("prefix", ""), set(con.catalog.entries))
        con.catalog.define(table, {"kind": "external", "format": fmt, "location": location, "partitions": g["partitions"], "options": {}, "crawler": name}, replace=True)
        rows.append((table, fmt, location, "updated" if known else "created"))
    for table in owned.values():
        if conf.get("drop_missing", True):
            con.catalog.drop(table)
            rows.append((table, "", "", "dropped"))
    return con.spark.createDataFrame(rows, "table_name string, format string, location string, action string")
