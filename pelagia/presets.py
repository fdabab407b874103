"""Presets: a table opened to callers with a fixed list of filters and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "between", "in")


def check(preset: dict) -> dict:
    """Validates {"filters": [{"name", "column", "operator"}], "columns": [..]}."""
    for f in preset.get("filters", []):
        if f.get("operator", "=") not in OPERATORS:
            raise ValueError(f"preset: operator {f.get('operator')} is not one of {', '.join(OPERATORS)}")
        if "column" not in f:
            raise ValueError("preset: a filter needs a column")
    return preset


def apply(df: DataFrame, preset: dict | None, values: dict) -> DataFrame:
    if preset is None:
        raise ValueError("the table has no preset")
    known = {f.get("name", f["column"]): f for f in preset.get("filters", [])}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"preset: there is no filter {name}")
        col, op = F.col(f"`{known[name]['column']}`"), known[name].get("operator", "=")
        df = df.filter(
            {
                "=": lambda: col == value, "!=": lambda: col != value, "<": lambda: col < value, "<=": lambda: col <= value,
                ">": lambda: col > value, ">=": lambda: col >= value, "between": lambda: col.between(*value), "in": lambda: col.isin(list(value)),
            }[op]()
        )
    missing = [n for n, f in known.items() if f.get("required") and n not in values]
    if missing:
        raise ValueError(f"preset: filter {missing[0]} is required")
    return df.select(*[f"`{c}`" for c in preset["columns"]]) if preset.get("columns") else df
