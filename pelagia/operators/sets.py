"""Set operators by name, DISTINCT ON, and file unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.types import Widening, merge_schemas, widen


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema: cast (a value that does not fit is an error), missing ones null, others dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif have[f.name] == f.dataType:
            cols.append(F.col(f"`{f.name}`"))
        else:
            cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
    return df.select(*cols)


def union_by_name(left: DataFrame, right: DataFrame, rule: Widening = widen) -> DataFrame:
    """UNION ALL BY NAME: columns matched by name, widened, missing ones null."""
    schema = merge_schemas([("the left side", left.schema), ("the right side", right.schema)], rule)
    return conform(left, schema).unionByName(conform(right, schema))


def distinct_on(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order: one window over the keys, no self-join."""
    w = Window.partitionBy(*keys).orderBy(*order) if order else Window.partitionBy(*keys).orderBy(*keys)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
