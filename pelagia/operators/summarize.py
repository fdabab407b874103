"""SUMMARIZE: one row of statistics for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.types import spark_to_arrow

COLUMNS = "column_name string, column_type string, min string, max string, approx_unique long, avg double, std double, count long, null_percentage double"
_ORDERED = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _text(f: T.StructField) -> Column:
    """A text that stands for a value of the column: itself if short, else a digest; zeros of both signs are one."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.FloatType | T.DoubleType):
        c = F.when(c == 0, F.lit(0.0)).otherwise(c)
    if isinstance(f.dataType, T.BinaryType):
        text = F.hex(c)
    elif isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
        text = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    else:
        text = c.cast("string")
    return F.when(F.length(text) <= 64, F.concat(F.lit("="), text)).otherwise(F.sha2(text, 256))


def summarize(df: DataFrame, arrow_types: bool = True) -> DataFrame:
    """min and max as text (orderable types), exact distinct count, mean and standard deviation of what casts to a
    number, non-null count, share of nulls in per cent (0 for an empty table); columns in source order.

    Everything but the distinct counts comes from one aggregation; the distinct counts come from one more over
    (column number, value as text), which the planner aggregates partially instead of expanding each row
    once for every column and sorting."""
    aggs, kinds = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        ordered = isinstance(f.dataType, _ORDERED)
        text = f.dataType if isinstance(f.dataType, T.StringType) else None
        number = c.cast("double") if isinstance(f.dataType, T.NumericType) else c.try_cast("double") if text else F.lit(None).cast("double")
        aggs += [
            (F.min(c).cast("string") if ordered else F.lit(None).cast("string")).alias(f"min{i}"),
            (F.max(c).cast("string") if ordered else F.lit(None).cast("string")).alias(f"max{i}"),
            F.avg(number).alias(f"avg{i}"),
            F.stddev_samp(number).alias(f"std{i}"),
            F.count(c).alias(f"cnt{i}"),
        ]
        kinds.append(spark_to_arrow(f.dataType) if arrow_types else f.dataType.simpleString())
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), _text(f).alias("h")) for i, f in enumerate(df.schema.fields)])
    distinct = (
        df.select(F.inline(cells))
        .filter("h IS NOT NULL")
        .distinct()
        .groupBy("i")
        .agg(F.count("*").alias("u"))
    )
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.lit(kinds[i]).alias("column_type"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"avg{i}").alias("avg"), F.col(f"std{i}").alias("std"),
            F.col(f"cnt{i}").alias("count"),
            F.when(F.col("n") == 0, F.lit(0.0)).otherwise((F.col("n") - F.col(f"cnt{i}")) * 100.0 / F.col("n")).alias("null_percentage"),
        )
        for i, f in enumerate(df.schema.fields)
    ])
    flat = one.select(F.inline(rows))
    return (
        flat.join(F.broadcast(distinct), "i", "left")  # a row for each column
        .orderBy("i")
        .select(
            "column_name", "column_type", "min", "max", F.coalesce("u", F.lit(0)).alias("distinct_count"), "avg", "std", "count", "null_percentage"
        )
    )
