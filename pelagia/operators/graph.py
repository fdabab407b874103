"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint where spark.checkpoint.dir is set, else a cached table: the plan ends here either way."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        # new names for the columns: a checkpoint keeps their identity, which clashes in joins with what they come from
        return df.checkpoint().select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    return df.persist()


def connected(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, component (smallest node reachable) for edges (u, v); self-loops keep a node that has no other edge.

    Each round takes the least label among neighbours and then the label's label (pointer jumping); lineage is cut
    with checkpoint() where spark.checkpoint.dir is set."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    for _ in range(most_rounds):
        seen = both.join(label.select(F.col("u").alias("v"), F.col("m").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        step = label.join(seen, "u", "left").select("u", F.least("m", F.coalesce("n", "m")).alias("m"))
        jump = step.select(F.col("u").alias("k"), F.col("m").alias("n"))
        new = cut(step.join(jump, step.m == jump.k).select("u", F.least("m", "n").alias("m")))
        changed = new.join(label.withColumnRenamed("m", "old"), "u").filter("m != old").limit(1).count()
        label = new
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("m").alias("component"))
    raise RuntimeError(f"connected: no fixpoint after {most_rounds} rounds")
