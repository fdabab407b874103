"""Structured Streaming over event files: windowed counts with a watermark, and crawling as a stream."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_names = itertools.count()


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of events by window and type; works on streams (rows over `late` behind are dropped) and tables alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts of events by key in sessions: runs of events that are less than `gap` apart; streams and tables alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).withColumnRenamed("session_window", "window")


def _folder(spark: SparkSession) -> str:
    """A fresh folder for a stream's state: below spark.checkpoint.dir where that is set, as executors share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="pelagia-stream-")


def windowed_counts(spark: SparkSession, path: str, width: str) -> DataFrame:
    """Drives a stream over the files through to its end (complete mode) and returns its table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    table = f"__stream{next(_names)}"
    q = (
        windowed(source, width)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(table)
        .option("checkpointLocation", _folder(spark))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.table(table).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
