"""Helpers shared by the training-data operators: tables, scratch space, text kernels, components."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; no other byte changes, so multi-byte characters stay whole.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Lower-cases and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    The setting is read from the session. Only where it is unset (tests, one machine) a local
    folder is made and set as the checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='pelagia-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/pelagia-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Folders that this process made and has not deleted.
_made: list[str] = []


def made() -> int:
    """A mark for drop_made()."""
    return len(_made)


def drop_made(spark: SparkSession, since: int, but: DataFrame | None = None) -> None:
    """Deletes the folders made since the mark, except the one that `but` reads: what it was computed from is done."""
    kept = but.inputFiles()[:1] if but is not None else []
    for path in _made[since:]:
        if not any(path.rsplit("/", 1)[1] in name for name in kept):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)


#: Rows of a few numbers that one file of a small table holds.
FILE_ROWS = 100_000


def materialise(df: DataFrame, rows: int | None = None, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors.

    rows: about how many narrow rows there are, for tables behind a shuffle; they get a file for each FILE_ROWS, not
    one for each shuffle partition."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(-(-rows // FILE_ROWS) or 1)
    path = scratch(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes what materialise() wrote, through Hadoop's file system (any store)."""
    for name in df.inputFiles()[:1]:
        folder = name.rsplit("/", 1)[0]
        _delete(df.sparkSession, next((m for m in _made if m.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]), folder))


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows, unless the session asks for fewer: with long texts 10000 rows are too many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > 2000:
        spark.conf.set(name, "2000")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with bounded batches and released memory."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    bounded(df.sparkSession)
    ensure_package(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, most: int = 2_000_000) -> DataFrame:
    """map_arrow for a function of one batch; large batches are cut so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return map_arrow(df, run, schema)


def cut(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch of about `most` bytes each, a row at least."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= most:
        if n:
            yield batch
        return
    size = np.zeros(n, np.int64)
    for col in batch.columns:
        kind = col.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
            off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1]
            size += np.diff(off.astype(np.int64))
        else:
            size += col.nbytes // n
    group = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], n]):
        yield batch.slice(int(a), int(b - a))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a stream sorted by the keys: the last group of each waits for the batch that ends
    it. A batch is looked at once, however long a group goes on."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch.column(k).to_numpy() == v.as_py()
        begin = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        fresh = held and [held[-1].column(k)[held[-1].num_rows - 1] for k in keys] != last
        if rows + begin >= least and (begin or fresh):
            yield pa.Table.from_batches([*held, batch.slice(0, begin)]).combine_chunks()
            held, rows, batch = [], 0, batch.slice(begin)
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def within_bytes(rows: DataFrame, column: str, order: list, most: int) -> DataFrame:
    """The first of these (few) rows, in the given order, whose column holds no more than `most` bytes together."""
    size = F.sum(F.octet_length(column)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__bytes", size).filter(F.col("__bytes") <= most).drop("__bytes")


def starts_and_ends(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of words in b' '.join(words)."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    return end - n, end


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return batch.column(name).cast(pa.binary()).fill_null(b"").to_pylist()


def long_ids(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(name).cast(pa.int64())


def components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Connected components of edges (u, v): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps (each a partial aggregation and a join, which adaptive
    execution splits when a node is hot), each written to the shared folder, until nothing changes (a number of rounds that
    grows with the logarithm of the nodes; most_rounds only guards against an endless loop). Nodes
    without edges are not listed. Only counts come to the driver. rows: about how many nodes there are."""
    now = materialise(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows
    )
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        small = materialise(small.filter("u != v").distinct(), rows)
        drop(large)
        drop(now)
        mark = tuple(
            small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        now = small
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components: no fixpoint after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def ensure_package(spark: SparkSession) -> None:
    """Ships this package to the executors of a cluster, once a session: the driver serves the archive."""
    sc = spark.sparkContext
    if re.match(r"local(\[|$)", sc.master) or getattr(sc, "_pelagia_shipped", False):
        return
    import zipfile

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(), "pelagia.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._pelagia_shipped = True
