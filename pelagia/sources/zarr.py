"""Zarr v3 groups as DataFrames, block by block.

The driver reads metadata only: zarr.json files, and the names of the chunks of the variables that a query needs.
The grid of each group is cut along the chunks of its widest variable; a block is a row of an integer range, so
blocks without written chunks exist too. Chunk files come through Spark's binaryFile source. A chunk that lies in
one block goes there as it is; of one that several blocks share (coordinates, mostly) each block gets its part.
What a task holds is one block with its chunks, however large the array.

Ragged groups are cut nowhere: their files meet in one task.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from pelagia import nd
from pelagia.operators.sets import conform
from pelagia.sources import formats
from pelagia.types import merge_schemas


@dataclass
class _Group:
    path: str
    attrs: dict
    arrays: dict[str, formats.ZarrArray]
    layout: nd.Layout
    sizes: dict[str, int]
    step: dict[str, int]  # block size along each dimension of the grid
    first: int  # number of its first block

    def counts(self) -> list[int]:
        return [-(-self.sizes[d] // self.step[d]) for d in self.layout.dims]

    def spans(self, block: int) -> dict[str, tuple[int, int]]:
        """Where a block lies, along each dimension."""
        out = {}
        for d, i in zip(self.layout.dims, np.unravel_index(block - self.first, self.counts()) if self.layout.dims else ()):
            out[d] = (int(i) * self.step[d], min((int(i) + 1) * self.step[d], self.sizes[d]))
        return out

    def blocks_of(self, a: formats.ZarrArray, at: Sequence[int]) -> Iterator[int]:
        """Blocks that a chunk lies in."""
        where = {d: (i * c, min((i + 1) * c, s)) for d, i, c, s in zip(a.dims, at, a.chunk, a.shape)}
        every = []
        for d, n in zip(self.layout.dims, self.counts()):
            lo, hi = where.get(d, (0, self.sizes[d]))
            every.append(range(lo // self.step[d], min(-(-hi // self.step[d]), n)))
        counts = self.counts()
        for index in itertools.product(*every):
            yield self.first + (int(np.ravel_multi_index(index, counts)) if index else 0)

    def dataset(self, spans: dict[str, tuple[int, int]], parts: list[dict]) -> nd.Dataset:
        variables = {n: nd.Variable(a.dims, np.zeros((), a.dtype), a.attrs) for n, a in self.arrays.items()}
        for n in self.layout.fits:
            a = self.arrays[n]
            variables[n].values = a.empty([spans[d][1] - spans[d][0] for d in a.dims])
        for p in parts:
            a = self.arrays[p["name"]]
            lo = np.frombuffer(p["place"], np.int64)
            if p["whole"]:
                x, lo = a.decode(p["content"]), lo * np.array(a.chunk, np.int64)
            else:
                lo, hi = lo[: len(a.shape)], lo[len(a.shape) :]
                x = np.frombuffer(p["content"], a.dtype).reshape(tuple(hi - lo))
            to, of = [], []
            for d, b, n in zip(a.dims, lo.tolist(), x.shape):
                u, v = max(spans[d][0], b), min(spans[d][1], b + n)
                to.append(slice(u - spans[d][0], v - spans[d][0]))
                of.append(slice(u - b, v - b))
            variables[p["name"]].values[tuple(to)] = x[tuple(of)]
        sizes = {d: spans[d][1] - spans[d][0] if d in spans else n for d, n in self.sizes.items()}
        return nd.Dataset(sizes, variables, self.attrs)

    def schema(self) -> T.StructType:
        one = self.dataset({d: (0, 1) for d in self.sizes}, [])
        return from_arrow_schema(next(nd.flatten(one, plan=self.layout)).schema, True)


def _group(path: str, files: dict[str, bytes], columns, dimensions, first: int) -> _Group | None:
    """None for a ragged group."""
    attrs, arrays = formats.zarr_group(files)
    sizes = {d: n for a in arrays.values() for d, n in zip(a.dims, a.shape)}
    shell = nd.Dataset(sizes, {n: nd.Variable(a.dims, np.zeros((), a.dtype), a.attrs) for n, a in arrays.items()}, attrs)
    if nd.ragged_rows(shell) is not None:
        return None
    plan = nd.layout(shell, columns, dimensions)
    step = {}
    for n in sorted(plan.fits, key=lambda n: -len(arrays[n].dims)):
        for d, c in zip(arrays[n].dims, arrays[n].chunk):
            step.setdefault(d, c)
    return _Group(path, attrs, arrays, plan, sizes, {d: step.get(d, max(sizes[d], 1)) for d in plan.dims}, first)


_PART = "block long, name string, whole boolean, place binary, content binary"


def read(spark: SparkSession, groups: dict[str, list[str]], columns: Sequence[str] | None = None, dimensions: Sequence[str] | None = None) -> DataFrame:
    """Rows of groups (folder to the paths of its files)."""
    metas = [f for files in groups.values() for f in files if f.endswith("/zarr.json")]
    known = {r["path"]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(metas).select("path", "content").collect()}
    plans: list[_Group] = []
    ragged: dict[str, list[str]] = {}
    wanted: list[str] = []
    total = 0
    for g, files in groups.items():
        found = _group(g, {f[len(g) + 1 :]: known[f] for f in files if f.endswith("/zarr.json")}, columns, dimensions, total)
        if found is None:
            ragged[g] = files
            continue
        plans.append(found)
        total += math.prod(found.counts())
        need = tuple(f"{g}/{found.arrays[n].prefix}" for n in found.layout.fits)
        wanted += [f for f in files if f.startswith(need) and not f.endswith("/zarr.json")]
    frames = [(g, _whole(spark, g, files, columns, dimensions)) for g, files in ragged.items()]
    if plans:
        schema = merge_schemas([(p.path, p.schema()) for p in plans])
        frames.insert(0, (plans[0].path, _blocks(spark, plans, wanted, total, schema)))
    schema = merge_schemas([(g, df.schema) for g, df in frames])
    out = None
    for _, df in frames:
        df = conform(df, schema)
        out = df if out is None else out.unionByName(df)
    return out


def _blocks(spark: SparkSession, plans: list[_Group], files: list[str], total: int, schema: T.StructType) -> DataFrame:
    shared = spark.sparkContext.broadcast(plans)
    firsts = [p.first for p in plans]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_path = {p.path: p for p in shared.value}
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                folder = path
                while folder not in by_path:
                    folder = folder.rsplit("/", 1)[0]
                g, key = by_path[folder], path[len(folder) + 1 :]
                for n in g.layout.fits:
                    a = g.arrays[n]
                    if (at := a.place(key)) is None:
                        continue
                    rows = []
                    blocks = g.blocks_of(a, at)
                    head = list(itertools.islice(blocks, 2))
                    if len(head) == 1:
                        rows.append((head[0], n, True, np.array(at, np.int64).tobytes(), content))
                    else:
                        x = a.decode(content)
                        for b in itertools.chain(head, blocks):
                            spans = g.spans(b)
                            lo = [max(spans[d][0], i * c) for d, i, c in zip(a.dims, at, a.chunk)]
                            hi = [min(spans[d][1], (i + 1) * c) for d, i, c in zip(a.dims, at, a.chunk)]
                            piece = x[tuple(slice(u - i * c, v - i * c) for u, v, i, c in zip(lo, hi, at, a.chunk))]
                            rows.append((b, n, False, np.array(lo + hi, np.int64).tobytes(), np.ascontiguousarray(piece).tobytes()))
                            if len(rows) == 256:
                                yield _part_batch(rows)
                                rows = []
                    if rows:
                        yield _part_batch(rows)

    target = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                g = shared.value[bisect.bisect_right(firsts, block) - 1]
                spans = g.spans(block)
                ds = g.dataset(spans | {d: (0, n) for d, n in g.sizes.items() if d not in spans}, batch.column("parts")[i].as_py() or [])
                for part in nd.flatten(ds, plan=g.layout):
                    have = {n: part.column(k) for k, n in enumerate(part.schema.names)}
                    cols = [have[f.name].cast(f.type) if f.name in have else pa.nulls(part.num_rows, f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(cols, schema=target)

    blocks = spark.range(total).withColumnRenamed("id", "block")
    if files:
        sent = spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(parts, _PART)
        packed = sent.groupBy("block").agg(F.collect_list(F.struct("name", "whole", "place", "content")).alias("parts"))
        blocks = blocks.join(packed, "block", "left")
    else:
        kind = "array<struct<name:string,whole:boolean,place:binary,content:binary>>"
        blocks = blocks.withColumn("parts", F.lit(None).cast(kind))
    return blocks.mapInArrow(rows, schema)


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "name", "whole", "place", "content"])


def _whole(spark: SparkSession, group: str, files: list[str], columns, dimensions) -> DataFrame:
    """A ragged group, whose row sizes tell where each instance's values lie."""
    packed = spark.read.format("binaryFile").load(files).select("path", "content").agg(F.collect_list(F.struct("path", "content")).alias("files"))

    def parse(entries: list[dict]) -> Iterator[pa.RecordBatch]:
        return nd.flatten(formats.zarr({e["path"][len(group) + 1 :]: e["content"] for e in entries}), columns, dimensions)

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entries in b.column("files").to_pylist():
                for first in itertools.islice(parse(entries), 1):
                    yield pa.RecordBatch.from_arrays([pa.array([from_arrow_schema(first.schema, True).json()])], ["schema"])

    got = packed.mapInArrow(shape, "schema string").first()
    if got is None:
        raise ValueError(f"{group}: no rows and no schema")
    schema = T.StructType.fromJson(json.loads(got[0]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entries in b.column("files").to_pylist():
                yield from parse(entries)

    return packed.mapInArrow(rows, schema)
