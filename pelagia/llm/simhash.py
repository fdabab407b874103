"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of equal value are one node. Their 64 bits are split into m partitions, correlated bits
together; thresholds t_1..t_m with sum = radius - m + 1 (-1: the partition is not probed) are allocated by
dynamic programming on estimated candidate counts, and the m with the least estimated cost is taken: two
fingerprints within `radius` bits are within t_i bits in some partition i. Every fingerprint enters the
bucket of its own key in each probed partition, and the buckets of keys up to t_i bits away. In a bucket,
candidates are verified on all 64 bits and only a spanning forest of the links is emitted, so a group of copies
gives as many rows as it has members, not as pairs.

A bucket of more than `dense` fingerprints is split by the same principle over the bits outside its partition: bit
statistics of the crowded members, partitions and thresholds anew, probes into finer buckets. A bucket that is crowded after
ROUNDS rounds holds one tight cluster rather than many (each more round would repeat it in every part): it is linked
through all values at most half the radius away from its members (two are within an even radius exactly if they share
one), aggregated by value, which is linear in the members and spreads over the cluster.

Components come from star contraction over written tables; nothing but counts, bit statistics (64 x 64) and
thresholds reaches the driver.

Defined cases: null or empty text, or only white space: fingerprint zero, linked like any other; fewer than
four words: one shingle of all words. Repeated rows: each returned, same component. A repeated doc_id counts as
one document that has all its fingerprints. A row without doc_id gets the component of equal fingerprints, if a
row with a doc_id has one, else null, and links nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import LOWER, arrow_map, components, long_ids, map_arrow, materialise, starts_and_ends, table, texts, whole_groups

SHINGLE = 4
SEED = 42
RADIUS = 4
DENSE = 20_000
ROUNDS = 2


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(flat, SEED)
    start, end = starts_and_ends(words)
    n = len(words) - shingle + 1
    h = np.fromiter(
        (digest(flat[a:b], SEED) for a, b in zip(start[:n].tolist(), end[shingle - 1 :].tolist())), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for a in range(0, n, 1 << 16):
        ones += np.unpackbits(raw[a : a + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([long_ids(batch), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def bit_statistics(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each part (columns part, fp) the number of fingerprints, and how often two bits are both set: sums over the
    batches, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            v, part = batch.column("fp").to_numpy().view(np.uint64), batch.column("part").to_numpy()
            bits = ((v[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            for p in np.unique(part).tolist():
                some = bits[part == p]
                sums[p] = sums.get(p, 0.0) + np.r_[(some.T @ some).ravel().astype(float), len(some)]
        for p, cells in sums.items():
            cols = [pa.array(np.full(4097, p, np.int32)), pa.array(np.arange(4097)), pa.array(cells.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "cell", "n"])

    got = map_arrow(rows.select("part", "fp"), run, "part int, cell long, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for p, of in got.groupby("part"):
        cells = np.zeros(4097)
        cells[of["cell"]] = of["n"]
        out[int(p)] = (int(cells[-1]), cells[:-1].reshape(64, 64))
    return out


def partition_bits(n: int, both: np.ndarray, m: int, bits: Sequence[int] = range(64)) -> list[list[int]]:
    """m groups of these bits, of near-equal size; each grows from an unused bit by its most correlated unused bits."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    order = np.argsort(-(corr[:, list(bits)].sum(1) - np.diag(corr)), kind="stable").tolist()
    free = [b for b in order if b in set(bits)]
    total = len(free)
    groups = []
    for k in range(m):
        size = total * (k + 1) // m - total * k // m
        group = [int(free.pop(0))]
        while len(group) < size:
            best = max(range(len(free)), key=lambda i: (corr[free[i], group].sum(), -free[i]))
            group.append(int(free.pop(best)))
        groups.append(group)
    return groups


def within(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0..most of these bits (taken as independent)."""
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return np.cumsum(chance)[: most + 1].tolist()


#: Cost of a probe row against a verified candidate.
PROBE, VERIFY = 200.0, 1.0


def allocate(n: int, p: np.ndarray, groups: list[list[int]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """The least estimated cost and thresholds (-1..radius) with sum radius - m + 1, by dynamic programming."""
    m = len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        near = within(p, group, radius)
        cost = {-1: 0.0}
        for t in range(min(radius, len(group)) + 1):
            probes = sum(math.comb(len(group), k) for k in range(t + 1))
            cost[t] = n * (probes * PROBE + n * near[t] * VERIFY)
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, extra in cost.items():
                s = used + t + 1
                if s <= radius + 1 and (s not in after or c + extra < after[s][0]):
                    after[s] = (c + extra, [*ts, t])
        best = after
    return best[radius + 1] if radius + 1 in best else (math.inf, [radius - m + 1] * m)


def plan(n: int, both: np.ndarray, radius: int = RADIUS, bits: Sequence[int] = range(64)) -> tuple[list[list[int]], list[int]]:
    p = np.diag(both) / max(n, 1)
    best = None
    for m in range(1, min(radius + 1, len(bits)) + 1):
        groups = partition_bits(n, both, m, bits)
        cost, ts = allocate(n, p, groups, radius)
        if best is None or cost < best[0]:
            best = (cost, groups, ts)
    return best[1], best[2]


def _gather(v: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(v), np.uint64)
    for k, b in enumerate(bits):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _masks(width: int, most: int) -> np.ndarray:
    return np.array(
        [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.uint64
    )


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, root) that connect what lies within radius bits, directly or over others; breadth first."""
    n = len(fp)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 2048:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        some = np.flatnonzero(near.sum(1) > 1)
    else:
        some = np.arange(n)
    left = some
    a, b = [], []
    while len(left):
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            close = np.bitwise_count(fp[left] ^ fp[front.pop()]) <= radius
            if close.any():
                got, left = left[close], left[~close]
                a.append(got)
                b.append(np.full(len(got), root))
                front.extend(got.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_BUCKET = ["part", "bucket"]
_ROW = "part int, bucket long, fp long, node long"


def links(nodes: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Edges (u, v) of node ids whose forest is that of all links; nodes: fp (distinct), node long.

    A round splits the buckets of all parts at once, each part by its own plan over the bits that its buckets do not fix yet,
    so the number of jobs grows with the depth alone; the first round has one bucket, of everything."""
    rows = nodes.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("bucket"), "fp", "node")
    open_bits: dict[int, list[int]] = {0: list(range(64))}
    found = None
    for depth in range(1, ROUNDS + 1):
        plans: dict[int, list[tuple[int, list[int], np.ndarray]]] = {}
        after: dict[int, list[int]] = {}
        for p, (n, both) in sorted(bit_statistics(rows).items()):
            groups, thresholds = plan(n, both, radius, open_bits[p])
            for g, t in zip(groups, thresholds):
                if t >= 0:
                    plans.setdefault(p, []).append((len(after), g, _masks(len(g), t)))
                    after[len(after)] = [b for b in open_bits[p] if b not in set(g)]
        probed = arrow_map(rows, _prober(plans), _ROW)
        hot = materialise(probed.groupBy(*_BUCKET).count().filter(F.col("count") > dense).select(*_BUCKET), 1)
        parts = {r["part"] for r in hot.select("part").distinct().collect()}
        cold = _searched(probed.join(hot, _BUCKET, "left_anti") if parts else probed, radius)
        found = cold if found is None else found.unionByName(cold)
        if not parts:
            return found
        crowd = materialise(probed.join(hot, _BUCKET, "left_semi").select("part", "bucket", "fp", "node"))
        ends = [p for p in parts if len(after[p]) <= radius or depth == ROUNDS]
        if ends:
            found = found.unionByName(_middle(crowd.filter(F.col("part").isin(ends)).select("fp", "node").distinct(), radius))
        open_bits = {p: after[p] for p in parts if p not in ends}
        if not open_bits:
            break
        rows = crowd.filter(F.col("part").isin(list(open_bits)))
    return found


def _prober(plans: dict[int, list[tuple[int, list[int], np.ndarray]]]):
    """Rows in the buckets of their keys, and of the keys near them, by the plan of their part."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = batch.column("part").to_numpy()
        v = batch.column("fp").to_numpy().view(np.uint64)
        above, node = batch.column("bucket").to_numpy().view(np.uint64), batch.column("node").to_numpy()
        out: list[tuple] = [(np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 3)]
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            for k, group, masks in plans.get(p, []):
                key = _gather(v[at], group)[:, None] ^ masks[None, :]
                # buckets that fall together by chance only add candidates
                bucket = _mixed(key + _mixed(above[at] + np.uint64(p))[:, None]).ravel()
                out.append((np.full(len(bucket), k), bucket.view(np.int64), np.repeat(v[at], len(masks)).view(np.int64), np.repeat(node[at], len(masks))))
        cols = [pa.array(np.concatenate(c)) for c in zip(*out)]
        return pa.RecordBatch.from_arrays([cols[0].cast(pa.int32()), *cols[1:]], ["part", "bucket", "fp", "node"])

    return run


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """Edges of the forest of each bucket."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, _BUCKET):
            part, bucket, fp, node = (t[c].to_numpy() for c in ("part", "bucket", "fp", "node"))
            fp = fp.view(np.uint64)
            edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1]), True])
            us, vs = [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a > 1:
                    i, j = forest(fp[a:b], radius)
                    if len(i):
                        us.append(node[a:b][i])
                        vs.append(node[a:b][j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return map_arrow(rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET), search, "u long, v long")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _middle(nodes: DataFrame, radius: int) -> DataFrame:
    """Links through shared values: within an even radius r exactly if a value is within r / 2 of both. For an odd radius
    there is no such value, so one beyond raises."""
    masks = _masks(64, radius // 2)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, node = batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()
        return pa.RecordBatch.from_arrays(
            [
                pa.array((v[:, None] ^ masks[None, :]).ravel().view(np.int64)),
                pa.array(np.repeat(v, len(masks)).view(np.int64)),
                pa.array(np.repeat(node, len(masks))),
            ],
            ["value", "fp", "node"],
        )

    if radius % 2:
        raise ValueError("links: dense buckets need an even radius")
    small = nodes.repartition(F.col("fp"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield run(batch.slice(a, 500))

    values = map_arrow(small, cuts, "value long, fp long, node long")
    least = values.groupBy("value").agg(F.min("node").alias("v"), F.max("node").alias("w")).filter("v < w").select("value", "v")
    return values.select("value", F.col("node").alias("u")).join(least, "value").filter("u != v").select("u", "v").distinct()


def _labelled(docs: DataFrame, radius: int, dense: int) -> tuple[DataFrame, int]:
    """doc_id, fp, component_id, and the number of documents."""
    fps = materialise(fingerprints(docs))
    n = fps.count()
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), n)
    named = nodes.filter("doc IS NOT NULL").select("fp", F.col("doc").alias("node"))
    # a repeated doc_id can stand for two fingerprints; its rows are linked through that id, as one document
    found = components(links(named, radius, dense), rows=n)
    label = nodes.join(found, nodes.doc == found.node, "left").select(
        "fp", F.coalesce("component", "doc").alias("component_id")
    )
    return fps.join(label, "fp"), n


def simhash(docs: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each document."""
    return _labelled(docs, radius, dense)[0].select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Up to so many ids of later copies (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def one_of_each(docs: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without doc_id stay."""
    found, n = _labelled(docs, radius, dense)
    copies = materialise(found.filter("doc_id != component_id").select("doc_id").distinct(), n)
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))
