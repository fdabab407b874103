"""Benchmark decontamination with an FM-index over each training shard.

A shard is a slice of a task's texts. Its words become the benchmark's word numbers (0 for every other word);
only runs of benchmark words long enough to hold a window are indexed, which loses nothing. The index is a
suffix array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix with popcount ranks, and
suffix positions sampled every SAMPLE words. All windows are searched backward together; occurrences are
located by walking to the next sampled position, and become spans that are merged within each document.

The benchmark is collected on the driver and broadcast only up to `max_words` words; a larger one is taken in
blocks of items, one pass each, whose spans are merged by document afterwards.

Defined cases: null or empty text: no words, no hits, the digest of the empty string, not contaminated.
Benchmark rows without words, or with a null item_id, match nothing; repeated items count once. Empty
benchmark: nothing is hit. Repeated documents: each judged. Other columns travel in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.llm.common import ALNUM, arrow_map, materialise, table, texts

WINDOW = 8
SAMPLE = 8
SHARD_BYTES = 8_000_000
#: Words of the benchmark that are broadcast at once.
MAX_WORDS = 5_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix order of a number sequence by prefix doubling."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(s[1:] != s[:-1])
        rank = new
        if n == 1 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((-len(bits)) % 64 + 64, bool)
        self.words = np.packbits(np.r_[bits, pad], bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[int, Bits, int]] = []
        s = symbols
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (s >> b) & 1 == 1
            self.levels.append((b, Bits(bit), int((~bit).sum())))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        a = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one = (c >> b) & 1 == 1
            ra, ri = bits.rank(a), bits.rank(i)
            a = np.where(one, zeros + ra, a - ra)
            i = np.where(one, zeros + ri, i - ri)
        return i - a

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            out |= one.astype(np.int64) << b
            i = np.where(one, zeros + r, i - r)
        return out


class FmIndex:
    """Over symbols >= 0; a terminator below all of them is added."""

    def __init__(self, symbols: np.ndarray):
        t = np.r_[symbols.astype(np.int64) + 1, 0]
        order = suffix_array(t)
        self.n = len(t)
        bwt = t[order - 1]
        self.wavelet = WaveletMatrix(bwt, int(t.max()))
        self.first = np.r_[0, np.cumsum(np.bincount(t))]
        keep = order % SAMPLE == 0
        self.sampled, self.samples = Bits(keep), order[keep]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open suffix ranges of rows of `patterns`, each right-aligned and `sizes` long."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        top = len(self.first) - 2
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((width - 1 - k < sizes) & (hi > lo))
            c = patterns[live, k] + 1
            known = c <= top
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            if len(live):
                lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
                hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these places of the suffix order."""
        out, left, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.sampled.get(at)
            out[left[done]] = self.samples[self.sampled.rank(at[done])] + steps
            left, at = left[~done], at[~done]
            c = self.wavelet.access(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of benchmark items as word numbers, and the items of each."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray  # right-aligned
    sizes: np.ndarray
    items: list[list[str]]


def phrases(rows: Iterable[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in rows:
        words = (text or "").encode().translate(ALNUM).split()
        if item is None or not words:
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]
        for i in range(max(1, len(ids) - window + 1)):
            found.setdefault(tuple(ids[i : i + window]), set()).add(str(item))
    patterns = np.zeros((len(found), window), np.int64)
    for row, p in zip(patterns, found):
        row[window - len(p) :] = p
    return Phrases(vocabulary, patterns, np.array([len(p) for p in found], np.int64), [sorted(x) for x in found.values()])


def find(strings: list[bytes], p: Phrases) -> tuple[np.ndarray, list[np.ndarray | None], list[set[str]]]:
    """Of each text: its number of words, which words are hit (None: none), the items with occurrences."""
    get = p.vocabulary.get
    flat: list[np.ndarray] = []
    size = np.zeros(len(strings), np.int64)
    zero = np.zeros(1, np.int32)
    for i, s in enumerate(strings):
        words = s.translate(ALNUM).split()
        size[i] = len(words)
        flat += [np.array([get(w, 0) for w in words], np.int32), zero]
    cover: list[np.ndarray | None] = [None] * len(strings)
    items: list[set[str]] = [set() for _ in strings]
    if not len(p.sizes) or not strings:
        return size, cover, items
    ids = np.concatenate(flat)
    begin = np.cumsum(size + 1) - size - 1  # of each text in ids; a 0 ends it
    known = np.r_[False, ids > 0, False]
    edge = np.flatnonzero(known[1:] != known[:-1])
    a, b = edge[::2], edge[1::2]
    long = b - a >= p.sizes.min()
    a, b = a[long], b[long]
    if not len(a):
        return size, cover, items
    n = b - a + 1  # with the 0 after the run
    start = np.cumsum(n) - n
    source = np.arange(n.sum()) + np.repeat(a - start, n)
    index = FmIndex(ids[source])
    lo, hi = index.search(p.patterns, p.sizes)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    at = source[index.locate(rows)]
    text = np.searchsorted(begin, at, side="right") - 1
    first = at - begin[text]
    last = first + p.sizes[which]
    if not len(text):
        return size, cover, items
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    for i in np.split(order, cuts):
        _mark(cover, items, size, int(text[i[0]]), first[i], last[i], which[i], p)
    return size, cover, items


def _mark(cover, items, size, t, first, last, which, p) -> None:
    edges = np.zeros(size[t] + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last, -1)
    cover[t] = np.cumsum(edges)[:-1] > 0
    for k in np.unique(which).tolist():
        items[t].update(p.items[k])


def _blocks(benchmark: DataFrame, max_words: int) -> list[Phrases]:
    """Phrase sets of at most about max_words words each; one block in the usual case."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    n = max(1, -(-int(total) // max_words))
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    return [phrases((r["item"], r["text"]) for r in rows.filter(part == k).collect()) for k in range(n)]


_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]
#: (texts, their numbers of words, hit spans of words, items) to columns
Finish = Callable[[list[bytes], np.ndarray, list[np.ndarray], list[list[str]]], list[pa.Array]]


def _as_found(strings: list[bytes], size: np.ndarray, spans: list[np.ndarray], items: list[list[str]]) -> list[pa.Array]:
    return [pa.array(size, pa.int64()), pa.array([x.tobytes() for x in spans], pa.binary()), pa.array(items, pa.list_(pa.string()))]


def _apply(docs: DataFrame, benchmark: DataFrame, max_words: int, finish: Finish, fields: list[T.StructField]) -> DataFrame:
    """rest (a struct of all columns of docs but the text) and what finish makes of the hits; one pass over the texts
    if the benchmark is one block."""
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, max_words)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    if len(blocks) == 1:
        docs = docs.select(rest.alias("rest"), "text")
        return arrow_map(docs, _finder(sc.broadcast(blocks[0]), "rest", finish, fields), T.StructType([docs.schema["rest"], *fields]), SHARD_BYTES)
    docs = materialise(docs.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), "text"))
    row = docs.schema["row"]
    found = None
    for block in blocks:
        part = arrow_map(docs.select("row", "text"), _finder(sc.broadcast(block), "row", _as_found, _FOUND), T.StructType([row, *_FOUND]), SHARD_BYTES)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.collect_list("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for n, some in zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist()):
            c = np.zeros(n, bool)
            for a, b in np.frombuffer(b"".join(some), np.int64).reshape(-1, 2):
                c[a:b] = True
            spans.append(_runs(c))
        size, items = batch.column("n_words").to_numpy(), batch.column("items").to_pylist()
        return pa.RecordBatch.from_arrays([batch.column("rest"), *finish(texts(batch), size, spans, items)], ["rest", *(f.name for f in fields)])

    return arrow_map(docs.join(merged, "row"), join, T.StructType([docs.schema["rest"], *fields]))


def _finder(shared: Broadcast, key: str, finish: Finish, fields: list[T.StructField]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        strings = texts(batch)
        size, cover, items = find(strings, shared.value)
        none = np.zeros((0, 2), np.int64)
        out = finish(strings, size, [none if c is None else _runs(c) for c in cover], [sorted(x) for x in items])
        return pa.RecordBatch.from_arrays([batch.column(key), *out], [key, *(f.name for f in fields)])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """rest (a struct of all columns of docs but the text), n_words long, spans binary (pairs of int64: merged word
    spans), items array<string>."""
    return _apply(docs, benchmark, max_words, _as_found, _FOUND)


def _runs(c: np.ndarray) -> np.ndarray:
    """Start and end of each run of True."""
    p = np.r_[False, c, False]
    return np.flatnonzero(p[1:] != p[:-1]).astype(np.int64).reshape(-1, 2)


def without_spans(text: bytes, spans: np.ndarray) -> str:
    """The text without the hit words and what stands between words of one span."""
    at = [m.span() for m in _WORD.finditer(text)] if len(spans) else []
    out, last = [], 0
    for a, b in spans.tolist():
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    out.append(text[last:])
    return b"".join(out).decode(errors="ignore")


def without_hits(docs: DataFrame, benchmark: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with the hit spans cut out of their texts; a null text becomes empty."""

    def cut(strings: list[bytes], size: np.ndarray, spans: list[np.ndarray], items: list[list[str]]) -> list[pa.Array]:
        return [pa.array(list(map(without_spans, strings, spans)), pa.string())]

    left = _apply(docs, benchmark, max_words, cut, [T.StructField("text", T.StringType())])
    return left.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


_DIGEST = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")],
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, max_words: int = MAX_WORDS) -> DataFrame:
    def digest(strings: list[bytes], size: np.ndarray, spans: list[np.ndarray], items: list[list[str]]) -> list[pa.Array]:
        return [
            pa.array(size, pa.int64()),
            pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
            pa.array([len(x) >= least_items for x in items], pa.bool_()),
        ]

    found = _apply(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, max_words, digest, _DIGEST)
    return found.select("rest.doc_id", *(f.name for f in _DIGEST))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + 7], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0 AND item_id IS NOT NULL)),
sizes AS (SELECT DISTINCT n FROM p),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT q.doc_id, q.i, q.n, p.item_id FROM spots q JOIN p USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
