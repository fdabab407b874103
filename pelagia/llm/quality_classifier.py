"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scoring.

Tokens are runs of letters and digits (lower-cased; a run in capitals also counts as the token <caps>) and
runs of one punctuation character; a bigram of equal tokens also counts as <again>. Unigrams and bigrams are hashed to `2 ** LOG_BUCKETS` buckets; a feature's
value is its count over the text's number of features. Weights are learnt by FTRL-proximal on a bounded sample
of labelled rows (`sample_docs`, those with the smallest xxhash64 of doc_id, up to `sample_bytes` of features in all) whose crc32(doc_id as text) mod 3
is not 1; the other rows are held out. Labels, lang, source and doc_id are no inputs of a score. The weight
vector has a fixed size and is broadcast.

Defined cases: null or empty text: the score of the intercept alone. No labels of both kinds: every score is
0.5 (predicted 1). Null doc_id: not held out. Repeated rows: each scored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_map, table, within_bytes

LOG_BUCKETS = 18
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_tokens = re.compile(r"[^\W_]+|([^\w\s]|_)\1*").finditer
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Scale of the feature values, so that a text's dot product can move far enough from the intercept.
SCALE = 60.0


def features(strings: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of the texts one after another, and the number of each text's.

    known remembers hashes of tokens; the caller bounds it."""
    flat: list[int] = []
    sizes = []
    for s in strings:
        n = len(flat)
        for m in _tokens(s):
            t = m[0]
            h = known.get(t)
            if h is None:
                h = known[t] = zlib.crc32(t.lower().encode()) | (zlib.crc32(t.encode()) & 1) << 32
                if len(t) > 1 and t.isupper():
                    known[t] = h = h | 1 << 33
            flat.append(h)
        sizes.append(len(flat) - n)
    h = np.array(flat, np.uint64)
    caps = (h >> np.uint64(33)).astype(bool)
    h &= np.uint64(0xFFFFFFFF)
    size = np.array(sizes, np.int64)
    text = np.repeat(np.arange(len(size)), size)
    down = np.uint64(64 - LOG_BUCKETS)
    uni = (h + np.uint64(1)) * _MIX >> down
    pair = text[1:] == text[:-1]
    bi = ((h[:-1] * np.uint64(0x100000001B3) + h[1:]) * _MIX >> down)[pair]
    cap = np.full(int(caps.sum()), 7, np.uint64) * _MIX >> down
    twice = pair & (h[1:] == h[:-1])
    again = np.full(int(twice.sum()), 11, np.uint64) * _MIX >> down
    owner = np.concatenate([text, text[:-1][pair], text[caps], text[1:][twice]])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([uni, bi, cap, again])[order].astype(np.int32), np.bincount(owner, minlength=len(size))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 2.0, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal over rows of (buckets with repeats, label), in the given order; the last weight is the intercept."""
    n = (1 << LOG_BUCKETS) + 1
    z, g2, w = np.zeros(n), np.zeros(n), np.zeros(n)
    for _ in range(epochs):
        for buckets, y in rows:
            idx, count = np.unique(buckets, return_counts=True)
            idx = np.r_[idx, n - 1].astype(np.int64)
            x = np.r_[SCALE * count / max(len(buckets), 1), 1.0]
            zi = z[idx]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(g2[idx])) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(g2[idx] + g * g) - np.sqrt(g2[idx])) / alpha
            z[idx] += g - sigma * wi
            g2[idx] += g * g
    on = np.abs(z) > l1
    w[on] = -(z[on] - np.sign(z[on]) * l1) / ((beta + np.sqrt(g2[on])) / alpha + l2)
    return w


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, sample_bytes: int = 128 << 20) -> np.ndarray | None:
    """Weights from at most sample_docs labelled rows that are not held out, with sample_bytes of features (4 bytes each);
    these come to the driver."""
    picked = (
        labels.select(F.col("doc_id").cast("long"), "quality")
        .filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, size = features([t or "" for t in batch.column("text").to_pylist()], {})
        parts = [x.tobytes() for x in np.split(flat, np.cumsum(size)[:-1])]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.binary())], ["doc_id", "quality", "f"]
        )

    found = arrow_map(rows, run, "doc_id long, quality int, f binary")
    got = within_bytes(found, "f", [F.xxhash64("doc_id"), "doc_id", "f"], sample_bytes).toArrow()
    rows_ = sorted(zip(got["doc_id"].to_pylist(), got["quality"].to_pylist(), got["f"].to_pylist()))
    if len({q for _, q, _ in rows_}) < 2:
        return None
    rng = np.random.default_rng(7)
    return ftrl([(np.frombuffer(rows_[i][2], np.int32), int(rows_[i][1] == 1)) for i in rng.permutation(len(rows_))])


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; weights from train()."""
    ids = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
    w = np.zeros((1 << LOG_BUCKETS) + 1, np.float32) if weights is None else weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    known: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        if len(known) > 300_000:
            known.clear()
        flat, size = features([t or "" for t in batch.column("text").to_pylist()], known)
        end = np.cumsum(size)
        total = np.r_[0.0, np.cumsum(w[flat], dtype=np.float64)]
        dot = SCALE * (total[end] - total[end - size]) / np.maximum(size, 1) + w[-1]
        p = 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    return arrow_map(ids, run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
