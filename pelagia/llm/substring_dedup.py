"""Substring dedup by De Bruijn compaction.

Word windows of `length` words are edges between nodes of `length - 1` words. Candidate stretches meet by
anchor (see routing), so that all edges that could be equal stand in one place; there the graph of the
distinct stretches is built, every node that branches, or at which a stretch begins or ends, is a junction, and
the paths between junctions are compacted. As no path has a source that begins or ends inside it, all its edges
have the same sources, and the smallest doc_id of its first edge, checked against the other edges' source
coordinates, decides for the whole path. The paths come back to their documents by a Spark join on source
coordinates, where neighbouring ones merge into maximal spans. (No global pointer jumping between anchors: the
spans do not need it.)

A word is removed if a window that covers it also occurs in a document with a smaller doc_id.

Defined cases: null text has no words; texts under `length` words lose nothing; repeats inside one document alone
stay; rows with one doc_id do not repeat each other; a null doc_id comes after all others. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pelagia.llm.common import arrow_map, table
from pelagia.llm.routing import LAST, Plan, covered, with_repeats, word_sections, word_units

LENGTH = 13
#: Words of an anchor.
GRAM = 5


def window_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """Numbers that are equal exactly for equal windows of `length` ids (a window may run over the end)."""
    rank, got = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    n = len(ids)
    while got < length:
        step = min(got, length - got)
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        got += step
    return rank


def compact(stretch: list[bytes], doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the De Bruijn graph of these stretches as they occur: stretch, first edge, edges, smallest doc_id."""
    number: dict[bytes, int] = {}
    words = [s.split(b" ") for s in stretch]
    size = np.array([len(w) + 1 for w in words], np.int64)
    ids = np.array([i for w in words for i in (*(number.setdefault(x, len(number) + 1) for x in w), 0)], np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    offset = np.arange(len(ids)) - first[owner]
    node = window_ranks(ids, length - 1)
    at = np.flatnonzero(offset + length < size[owner])  # positions of edges
    edge = np.unique(node[at] * (len(ids) + 1) + node[at + 1], return_inverse=True)[1]
    least = np.full(edge.max() + 1, LAST)
    np.minimum.at(least, edge, doc[owner[at]])
    one = np.unique(edge, return_index=True)[1]
    n = int(node.max()) + 1
    out, into = np.bincount(node[at[one]], minlength=n), np.bincount(node[at[one] + 1], minlength=n)
    junction = (out != 1) | (into != 1)
    junction[node[first]] = True
    junction[node[first + size - length]] = True
    new = np.r_[True, (owner[at[1:]] != owner[at[:-1]]) | junction[node[at[1:]]]]
    begin = np.flatnonzero(new)
    smallest = least[edge[begin]]
    if not np.array_equal(smallest, np.maximum.reduceat(least[edge], begin)):
        raise AssertionError("compact: a path's edges have different sources")
    return owner[at[begin]], offset[at[begin]], np.diff(np.r_[begin, len(at)]), smallest


def _resolver(length: int):
    def resolve(d, start, text):
        owner, offset, edges, least = compact(text, d, length)
        hit = np.flatnonzero(least < d[owner])
        return owner[hit], offset[hit], edges[hit]

    return resolve


def plan(length: int = LENGTH) -> Plan:
    if length < GRAM + 1:
        raise ValueError(f"substring_dedup: length must be over {GRAM}")

    def pieces(text: bytes, at: list[tuple[int, int]]) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[s : s + n - 1 + length]) for s, n in at]

    return Plan(lambda docs: word_units(docs, GRAM), length, GRAM, pieces, _resolver(length), False, word_sections)


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (words left, joined by one space), n_words, n_removed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(4)]
        for d, t, gone in zip(
            batch.column("d").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()
        ):
            words = t.split()
            n = len(words)
            lost = 0
            if gone:
                mask = covered(n, gone, length)
                lost = int(mask.sum())
                words = [w for w, m in zip(words, mask.tolist()) if not m]
            for col, v in zip(cols, (None if d == LAST else d, b" ".join(words), n, lost)):
                col.append(v)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        out = [pa.array(c, k) for c, k in zip(cols, kinds)]
        out[1] = out[1].cast(pa.string())
        return pa.RecordBatch.from_arrays(out, ["doc_id", "kept", "n_words", "n_removed"])

    found = with_repeats(docs, plan(length)).select("d", "text", "gone")
    return arrow_map(found, run, "doc_id long, kept string, n_words long, n_removed long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h, md5(array_to_string(w[i:i + 12], ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT h, m, min(doc_id) AS first FROM g GROUP BY h, m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (h, m) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
