"""Suffix-array dedup by longest previous factors.

Every byte covered by a string of `length` bytes that also starts earlier in the corpus (smaller doc_id, or
earlier in the same document) is removed; the first copy stays. Candidate stretches of text meet by anchor (see
routing); there they are put in corpus order into one text. Its window starts get a suffix array with LCP values (both
up to `length` bytes, as no longer factor is asked for); the previous and next smaller positions of each in suffix order
give its longest previous factor, and where that reaches `length`, a window is a later copy. What routing settles before by
128 bits of hash are stretches that repeat another as a whole.

Defined cases: null text is empty; texts under `length` bytes lose nothing; overlapping repeats of one text
count; repeated rows (same doc_id and text) get the same answer and do not repeat each other; a null doc_id
comes after all others. Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagia.llm.common import arrow_map, table
from pelagia.llm.routing import LAST, Plan, byte_sections, byte_units, covered, with_repeats

LENGTH = 100
#: Bytes of an anchor.
GRAM = 24


def suffix_array(text: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into `starts` (ascending positions) in the order of the first `depth` bytes of the suffixes there, ties in
    text order, and each one's common prefix with its predecessor, up to depth.

    Eight bytes at a time; a suffix keeps its place as soon as no other shares its prefix. Past its end the text counts as
    zero bytes in the order, so zero bytes of its own must not stand within `depth` bytes of its end."""
    n = len(text)
    eight = np.empty(n + 8, np.uint64)
    pad = text + bytes(16)
    for o in range(8):
        eight[o::8] = np.frombuffer(pad, ">u8", len(range(o, n + 8, 8)), o)
    order, lcp = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    place = np.arange(len(starts))  # in the order, of suffixes that share their prefix with a neighbour
    group = np.zeros(len(starts), np.int64)
    done = 0
    while done < depth and len(place):
        here = order[place]
        key = eight[np.minimum(starts[here] + done, n)]
        if depth - done < 8:
            key = key & ~np.uint64((1 << 8 * (8 - (depth - done))) - 1)
        by = np.lexsort((key, group))
        key = key[by]
        order[place] = here[by]
        parted = np.r_[False, (key[1:] != key[:-1]) & (group[1:] == group[:-1])]
        differ = key[parted] ^ key[np.flatnonzero(parted) - 1]
        lcp[place[parted]] = done + sum((differ < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        new = parted | np.r_[True, group[1:] != group[:-1]]
        group = np.cumsum(new)
        shared = ~new | ~np.r_[new[1:], True]
        place, group = place[shared], group[shared]
        done += 8
    if len(place):
        lcp[place[np.r_[False, group[1:] == group[:-1]]]] = depth
    room = n - starts[order]
    return order, np.minimum(lcp, np.minimum(room, np.r_[0, room[:-1]]))


def _smaller(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with its previous smaller position in suffix order (0: none, or less than `least`).

    All suffixes jump at once: what lies between a suffix and the one it looks at is larger than itself, so it may take over
    that one's own jump."""
    back, common = np.arange(len(order)) - 1, lcp.copy()
    live = np.flatnonzero(common >= max(least, 1))
    while len(live := live[order[back[live]] > order[live]]):
        at = back[live]
        common[live], back[live] = np.minimum(common[live], common[at]), back[at]
        live = live[(common[live] >= max(least, 1)) & (back[live] >= 0)]
    return np.where((back >= 0) & (order[back] < order) & (common >= least), common, 0)


def longest_previous_factor(text: bytes, starts: np.ndarray, depth: int, least: int = 1) -> np.ndarray:
    """For each of these (ascending) positions the longest match, up to `depth` bytes, with an earlier one of them: the better
    of its previous and next smaller position in suffix order. Matches under `least` bytes may be given as 0."""
    order, lcp = suffix_array(text, starts, depth)
    before = _smaller(order, lcp, least)
    after = _smaller(order[::-1], np.r_[0, lcp[:0:-1]] if len(lcp) else lcp, least)[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _resolver(length: int):
    def resolve(d, start, text):
        order = np.lexsort((start, d))  # the order of the corpus
        flat = b"\xff".join(text[i] for i in order) + b"\xff"
        size = np.array([len(text[i]) + 1 for i in order], np.int64)
        windows = size - length
        owner = np.repeat(np.arange(len(order)), windows)
        offset = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
        factor = longest_previous_factor(flat, (np.cumsum(size) - size)[owner] + offset, length, length)
        at = np.flatnonzero(factor >= length)
        if not len(at):
            return at, at, at
        runs = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
        return order[owner[at[runs]]], offset[at[runs]], np.diff(np.r_[runs, len(at)])

    return resolve


def plan(length: int = LENGTH) -> Plan:
    if length < GRAM + 1:
        raise ValueError(f"suffix_dedup: length must be over {GRAM}")

    def pieces(text: bytes, at: list[tuple[int, int]]) -> list[bytes]:
        return [text[s : s + n - 1 + length] for s, n in at]

    return Plan(lambda docs: byte_units(docs, GRAM), length, GRAM, pieces, _resolver(length), True, byte_sections)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """d, text, row, gone for every document: gone lists repeated windows (see routing.with_repeats)."""
    return with_repeats(docs, plan(length))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        for d, t, gone in zip(
            batch.column("d").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()
        ):
            mask = covered(len(t), gone, length) if gone else None
            n = 0 if mask is None else int(mask.sum())
            kept = t if not n else np.frombuffer(t, np.uint8)[~mask].tobytes()
            spans = 0 if not n else int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            for col, v in zip(cols, (None if d == LAST else d, len(t), n, spans, hashlib.sha256(kept).hexdigest())):
                col.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )

    return arrow_map(
        suffix_dedup(docs, length).select("d", "text", "gone"),
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the text that is left, on whole characters (one that a removed byte belongs to goes as a whole)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()):
            if gone:
                raw = np.frombuffer(t, np.uint8)
                mask = covered(len(t), gone, length)
                char = np.cumsum((raw & 0xC0) != 0x80)
                t = raw[~np.isin(char, char[mask])].tobytes()
            out.append(t.decode(errors="replace"))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("rest")], ["text", "rest"])

    found = with_repeats(docs, plan(length), rest=True).select("text", "gone", "rest")
    left = arrow_map(found, run, T.StructType([T.StructField("text", T.StringType()), found.schema["rest"]]))
    return left.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
h AS (SELECT doc_id, i, md5(array_slice(x, i + 1, i + 100)) AS m
      FROM (SELECT doc_id, x, unnest(range(0, octet_length(x) - 99)) AS i FROM d WHERE octet_length(x) >= 100)),
later AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM later),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
kept AS (SELECT doc_id, string_agg(hex(array_slice(x, z + 1, a)), '' ORDER BY a) || hex(array_slice(any_value(x), max(b) + 1, octet_length(any_value(x)))) AS k,
         sum(b - a) AS n, count(*) AS c FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.x) AS BIGINT) AS n_bytes, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(kept.c, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept.k IS NULL THEN d.x ELSE unhex(kept.k) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
