"""Byte-level BPE encoding and decoding with numpy matrices.

A text is split by a pattern; each match is encoded by itself. Matches that the worker has not met before are
encoded together: their bytes fill matrices of rows of similar length, padded with -1; in every round each row
merges its leftmost pair of minimum rank, found by an open-addressing hash table of all pairs whose
concatenation is in the vocabulary; rows that have no such pair leave the matrix, and the others are
compacted by one column. Matches over LONG bytes would make wide matrices whose every round is as long as they are: they lie
one after another in a matrix of tiles, where a round takes all places of the least rank at once (for pairs of one rank,
that is the same as the leftmost first) and looks only at the tiles that hold it; merged places stay empty instead
of being compacted. Results equal tiktoken's encode_ordinary.

The vocabulary comes from a file whose path is a parameter; it and the pair table, whose size the vocabulary
bounds, are broadcast. A worker remembers at most CACHE matches.

Defined cases: null or empty text: no ids, digests of the empty string. Repeated rows: each encoded. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_map, long_ids, table

LONG = 128
TILE = 256
CACHE = 200_000
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _odd() -> str:
    """Characters on which the standard library's classes and the Unicode properties of the pattern differ."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    odd: set[str] = set()
    for theirs, ours in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(theirs, every)) ^ set(re.findall(ours, every))
    return "".join(sorted(odd))


class Bpe:
    """ranks: token bytes to id, all 256 single bytes included. pattern: what splits a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for t, i in ranks.items():
            self.tokens[i] = t
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(i)
        self._build(np.array(keys, np.int64), np.array(values, np.int32))
        self.odd = _odd()
        self._start()

    def __getstate__(self):
        gone = {"cache", "ranks", "_split", "_fast", "_odd", "_uncommon"}
        return {k: v for k, v in self.__dict__.items() if k not in gone}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self.ranks = {t: i for i, t in enumerate(self.tokens) if t}
        self.cache: dict[str, bytes] = {}
        self._split = regex.compile(self.pattern).findall
        same = self.pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self._fast = None if r"\p" in same else re.compile(same).findall
        self._odd = frozenset(self.odd)
        common = "".join(c for c in map(chr, range(0x2100)) if c not in self._odd)
        self._uncommon = re.compile(f"[^{re.escape(common)}]").search

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.log = max(4, int(len(keys) * 3).bit_length())
        n = 1 << self.log
        self.slots, self.slot_rank = np.full(n, -1, np.int64), np.full(n, _NONE, np.int32)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.slots[at[left]] < 0
            cand = left[free]
            spot, first = np.unique(at[cand], return_index=True)
            put = cand[first]
            self.slots[spot], self.slot_rank[spot] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & (n - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.log)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where there is none or an id is padding."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        at = self._home(key)
        got = self.slots[at]
        out = np.where(got == key, self.slot_rank[at], _NONE)
        left = np.flatnonzero((got != key) & (got >= 0) & (key >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            got = self.slots[at[left]]
            hit = got == key[left]
            out[left[hit]] = self.slot_rank[at[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        wide: list[int] = []
        for k, p in enumerate(pieces):
            i = self.ranks.get(p)
            if i is not None:
                out[k] = i.to_bytes(4, "little")
            elif len(p) > LONG:
                wide.append(k)
            else:
                by_width.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(k)
        if wide:
            for k, ids in zip(wide, self._tiles([pieces[k] for k in wide])):
                out[k] = ids
        for width, rows in by_width.items():
            for a in range(0, len(rows), 1 << 15):
                self._matrix(pieces, rows[a : a + (1 << 15)], width, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list) -> None:
        raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(-1, width)
        size = np.array([len(pieces[k]) for k in rows])
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], np.int32(-1))
        at = np.array(rows)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            j = rank.argmin(1)
            best = rank[np.arange(len(j)), j]
            over = best == _NONE
            if over.any():
                n = (ids[over] >= 0).sum(1)
                flat = ids[over].astype("<u4")
                for k, row, m in zip(at[over].tolist(), flat, n.tolist()):
                    out[k] = row[:m].tobytes()
                live = ~over
                at, ids, rank, j, best = at[live], ids[live], rank[live], j[live], best[live]
            if not len(at):
                return
            n, w = ids.shape
            r = np.arange(n)
            ids[r, j] = best
            ids = ids[np.arange(w) != (j + 1)[:, None]].reshape(n, w - 1)
            if w == 2:
                rank = np.full((n, 1), _NONE, np.int32)
                continue
            rank = rank[np.arange(w - 1) != j[:, None]].reshape(n, w - 2)
            has = j > 0
            rank[r[has], j[has] - 1] = self.pair_ranks(ids[r[has], j[has] - 1], ids[r[has], j[has]])
            has = j < w - 2
            rank[r[has], j[has]] = self.pair_ranks(ids[r[has], j[has]], ids[r[has], j[has] + 1])

    def _tiles(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of long pieces, which lie in tiles of TILE places, one piece after another with an empty place between."""
        flat = b"\0".join(pieces)
        n = -(-(len(flat) + 2) // TILE) * TILE  # an empty place at the end, which the first place's left neighbour wraps to
        ids = np.full(n, -1, np.int32)
        ids[: len(flat)] = self.byte_ids[np.frombuffer(flat, np.uint8)]
        size = np.array([len(p) for p in pieces])
        begin = np.cumsum(size + 1) - size - 1
        ids[begin[1:] - 1] = -1
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1], before[0] = n - 1, n - 1
        rank = self.pair_ranks(ids, ids[after])
        tiles = rank.reshape(-1, TILE)
        least = tiles.min(1)
        while (r := least.min()) != _NONE:
            held = np.flatnonzero(least == r)
            row, col = np.nonzero(tiles[held] == r)
            at = held[row] * TILE + col
            # of places in a chain (each one's right neighbour is the next), every second stays: the leftmost come first
            linked = np.r_[False, after[at[:-1]] == at[1:]]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0]
            left = before[at]
            if len(at) > 1 and self._lower(ids, after, at, left, r):
                at, left = at[:1], left[:1]
            gone = after[at]
            ids[at], ids[gone] = r, -1
            after[at] = after[gone]
            before[after[at]] = at
            rank[gone] = _NONE
            rank[at] = self.pair_ranks(ids[at], ids[after[at]])
            rank[left] = self.pair_ranks(ids[left], ids[after[left]])
            touched = np.unique(np.concatenate([at, left, gone]) // TILE)
            least[touched] = tiles[touched].min(1)
        whole = [ids[a : a + m] for a, m in zip(begin.tolist(), size.tolist())]
        return [x[x >= 0].astype("<u4").tobytes() for x in whole]

    def _lower(self, ids: np.ndarray, after: np.ndarray, at: np.ndarray, left: np.ndarray, r: int) -> bool:
        """Whether merging these places would make a pair of lower rank, which would then have to come before the next of
        them; a vocabulary that was trained has no such pairs."""
        right, kept = ids[after[after[at]]], ids[at]  # to the right stands what is not merged yet
        ids[at] = r
        found = min(self.pair_ranks(ids[at], right).min(), self.pair_ranks(ids[left], ids[at]).min())
        ids[at] = kept
        return bool(found < r)

    def split(self, text: str) -> list[str]:
        if self._fast is None or self._uncommon(text) and not self._odd.isdisjoint(text):
            return self._split(text)
        return self._fast(text)

    def encode(self, strings: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(s) for s in strings]
        new = set().union(*split).difference(self.cache) if split else set()
        if new and len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*split)
        fresh = list(new)
        self.cache.update(zip(fresh, self.encode_pieces([p.encode() for p in fresh])))
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(path: str, pattern: str) -> Bpe:
    """Reads a rank file (base64 token, space, rank on each line) on the driver."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def encode(docs: DataFrame, bpe: Bpe, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids): ids as binary, little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = shared.value.encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], [key, "ids"])

    return arrow_map(docs.select(F.col(key).cast("long"), text), run, f"{key} long, ids binary")


def decode(ids: DataFrame, bpe: Bpe, key: str = "doc_id") -> DataFrame:
    """Rows (key, bytes): what the ids stand for."""
    shared = ids.sparkSession.sparkContext.broadcast(bpe)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [shared.value.decode(x or b"") for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([long_ids(batch, key), pa.array(raw, pa.binary())], [key, "bytes"])

    return arrow_map(ids.select(F.col(key).cast("long"), "ids"), run, f"{key} long, bytes binary")


def round_trip(docs: DataFrame, bpe: Bpe) -> DataFrame:
    """Encodes each text, decodes the ids and returns digests of both, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = shared.value
        ids = b.encode([t or "" for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                long_ids(batch),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(b.decode(x)).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return arrow_map(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def default_bpe(name: str = "byte_bpe_multi_50k.tiktoken") -> Bpe:
    import public_tokenizers

    return load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_bpe())
