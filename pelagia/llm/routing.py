"""Brings equal windows of a corpus together without sending every window.

A window is `length` consecutive units (bytes or words) of one document. Each picks an anchor: the leftmost
of its `gram`-unit grams with the least hash. Equal windows pick the same anchor at the same place, and
consecutive windows mostly share theirs; a run of windows with one anchor is a stretch, about twice a window
long. Two exchanges, both aggregated in the task first, settle what repeats:

1. stretches, as hashes: a task sends each distinct (anchor, text hash) once, by its earliest row, so a
   passage in a third of all rows costs a row for each task; the others are settled on the spot. Where they meet,
   all but the earliest of an identical stretch are settled.
2. texts: only where one anchor has different stretches do their texts meet, one for each distinct stretch, and
   the caller's `resolve` decides which of their windows are repeats. An anchor with a crowd of different stretches (a
   gram that a third of all rows may hold, in ever new surroundings) is salted: its stretches are cut into single windows
   that meet by the window's own hash, and are resolved in the same way, so no anchor fills a task.

The first exchange brings the hashes of one anchor into one task (48 bytes a stretch), which holds MEET of them at most:
a group that goes on is reduced to its different stretches, and once these are a crowd they pass through.

Identity of stretches is decided on 128 bits (anchor and text hash). Rows are told apart by doc_id together with a hash of
their text, so repeated rows share one answer; a null doc_id counts as larger than all others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import cut, map_arrow, whole_groups

LAST = 2**63 - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block prefixes and suffixes."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full((-len(x)) % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


@dataclass
class Units:
    """A batch of documents as one sequence of units. text[start[i]:end[j]] are the bytes of units i..j."""

    text: bytes
    grams: np.ndarray  # hash of the gram that starts at each unit, for all units but the last few
    first: np.ndarray  # of each document, its first unit; one more at the end
    start: np.ndarray | None  # byte offsets; None: units are bytes
    end: np.ndarray | None
    sums: np.ndarray  # of the bytes times powers of a base, before each byte

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes of units a..b-1."""
        x, y = (a, b) if self.start is None else (self.start[a], self.end[b - 1])
        _, down = _power_tables(len(self.text) + 1)
        return mix((self.sums[y] - self.sums[x]) * down[x] + (y - x).astype(np.uint64))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1_200_000)
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, np.uint64(b))]) for b in (base, inverse)]
    return _powers[0], _powers[1]


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(raw) + 1)
    return np.r_[np.uint64(0), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)]


def byte_units(docs: list[bytes], gram: int) -> Units:
    """Grams of `gram` bytes, 8 to 64."""
    text = b"".join(docs)
    first = np.r_[0, np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))]
    n = len(text)
    pad = text + bytes(72)
    eight = np.empty(n + 64, np.uint64)
    for o in range(8):
        m = len(range(o, n + 64, 8))
        eight[o::8] = np.frombuffer(pad, "<u8", m, o)
    h = eight[:n] * _B
    for at in (*range(8, gram - 8, 8), gram - 8):
        h = (h ^ (h >> np.uint64(31)) ^ eight[at : at + n]) * _A
    return Units(text, mix(h), first, None, None, _sums(np.frombuffer(text, np.uint8)))


def word_units(docs: list[bytes], gram: int = 4) -> Units:
    """Words between white space; grams of `gram` words. The text holds the words joined by one space."""
    split = [d.split() for d in docs]
    text = b" ".join(b" ".join(w) for w in split if w)
    first = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
    raw = np.frombuffer(text, np.uint8)
    space = np.flatnonzero(raw == 32)
    start, end = (np.r_[0, space + 1], np.r_[space, len(raw)]) if len(raw) else (space, space)
    sums, down = _sums(raw), _power_tables(len(raw) + 1)[1]
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    n = len(word)
    h = word.copy()
    for k in range(1, gram):
        h = h * _A
        h[: max(n - k, 0)] += word[k:]
        h = mix(h)
    return Units(text, h, first, start, end, sums)


def stretches(u: Units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document, first window (unit of the batch), windows, anchor hash."""
    n = len(u.grams)
    w = length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length or n >= 1 << 26:
        if n >= 1 << 26:
            raise ValueError("stretches: cut the batch")
        return none, none, none, none.view(np.uint64)
    low = np.uint64((1 << 26) - 1)
    least = sliding_min((u.grams & ~low) | np.arange(n, dtype=np.uint64), w)
    doc = np.repeat(np.arange(len(u.first) - 1), np.diff(u.first))
    room = u.first[1:][doc] - np.arange(n)
    ok = np.flatnonzero(room[: len(least)] >= length)
    if not len(ok):
        return none, none, none, none.view(np.uint64)
    anchor = (least[ok] & low).astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)])
    size = np.diff(np.r_[begin, len(ok)])
    return doc[ok[begin]], ok[begin], size, u.grams[anchor[begin]]




@dataclass
class Plan:
    units: Callable[[list[bytes]], Units]
    length: int
    gram: int
    #: bytes of windows start..start+n-1 of a text, for a list of (start, n)
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    #: (doc, start, text) of different stretches of one anchor or more to (numbers, first window, windows) that are repeats
    resolve: Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: whether an equal window earlier in the same document counts
    within: bool
    #: cuts a long text: (first unit, bytes) of sections of about a number of bytes, each with some units of the next
    sections: Callable[[bytes, int, int], Iterator[tuple[int, bytes]]]
    batch: int = 1_000_000
    held: int = 400_000  # stretches that a task holds before it sends them
    crowd: int = 2_000  # an anchor with more different stretches is dealt out by window


def keyed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """d (doc_id, null last), row (hash of doc_id and text), text; with rest, a struct of all columns but the text."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.coalesce(F.col("text"), F.lit(""))
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] if rest else []
    return docs.select(d.alias("d"), text.alias("text"), F.xxhash64(d, text).alias("row"), *more)


def _column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def byte_sections(text: bytes, step: int, more: int) -> Iterator[tuple[int, bytes]]:
    for a in range(0, len(text), step):
        yield a, text[a : a + step + more]


_SPACE, _WORD = re.compile(rb"[ \t-\r]"), re.compile(rb"[^ \t-\r]+")


def word_sections(text: bytes, step: int, more: int) -> Iterator[tuple[int, bytes]]:
    at = first = 0
    while at < len(text):
        space = _SPACE.search(text, at + step)
        end = tail = space.start() if space else len(text)
        for _, word in zip(range(more), _WORD.finditer(text, end)):
            tail = word.end()
        yield first, text[at:tail]
        first += sum(1 for _ in _WORD.finditer(text, at, end))
        at = end


def _sections(batch: pa.RecordBatch, p: Plan) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Rows of a batch, the first unit and the texts; a long text comes in sections that share length - 1 units, so
    that no window is lost and what a task holds does not grow with the text."""
    for part in cut(batch, p.batch):
        strings = _column(part, "text")
        if len(strings) == 1 and len(strings[0]) > 2 * p.batch:
            for first, section in p.sections(strings[0], p.batch, p.length - 1):
                yield part, first, [section]
        else:
            yield part, 0, strings


def _same(*cols: np.ndarray) -> np.ndarray:
    """Whether each element but the first equals its predecessor in all columns."""
    out = np.ones(max(len(cols[0]) - 1, 0), bool)
    for c in cols:
        out &= c[1:] == c[:-1]
    return out


def _later(k: np.ndarray, s: np.ndarray, d: np.ndarray, start: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches, an order by (anchor, hash, document, start), and which of the ordered ones repeat an identical one."""
    order = np.lexsort((start, d, s, k))
    same = np.r_[False, _same(k[order], s[order])]
    if within:
        # the earliest of a group stays; so do repeated rows, which stand at the very same place
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        return order, same & ((d[order] != d[order][lead]) | (start[order] != start[order][lead]))
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order, d[order] != d[order][lead]


_SENT = "k long, s long, d long, row long, p long"
_ENTRY = "row long, d long, k long, p long"
_TEXT = "k long, d long, row long, start int, n int, text binary, gone binary"
_GONE = "row long, d long, gone binary"
#: Stretches that a task holds of one anchor before it reduces them.
MEET = 200_000


def _pack(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 24) | n


def entries(rows: DataFrame, p: Plan) -> DataFrame:
    """row, d, k, p (start << 24 | windows): stretches that repeat an identical one wholly (k null), and those that share
    anchor k with a different one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            k, s, d, row, pos = (np.concatenate(c) for c in zip(*held))
            order, lost = _later(k, s, d, pos, p.within)
            keep, gone = np.sort(order[~lost]), np.sort(order[lost])
            nothing = np.zeros(len(gone), np.int64)
            # what is settled here needs no partner: it travels by its row
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([k[keep], row[gone]])),
                    pa.array(np.concatenate([s[keep], nothing]), mask=np.r_[np.zeros(len(keep), bool), np.ones(len(gone), bool)]),
                    pa.array(np.concatenate([d[keep], d[gone]])),
                    pa.array(np.concatenate([row[keep], row[gone]])),
                    pa.array(np.concatenate([pos[keep], pos[gone]])),
                ],
                ["k", "s", "d", "row", "p"],
            )

        for batch in batches:
            for part, base, strings in _sections(batch, p):
                u = p.units(strings)
                doc, begin, size, h = stretches(u, p.length, p.gram)
                if not len(h):
                    continue
                s = u.hashes(begin, begin + size - 1 + p.length).view(np.int64)
                d, row = part.column("d").to_numpy()[doc], part.column("row").to_numpy()[doc]
                held.append([h.view(np.int64), s, d, row, _pack(begin - u.first[doc] + base, size)])
                count += len(h)
                if count > p.held:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # columns k, s, d, row, p, settled in rows
        count, hot = 0, None  # hot: an anchor whose stretches passed through already

        def out(gone: np.ndarray, mixed: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
            """gone, mixed: columns k, s, d, row, p, settled of stretches that are done, and of those whose texts must meet."""
            free = np.r_[np.ones(gone.shape[1], bool), np.zeros(mixed.shape[1], bool)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([gone[3], mixed[3]])),
                    pa.array(np.concatenate([gone[2], mixed[2]])),
                    pa.array(np.concatenate([gone[0], mixed[0]]), mask=free),
                    pa.array(np.concatenate([gone[4], mixed[4] | (crowded.astype(np.int64) << 60)])),
                ],
                ["row", "d", "k", "p"],
            )

        def reduced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Done, kept, and the number of different stretches of each kept one's anchor."""
            live = np.flatnonzero(x[5] == 0)
            k, s, d, _, pos, _ = x[:, live]
            order, lost = _later(k, s, d, pos, p.within)
            kept = live[order[~lost]]
            kk, ks = x[0][kept], x[1][kept]
            gone = x[:, np.concatenate([np.flatnonzero(x[5]), live[order[lost]]])]
            if not len(kept):
                return gone, x[:, kept], kept
            group = np.cumsum(np.r_[True, ~_same(kk)]) - 1
            texts = np.bincount(group, weights=np.r_[True, ~_same(kk, ks)]).astype(np.int64)
            return gone, x[:, kept], texts[group]

        def judged(x: np.ndarray) -> pa.RecordBatch:
            gone, kept, texts = reduced(x)
            crowded = (texts > p.crowd) | (kept[0] == hot if hot is not None else False)
            mixed = (texts > 1) | crowded
            return out(gone, kept[:, mixed], crowded[mixed])

        def columns(batch: pa.RecordBatch) -> np.ndarray:
            col = batch.column("s")
            rest = [batch.column(c).to_numpy() for c in ("d", "row", "p")]
            return np.stack([batch.column("k").to_numpy(), col.fill_null(0).to_numpy(), *rest, col.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])

        for batch in batches:
            if batch.num_rows:
                held.append(columns(batch))
                count += batch.num_rows
            if count < MEET // 2:
                continue
            x = np.concatenate(held, axis=1)
            last = int(np.searchsorted(x[0], x[0][-1]))
            if last:
                yield judged(x[:, :last])
            x = x[:, last:]
            if x.shape[1] > MEET // 2:
                gone, kept, texts = reduced(x)
                if (texts > p.crowd).any() or kept.shape[1] and kept[0][0] == hot:
                    hot = kept[0][0]
                    yield out(gone, kept, np.ones(kept.shape[1], bool))
                    x = x[:, :0]
                else:
                    yield out(gone, kept[:, :0], np.zeros(0, bool))
                    x = kept
            held, count = [x], x.shape[1]
        if count:
            yield judged(np.concatenate(held, axis=1))

    sent = map_arrow(rows, send, _SENT)
    return map_arrow(sent.repartition("k").sortWithinPartitions("k"), meet, _ENTRY)


def repeats(rows: DataFrame, p: Plan) -> DataFrame:
    """row, d, gone: array of binaries, each pairs of int64 (first window, windows) that are repeats. rows: from keyed()."""
    lists = entries(rows, p).groupBy("row", "d").agg(F.collect_list(F.struct("k", "p")).alias("entries"))
    joined = rows.repartition("row", "d").join(lists, ["row", "d"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[bytes, tuple[int, int, int]] = {}  # of crowds: the earliest place of each

        def crowd() -> pa.RecordBatch:
            rows = [(xxhash.xxh64_intdigest(t) - (1 << 63), d, r, x, 1, t, None) for t, (d, x, r) in windows.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), kinds)], names)

        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 2
        names = ["k", "d", "row", "start", "n", "text", "gone"]
        for batch in batches:
            for part in cut(batch, p.batch):
                cols: list[list] = [[] for _ in range(7)]
                flat = part.column("entries").flatten()
                k = flat.field("k")
                free = k.is_null().to_numpy(zero_copy_only=False)
                key = k.fill_null(0).to_numpy()
                pos = flat.field("p").to_numpy()
                ends = np.cumsum(part.column("entries").value_lengths().to_numpy())
                d, row = part.column("d").to_pylist(), part.column("row").to_pylist()
                text = part.column("text").cast(pa.binary())
                for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                    f, q = free[a:b], pos[a:b]
                    if f.any():
                        spans = merge(np.stack([q[f] >> 24, q[f] & 0xFFFFFF], 1))
                        for col, v in zip(cols, (row[i], d[i], row[i], 0, 0, None, spans.tobytes())):
                            col.append(v)
                    many = q >> 60 == 1
                    if many.any():
                        q = q & ~(1 << 60)
                        at = [(x + j, 1) for x, n in zip((q[many] >> 24).tolist(), (q[many] & 0xFFFFFF).tolist()) for j in range(n)]
                        lost = []
                        for (x, _), w in zip(at, p.cut(text[i].as_py(), at)):
                            here = (d[i], x, row[i])
                            seen = windows.get(w)
                            if seen is None or seen[2] != row[i] and seen[0] == d[i]:
                                if seen is None:
                                    windows[w] = here
                                else:  # another row with this doc_id
                                    for col, v in zip(cols, (xxhash.xxh64_intdigest(w) - (1 << 63), d[i], row[i], x, 1, w, None)):
                                        col.append(v)
                            elif seen[0] == d[i]:
                                if p.within:
                                    if x != seen[1]:
                                        lost.append((max(x, seen[1]), 1))
                                        windows[w] = min(here, seen)
                                else:
                                    for col, v in zip(cols, (xxhash.xxh64_intdigest(w) - (1 << 63), d[i], row[i], x, 1, w, None)):
                                        col.append(v)
                            elif here < seen:
                                windows[w] = here
                                for col, v in zip(cols, (seen[2], seen[0], seen[2], 0, 0, None, np.array([seen[1], 1], np.int64).tobytes())):
                                    col.append(v)
                            else:
                                lost.append((x, 1))
                        if lost:
                            for col, v in zip(cols, (row[i], d[i], row[i], 0, 0, None, merge(np.array(lost, np.int64)).tobytes())):
                                col.append(v)
                    want = ~f & ~many
                    if want.any():
                        at = list(zip((q[want] >> 24).tolist(), (q[want] & 0xFFFFFF).tolist()))
                        found = p.cut(text[i].as_py(), at)
                        m = len(found)
                        for col, v in zip(cols, (key[a:b][want].tolist(), [d[i]] * m, [row[i]] * m, [x for x, _ in at], [x for _, x in at], found, [None] * m)):
                            col += v
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names)
                if len(windows) > 200_000:
                    yield crowd()
                    windows.clear()
        if windows:
            yield crowd()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["k"], 10_000):
            col = t["text"].combine_chunks()
            settled = col.is_null().to_numpy(zero_copy_only=False)
            done = t.filter(pa.array(settled))
            work = t.filter(pa.array(~settled))
            if work.num_rows:  # repeated rows send the same stretch twice
                k, r, e, x = (work[c].to_numpy() for c in ("k", "row", "d", "start"))
                order = np.lexsort((x, e, r, k))
                work = work.take(pa.array(np.sort(order[np.r_[True, ~_same(k[order], r[order], e[order], x[order])]])))
            row, start = work["row"].to_numpy(), work["start"].to_numpy().astype(np.int64)
            out_row, out_d, out = done["row"].to_pylist(), done["d"].to_pylist(), done["gone"].to_pylist()
            if len(row):
                d = work["d"].to_numpy()
                i, first, count = p.resolve(d, start, work["text"].to_pylist())
                order = np.lexsort((d[i], row[i]))
                i, first, count = i[order], first[order], count[order]
                pairs = np.stack([start[i] + first, count], 1)
                edge = np.flatnonzero(np.r_[True, ~_same(row[i], d[i])]) if len(i) else i
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(i)]):
                    out_row.append(int(row[i[a]]))
                    out_d.append(int(d[i[a]]))
                    out.append(pairs[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_row, pa.int64()), pa.array(out_d, pa.int64()), pa.array(out, pa.binary())], ["row", "d", "gone"])

    # all columns of `rows` go in, so that this exchange of the texts is the one that with_repeats() joins again
    sent = map_arrow(joined, send, _TEXT)
    met = map_arrow(sent.repartition("k").sortWithinPartitions("k"), meet, _GONE)
    return met.groupBy("row", "d").agg(F.collect_list("gone").alias("gone"))


def merge(spans: np.ndarray) -> np.ndarray:
    """(start, n) pairs with neighbours and overlaps joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 0] + spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > end[:-1]])
    last = np.r_[new[1:] - 1, len(spans) - 1]
    return np.stack([spans[new, 0], end[last] - spans[new, 0]], 1)


def with_repeats(docs: DataFrame, p: Plan, rest: bool = False) -> DataFrame:
    """d, text, row, gone (null: nothing) for every row of docs; with rest, a struct of the other columns."""
    rows = keyed(docs, rest)
    return rows.repartition("row", "d").join(repeats(rows, p), ["row", "d"], "left")


def covered(n: int, gone: list[bytes] | None, length: int) -> np.ndarray:
    """Which of n units lie in a repeated window."""
    if not gone:
        return np.zeros(n, bool)
    edges = np.zeros(n + 1, np.int64)
    spans = np.frombuffer(b"".join(gone), np.int64).reshape(-1, 2)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, spans[:, 0] + spans[:, 1] - 1 + length, -1)
    return np.cumsum(edges)[:-1] > 0
