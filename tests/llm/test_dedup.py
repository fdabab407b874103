import dataclasses
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pelagia.llm import common, routing, substring_dedup, suffix_dedup


def slow_bytes(docs, length):
    """doc_id -> removed mask, window by window; rows in doc_id order."""
    seen, out = set(), []
    for i, text in docs:
        b = (text or "").encode()
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mask[s : s + length] = True
            seen.add(w)
        out.append((i, b, mask))
    return out


def slow_words(docs, length):
    first, split = {}, [(i, (t or "").encode().split()) for i, t in docs]
    for i, words in split:
        for s in range(len(words) - length + 1):
            first.setdefault(tuple(words[s : s + length]), i)
    out = []
    for i, words in split:
        mask = np.zeros(len(words), bool)
        for s in range(len(words) - length + 1):
            if first[tuple(words[s : s + length])] < i:
                mask[s : s + length] = True
        out.append((i, words, mask))
    return out


def planted(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéü") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = words(60), []
    for i in range(120):
        kind = i % 6
        w = words(r.randrange(0, 90))
        if kind == 1:
            w = w[:10] + passage[r.randrange(20) : 30 + r.randrange(30)] + w[10:]
        if kind == 2 and rows:
            w = (r.choice(rows)[1] or "").split()
            if w:
                w[r.randrange(len(w))] = "edit"
        if kind == 3:
            w = words(2) * 40
        if kind == 4 and rows:
            rows.append((i, r.choice(rows)[1]))
            continue
        rows.append((i, " ".join(w) if i % 17 else None))
    rows.append((200, "x" * 700))
    rows.append((201, ("ab " * 200) + "é" * 150))
    rows.append((202, ""))
    return rows


@pytest.mark.parametrize(("crowd", "batch"), [(2000, 3000), (1, 3000), (2000, 150)])  # texts over two batches come in sections
def test_bytes_against_brute_force(spark, monkeypatch, crowd, batch):
    make = suffix_dedup.plan
    monkeypatch.setattr(suffix_dedup, "plan", lambda length: dataclasses.replace(make(length), crowd=crowd, batch=batch, held=200))
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()}
    for i, b, mask in slow_bytes(sorted(rows), 100):
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        assert got[i] == (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize(("crowd", "batch"), [(2000, 3000), (1, 3000), (2000, 150)])
def test_words_against_brute_force(spark, monkeypatch, crowd, batch):
    make = substring_dedup.plan
    monkeypatch.setattr(substring_dedup, "plan", lambda length: dataclasses.replace(make(length), crowd=crowd, batch=batch, held=200))
    rows = planted(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()}
    for i, words, mask in slow_words(sorted(rows), 13):
        kept = b" ".join(w for w, m in zip(words, mask) if not m).decode()
        assert got[i] == (kept, len(words), int(mask.sum())), i


def test_sections_hold_every_window():
    r = random.Random(3)
    for _ in range(200):
        text = bytes(r.choice(b"ab \n") for _ in range(r.randrange(200)))
        words, step, length = text.split(), r.randrange(1, 60), r.randrange(1, 7)
        got = [(a + k, tuple(s.split()[k : k + length])) for a, s in routing.word_sections(text, step, length - 1) for k in range(len(s.split()) - length + 1)]
        assert got == [(k, tuple(words[k : k + length])) for k in range(len(words) - length + 1)]
        got = [(a + k, s[k : k + length]) for a, s in routing.byte_sections(text, step, length - 1) for k in range(len(s) - length + 1)]
        assert got == [(k, text[k : k + length]) for k in range(len(text) - length + 1)]


def test_edge_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text + " more", "c"), (3, "short", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `gone-to: rest` string")
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.digests(docs).collect()), key=str)
    n = len(text)
    assert got == sorted([(1, 0), (1, 0), (None, n), (2, n), (3, 0)], key=str)
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 80), (2, 80), (3, 0)], key=str)
    assert suffix_dedup.digests(docs.limit(0)).count() == 0
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
    left = suffix_dedup.without_repeats(docs.filter("doc_id = 2 OR doc_id = 1"))
    assert left.columns == ["doc_id", "text", "gone-to: rest"]
    assert sorted(tuple(r) for r in left.collect()) == [(1, text, "a"), (1, text, "a"), (2, " more", "c")]


def test_longest_previous_factor():
    r = random.Random(5)
    for turn in range(60):
        text = bytes(r.choice(b"ab" if turn % 3 else b"a\xff\x01") for _ in range(r.randrange(0, 60)))
        n = len(text)
        match = lambda i, j: next((k for k in range(n - i + 1) if i + k == n or text[j + k] != text[i + k]), 0)  # noqa: B023, E731
        for starts in (np.arange(n), np.array(sorted(r.sample(range(n), n // 2)), np.int64)):
            want = [max((match(i, j) for j in starts.tolist() if j < i), default=0) for i in starts.tolist()]
            for depth in (1, 3, 8, 9, 70):
                got = suffix_dedup.longest_previous_factor(text, starts, depth)
                assert got.tolist() == [min(w, depth) for w in want]
                got = suffix_dedup.longest_previous_factor(text, starts, depth, depth)
                assert (got >= depth).tolist() == [w >= depth for w in want]


def test_whole_groups():
    r = random.Random(8)
    for _ in range(30):
        keys = sorted(r.randrange(6) for _ in range(r.randrange(1, 80)))
        table = pa.table({"k": pa.array(keys, pa.int64()), "v": pa.array(range(len(keys)))})
        got = list(common.whole_groups(iter(table.to_batches(max_chunksize=r.randrange(1, 9))), ["k"], r.randrange(1, 20)))
        assert [v for t in got for v in t["v"].to_pylist()] == list(range(len(keys)))
        assert sum(len(set(t["k"].to_pylist())) for t in got) == len(set(keys))


@pytest.mark.parametrize("most", [10, 200_000])
def test_gram_in_every_document(spark, monkeypatch, most):
    """One long gram in ever new surroundings, in more documents than a crowd, with real copies among them."""
    monkeypatch.setattr(routing, "MEET", most)
    r = random.Random(11)
    gram = "the same frequent phrase that is in every single document here "
    side = lambda: "".join(r.choice("abcdefghij") for _ in range(90))
    rows = [(i, side() + gram + side()) for i in range(150)]
    rows += [(200 + i, side() + rows[i][1] + side()) for i in range(0, 40, 5)]
    for module, plan in ((suffix_dedup, suffix_dedup.plan), (substring_dedup, substring_dedup.plan)):
        monkeypatch.setattr(module, "plan", lambda length, plan=plan: dataclasses.replace(plan(length), crowd=20, held=30))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.n_removed for x in suffix_dedup.digests(docs).collect()}
    assert got == {i: int(mask.sum()) for i, _, mask in slow_bytes(rows, 100)} and sum(got.values()) > 0
    got = {x.doc_id: x.n_removed for x in substring_dedup.substring_dedup(docs, 8).collect()}
    assert got == {i: int(mask.sum()) for i, _, mask in slow_words(rows, 8)}


def test_windows_choose_equal_anchors():
    a, b = b"q" * 33 + b"the same passage of text that is long enough to hold one window of a hundred bytes and a few more of them", b"zz"
    u = routing.byte_units([a, b + a[33:]], 24)
    doc, begin, size, h = routing.stretches(u, 100, 24)
    assert set(h[doc == 1].tolist()) <= set(h[doc == 0].tolist())
