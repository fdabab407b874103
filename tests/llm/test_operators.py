import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pelagia.llm import byte_bpe, decontaminate, license_scan, quality_classifier, quality_rules, url_filter, warc

DOCS = "doc_id long, text string, n_words string, row string, k long"  # with names that operators use themselves
ODD = [
    (1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, " \n\t ", "x", "y", 1), (4, "one", "x", "y", 1), (4, "one", "x", "y", 1),
    (None, "no id here", "x", "y", 1), (5, "é漢字 \U0001f600 ² Ⅷ a\x1cb", "x", "y", 1), (6, "word " * 30_000, "x", "y", 1), (7, "z" * 50_000, "x", "y", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# ------------------------------------------------------------------ quality rules
def slow_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.append(line)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def test_quality_counts(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.apply(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    for r in docs.collect():
        assert got[r.doc_id][:6] == slow_counts(r.text), r.doc_id
        assert got[r.doc_id][7] <= (not got[r.doc_id][5])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality_rules.apply(odd, empty).collect()
    assert sorted(Counter(map(tuple, [(r.doc_id, r.n_words, r.kept) for r in judged])).items(), key=str) == sorted(
        Counter((i, slow_counts(t)[0], slow_counts(t)[0] >= 50 and not slow_counts(t)[5]) for i, t, *_ in ODD).items(), key=str
    )
    kept = quality_rules.keep(odd, quality_rules.PRIOR, 1.0)
    assert kept.schema == odd.schema and kept.count() == 0
    assert quality_rules.apply(odd.limit(0), empty).count() == 0


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.query(spark, sf).join(labels, "doc_id").filter("NOT base_failed")
    right = got.filter("kept = (quality = 1)").count()
    assert right > 0.95 * got.count()
    assert got.filter("quality = 1 AND NOT kept").count() == 0


def test_quality_fits_whole_texts(spark):
    docs = spark.createDataFrame([(1, "good words here.\n" * 900), (2, "### $$$ !!!\n" * 900), (3, "x")], "doc_id long, text string")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality_rules, "fit", lambda lines, bad: seen.extend(zip(map(len, lines), bad)) or (quality_rules.PRIOR, 1.0))
        quality_rules.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert seen == [(400, 0), (400, 0), (100, 0), (400, 1), (400, 1), (100, 1)]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(50):
        u, stay = rng.normal(size=7), rng.normal()
        score = lambda y: sum(a for a, b in zip(u, y) if b) + stay * sum(a == b for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max((tuple(bool(k >> i & 1) for i in range(7)) for k in range(128)), key=score)
        assert score(tuple(quality_rules.viterbi(u.tolist(), stay))) == pytest.approx(score(best))


def test_chain_likelihood_and_gradient():
    """Against the sum over all labellings of short chains, and finite differences."""
    rng = np.random.default_rng(4)
    sizes, k = [5, 5, 3, 1], 3
    seqs = [rng.normal(size=(n, k)) for n in sizes]
    x = [np.stack([s[t] for s in seqs if len(s) > t]) for t in range(5)]
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def slow(w, stay):
        out = 0.0
        for s, label in zip(seqs, y):
            score = lambda z: sum(a @ w for a, b in zip(s, z) if b) + stay * sum(a == b for a, b in zip(z, z[1:]))  # noqa: B023, E731
            every = [score([j >> i & 1 for i in range(len(s))]) for j in range(1 << len(s))]
            out += score([int(label)] * len(s)) - np.logaddexp.reduce(every)
        return out

    w, stay = rng.normal(size=k), 0.7
    value, grad = quality_rules.likelihood(x, y, w, stay)
    assert value == pytest.approx(slow(w, stay))
    for i in range(k + 1):
        d = np.zeros(k + 1)
        d[i] = 1e-5
        want = (slow(w + d[:k], stay + d[k]) - slow(w - d[:k], stay - d[k])) / 2e-5
        assert grad[i] == pytest.approx(want, abs=1e-6)


def test_quality_verdicts_against_every_labelling(spark):
    """Content share by trying all labellings of texts with few lines; features from their definition."""
    rng = random.Random(3)
    pool = ["A fine line of some words here.", "### $$$ buy | now !!!", "MENU | HOME | 2024", "short", "another good sentence, with more words in it.", "", "  "]
    w, stay = quality_rules.PRIOR, 1.3
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)) + ["tail words " + " ".join(f"w{i}x{j}" for j in range(45))])) for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), w, stay).collect()}
    for i, text in rows:
        lines, seen = [], set()
        for line in text.split("\n"):
            words = line.split()
            if words:
                flat = "".join(words)
                n, some = len(flat), lambda f: sum(map(f, flat)) / n  # noqa: B023
                lines.append((n, [1, some(lambda c: c in "#*$%&|<>"), min(1, flat.count("!") / len(words)), some(str.isupper), some(str.isdigit), min(1, flat.count("|") / len(words)), line in seen, len(words) < 3, min(n / len(words), 20) / 10, flat[-1] in ".?!:;"]))
                seen.add(line)
        u = [float(np.float32(f).astype(float) @ w) for _, f in lines]
        score = lambda z: sum(a for a, b in zip(u, z) if b) + stay * sum(a == b for a, b in zip(z, z[1:]))  # noqa: B023, E731
        best = max(([j >> k & 1 for k in range(len(u))] for j in range(1 << len(u))), key=score)
        share = sum(n for (n, _), b in zip(lines, best) if not b) / sum(n for n, _ in lines)
        assert got[i].content_share == pytest.approx(share), text
        assert got[i].kept == (not got[i].base_failed and share >= 0.5)


# ------------------------------------------------------------------ WARC
def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "x" * 120), (2, "http://b/\n", "x" * 120), (3, None, None), (4, "u", "tiny"), (5, "u", "tiny"), (None, "n", "x" * 120), (1, "again", "x" * 120), (6, "é", "é" * 90_000)]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, payload string")
    archives = warc.write_archives(warc.record_types(df), archive_bytes=500)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read_archives(archives).collect()), key=str)
    want = [
        (1, "response", None, 120, "x" * 120), (1, "response", None, 120, "x" * 120), (2, "revisit", 1, 120, None), (3, "response", None, 0, ""),
        (4, "response", None, 4, "tiny"), (5, "response", None, 4, "tiny"), (None, "response", None, 120, "x" * 120), (6, "response", None, 180_000, "é" * 90_000),
    ]
    assert got == sorted(want, key=str)
    for k, r in enumerate(archives.collect()):
        (tmp_path / f"{k}.warc.gz").write_bytes(r.content)
    assert warc.read_files(spark, f"file://{tmp_path}/*.warc.gz").count() == len(pages)
    assert warc.read_archives(warc.write_archives(warc.record_types(df.limit(0)))).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.record("response", [("WARC-Payload-Digest", f"sha256:{hashlib.sha256(b'abc').hexdigest()}")], b"abc")
    assert [b for _, b in warc.read_stream(good + good, piece=7)] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_stream(good[:-5]))
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"abc", b"abd"), plain.replace(b"Length: 3", b"Length: 2"), plain[:-1], b"no header", plain.replace(b"Content-Length: 3", b"X: 3")):
        with pytest.raises(ValueError, match="WARC"):
            list(warc.read_stream(zlib.compress(bad, wbits=31)))


def foreign(kind, headers, block):
    """A record as other writers make it: WARC 1.0, other digests, HTTP messages."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]
    return zlib.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", wbits=31)


def test_warc_archives_of_others(spark, tmp_path):
    b32 = lambda f, x: base64.b32encode(f(x).digest()).decode().rstrip("=")
    body = b"<p>hello</p>"
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=1\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response"
    good = [
        foreign("warcinfo", ["Content-Type: application/warc-fields"], b"software: x\r\n"),
        foreign("request", [http.replace("response", "request"), f"WARC-Block-Digest: sha1:{b32(hashlib.sha1, b'GET / HTTP/1.1')}"], b"GET / HTTP/1.1"),
        foreign("response", [http, "WARC-Target-URI: http://a/", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1, plain)}", f"WARC-Payload-Digest: sha1:{b32(hashlib.sha1, body)}"], plain),
        foreign("response", [http, f"WARC-Payload-Digest: SHA-256:{hashlib.sha256(body).hexdigest().upper()}"], chunked),
        foreign("resource", ["Content-Type: image/png", f"WARC-Payload-Digest: md5:{hashlib.md5(b'png').hexdigest()}"], b"png"),
        foreign("response", [http, "WARC-Payload-Digest: blake9:whatever"], plain),
        foreign("revisit", ["WARC-Refers-To: <urn:uuid:1>", f"WARC-Payload-Digest: sha1:{b32(hashlib.sha1, body)}", http], b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(good))
    got = warc.read_files(spark, f"file://{tmp_path}/*.warc.gz", piece=50).collect()
    assert [(r.record_type, r.payload and bytes(r.payload)) for r in got] == [
        ("warcinfo", None), ("request", None), ("response", body), ("response", body), ("resource", b"png"), ("response", body), ("revisit", None),
    ]
    assert got[2].url == "http://a/" and got[2].page_id is None and got[2].payload_bytes == len(body)
    for bad in (plain.replace(b"hello", b"hallo"), plain[:-1]):
        damaged = foreign("response", [http, f"WARC-Payload-Digest: sha1:{b32(hashlib.sha1, body)}"], bad)
        with pytest.raises(ValueError, match="payload-digest"):
            list(warc.read_stream(damaged))
    assert warc.read_files(spark, f"file://{tmp_path}/none*").count() == 0


def test_warc_revisits_name_their_response(spark):
    df = spark.createDataFrame([(1, "u", "x" * 120), (2, "v", "x" * 120)], "page_id long, url string, html string")
    heads = [h for r in warc.write_archives(warc.record_types(df)).collect() for h, _ in warc.read_stream(r.content)]
    by = {h["warc-type"]: h for h in heads}
    assert by["revisit"]["warc-refers-to"] == by["response"]["warc-record-id"]


# ------------------------------------------------------------------ quality classifier
def test_classifier_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.query(spark, sf).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.quality for r in held) > 0.95 * len(held)
    scores = quality_classifier.score(odd, None).collect()
    assert len(scores) == len(ODD) and {r.score for r in scores} == {0.5}
    weights = np.zeros((1 << quality_classifier.LOG_BUCKETS) + 1)
    weights[-1] = 1.0
    assert {round(r.score, 6) for r in quality_classifier.score(odd, weights).collect()} == {0.731059}
    assert quality_classifier.train(odd, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality_classifier.score(odd.limit(0), weights).count() == 0


def test_ftrl_learns_a_word():
    good, bad = (quality_classifier.features([t], {})[0] for t in ("alpha beta gamma", "alpha beta junk"))
    w = quality_classifier.ftrl([(good, 1), (bad, 0)] * 50)
    assert w[good].sum() > 0 > w[bad].sum()


def slow_features(text):
    """Buckets from their definition, one token at a time."""
    mask, mix, bits = (1 << 64) - 1, 0x9E3779B97F4A7C15, quality_classifier.LOG_BUCKETS
    down = lambda v: (v & mask) * mix % (1 << 64) >> 64 - bits
    tokens = [m[0] for m in re.finditer(r"[^\W_]+|([^\w\s]|_)\1*", text or "")]
    h = [zlib.crc32(t.lower().encode()) for t in tokens]
    out = [down(x + 1) for x in h]
    out += [down(a * 0x100000001B3 + b) for a, b in zip(h, h[1:])]
    out += [down(7)] * sum(len(t) > 1 and t.isupper() for t in tokens)
    return out + [down(11)] * sum(a == b for a, b in zip(h, h[1:]))


def slow_ftrl(rows, epochs=2, alpha=0.3, beta=1.0, l1=2.0, l2=0.1):
    z, g2 = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(g2[i])) / alpha + l2)

    for _ in range(epochs):
        for buckets, y in rows:
            x = {i: quality_classifier.SCALE * c / max(len(buckets), 1) for i, c in Counter(buckets).items()} | {"one": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / alpha * w[i]
                g2[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_classifier_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    picked = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in text)
    order = np.random.default_rng(7).permutation(len(picked))
    want = slow_ftrl([(slow_features(text[picked[k]]), int(labels[picked[k]] == 1)) for k in order])
    got = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert got[-1] == pytest.approx(want.pop("one"))
    full = np.zeros(len(got) - 1)
    for i, v in want.items():
        full[i] = v
    assert np.allclose(got[:-1], full, atol=1e-9) and (full != 0).sum() > 5
    some = sorted(text)[:60]
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, got).collect()}
    for i in some:
        f = slow_features(text[i])
        dot = quality_classifier.SCALE * sum(full[b] for b in f) / max(len(f), 1) + got[-1]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, dot)))), abs=1e-5)
    few = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), sample_bytes=50_000)
    assert few is not None and not np.array_equal(few, got)


# ------------------------------------------------------------------ license scan
def test_license_base_against_brute_force(spark, odd):
    text = "Under the MIT License; under the mit license. CC-BY-NC cc by nc cc by nc! Apache License, Version 2.0 é under the mit licenses"
    rows = [*ODD, (8, text, "x", "y", 1), (9, "no cc by-nd here", "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.n_words): r for r in license_scan.license_scan(docs).collect()}
    assert len(got) == len(rows) - 1
    for i, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [k for p in ("under the mit license", "apache license version 2", "cc by nc") for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i, len(words)]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
    r = next(r for (i, _), r in got.items() if i == 8)
    assert r.base_labels == "apache-2,cc-by-nc,mit" and set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0.9 < r.score <= 1
    assert next(r for (i, _), r in got.items() if i == 9).labels == "cc-by-nd"
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_license_rules_resolve_by_priority():
    assert len(license_scan.RULES) > 200
    f = lambda s: [x[2] for x in license_scan.detect(b" " + s.encode() + b" ")]
    assert f("gnu general public license version 3 29 june 2007") == ["gpl-3"]
    assert f("the gnu lesser general public license version 2 1") == ["lgpl-2.1"]
    assert f("creative commons attribution non commercial share alike 4 0") == ["cc-by-nc-sa-4"]
    assert f("spdx license identifier gpl 2 0 or later") == ["gpl-2-or-later"]
    assert f("nothing to see") == []


def slow_detect(flat):
    """Every rule on every text, and each detection against all earlier ones."""
    kept = []
    for label, _, pattern, confidence in license_scan.RULES:
        for m in pattern.finditer(flat):
            a, b = m.span()
            if not any(x <= a and b <= y for x, y, *_ in kept):
                kept.append((a, b, label, confidence))
    return sorted(kept)


def test_license_labels_against_all_rules_without_gates(spark, sf):
    r = random.Random(9)
    pieces = [re.sub(r"\(\?:|[()?*+\[\]{}\\|]|\\S", "", p.pattern.decode()[6:-5]) for *_, p, _ in license_scan.RULES]
    filler = "some words of text that say nothing license copyright gpl cc by public domain version 2 0 v3 mit".split()
    made = []
    for _ in range(300):
        part = [r.choice([r.choice(pieces), " ".join(r.choices(filler, k=r.randrange(1, 6)))]) for _ in range(r.randrange(1, 9))]
        made.append(" ".join(part))
    docs = [x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seen = 0
    for t in made + docs:
        flat = b" " + b" ".join(t.encode().translate(license_scan.ALNUM).split()) + b" "
        got = license_scan.detect(flat)
        assert got == slow_detect(flat), t
        seen += len(got)
    assert seen > 300
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    flats = {i: b" " + b" ".join(t.encode().translate(license_scan.ALNUM).split()) + b" " for i, t in enumerate(made)}
    for x in license_scan.license_scan(rows).collect():
        sure = {label: 0.9 for label in filter(None, x.base_labels.split(","))}
        for _, _, label, c in slow_detect(flats[x.doc_id]):
            sure[label] = max(c, sure.get(label, 0.0))
        assert x.labels == ",".join(sorted(sure)) and x.score == pytest.approx(1 - math.prod(1 - c for c in sure.values()))
    place = lambda i, a, b: (flats[i][:a].count(b" ") - 1, flats[i][a:b].count(b" ") + 1)
    want = Counter((i, *place(i, a, b), label) for i in flats for a, b, label, _ in slow_detect(flats[i]))
    assert Counter((x.doc_id, x.first_word, x.n_words, x.label) for x in license_scan.detections(rows).collect()) == want


# ------------------------------------------------------------------ BPE
@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.default_bpe()


def test_bpe_of_untrained_vocabularies():
    """Vocabularies whose ranks follow no order: merging one pair can make another of lower rank."""
    import tiktoken

    r = random.Random(6)
    for turn in range(40):
        tokens = list({"".join(r.choices("ab", k=r.randrange(2, 6))).encode() for _ in range(12)})
        r.shuffle(tokens)
        ranks = {t: i for i, t in enumerate([*tokens, *(bytes([b]) for b in range(256))])} if turn % 2 else {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *tokens])}
        own = byte_bpe.Bpe(ranks, r"[^|]+")
        other = tiktoken.Encoding("own", pat_str=r"[^|]+", mergeable_ranks=ranks, special_tokens={})
        strings = ["".join(r.choices("ab", k=r.randrange(1, 700))) for _ in range(12)]
        for s, ids in zip(strings, own.encode(strings)):
            assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(s)


def test_bpe_equals_tiktoken(bpe, spark, odd):
    import public_tokenizers
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    r = random.Random(1)
    alphabet = "ab cd\n\t\x1c\x85 ²½Ⅷ٣éßñ漢字カ'sreve'l_-!!\U0001f600 z<|endoftext|>"
    strings = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)]
    letters = "abcdefghijklmnopqrstuvwxyzéß漢字カ"
    strings += ["".join(r.choices(letters, k=k)) for k in (127, 128, 129, 255, 256, 257, 258, 600, 3000)]
    strings += ["".join(r.choices(["the", "ing", "a", "aa", "ab", "straße"], k=k)) for k in (40, 90, 400, 2000)] + ["a" * k for k in range(120, 140)]
    strings += ["", "a" * 5000, "ab" * 3000, "漢" * 900, " " * 700, "\n" * 300 + "x", "b" * 128, "b" * 129]
    for s, ids in zip(strings, bpe.encode(strings)):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(s)
        assert bpe.decode(ids).decode() == s
    got = byte_bpe.round_trip(odd, bpe).collect()
    want = Counter((i, len(other.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ODD)
    assert Counter((g.doc_id, g.n_tokens, g.decoded_sha256) for g in got) == want
    back = byte_bpe.decode(byte_bpe.encode(odd, bpe), bpe)
    assert Counter((b.doc_id, bytes(b.bytes).decode()) for b in back.collect()) == Counter((i, t or "") for i, t, *_ in ODD)
    assert byte_bpe.round_trip(odd.limit(0), bpe).count() == 0


# ------------------------------------------------------------------ decontamination
def words_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def slow_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        if item is None or not w:
            continue
        n = min(8, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most", [5_000_000, 40])
def test_decontamination_against_brute_force(spark, most):
    r = random.Random(4)
    v = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(v) for _ in range(r.randrange(0, 25)))) for k in range(20)] + [(20, None), (None, "w1 w2"), (3, "w1"), (21, "w2 w3 w4")]
    docs = []
    for k in range(60):
        t = [r.choice(v + ["other"]) for _ in range(r.randrange(0, 60))]
        if k % 3 == 0:
            t += (r.choice(items)[1] or "").upper().split()
        docs.append((k, ", ".join(t)))
    docs += [(100, None), (101, ""), (102, "other " * 2000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for x in decontaminate.decontaminate(df, bench, max_words=most).collect()}
    assert got == {i: slow_hits(t, items) for i, t in docs}
    wide = df.selectExpr("doc_id", "text", "doc_id AS row", "text AS items", "1 AS `n_words`", "2 AS `a-b: c`")
    clean = decontaminate.without_hits(wide, bench, most)
    assert clean.schema.names == wide.schema.names
    assert {x.rest.doc_id: x.n_words for x in decontaminate.hits(df, bench, most).collect()} == {i: g[0] for i, g in got.items()}
    for x in clean.collect():
        assert len(words_of(x.text)) == got[x.doc_id][0] - got[x.doc_id][1]
    none = decontaminate.decontaminate(df, bench.limit(0)).collect()
    assert {x.n_hit for x in none} == {0} and len(none) == len(docs)
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    for _ in range(20):
        t = rng.integers(0, 4, rng.integers(1, 200))
        index = decontaminate.FmIndex(t)
        patterns = rng.integers(0, 5, (30, 3))
        lo, hi = index.search(patterns, np.full(30, 3))
        for p, a, b in zip(patterns, lo, hi):
            want = [i for i in range(len(t) - 2) if (t[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ------------------------------------------------------------------ URL filter
def test_url_rules(spark):
    urls = [
        (1, "http://www.Example.com/en/x?y#z"), (2, "https://a.www.example.com/en/"), (3, "x://example.com/en"), (4, "http://b.example.com/en/q"), (5, "http://com/"),
        (6, "http://a.com"), (7, None), (8, "no scheme"), (9, "http://x.net/es/1"), (10, "http://net/fr/"), (11, "http://notexample.com/en/"), (12, "http:///p"), (12, "http:///p"),
        (13, "http://a.org?q=http://b.com/"), (14, "http://é.com/ä?x"), (15, "http://a.net/fr"),
    ]
    pages = spark.createDataFrame([(*u, "c") for u in urls], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("com/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5][2] == "com/" and got[6] == ("a.com", "", None, "allow") and got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("net/es/", "block") and got[10][2:] == ("net/fr/", "block") and got[11][2] == "com/" and got[12][2] is None
    assert got[13] == ("a.org", "", None, "allow") and got[14] == ("é.com", "/ä", "com/", "allow") and got[15][2] is None
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_ties_go_to_the_longest_host(spark):
    pages = spark.createDataFrame([(1, "http://www.a.com/abcd"), (2, "http://www.a.com/abce"), (3, "http://a.com/abcd")], "page_id long, url string")
    for order in (1, -1):
        rules = [("a.com", "/abcd", "block"), ("www.a.com", "/", "allow")][::order]
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
        assert got == {1: ("www.a.com/", "allow"), 2: ("www.a.com/", "allow"), 3: ("a.com/abcd", "block")}


def test_many_rules_stay_one_literal_a_level(spark):
    universe = spark.range(60_000).selectExpr("concat('host', id, '.org/') AS key")
    listed = universe.filter("xxhash64(key) % 3 = 0")
    levels = url_filter.cascade(listed, universe)
    plan = universe.filter(url_filter.member(universe.key, levels))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 200_000 and sum(x.bits for x in levels) > 20_000
    assert universe.filter(url_filter.member(universe.key, levels)).exceptAll(listed).count() == 0
    with pytest.raises(ValueError, match="bits"):
        url_filter.cascade(listed, universe, max_bits=1000)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('key', id) AS key")
    listed = universe.filter("xxhash64(key) % 7 = 0")
    levels = url_filter.cascade(listed, universe)
    assert len(levels) > 1
    told = universe.filter(url_filter.member(universe.key, levels))
    assert told.exceptAll(listed).count() == 0 and listed.exceptAll(told).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from pelagia.llm import common

    docs = common.table(spark, sf, "documents")
    start, seen = docs.schema, []
    for name, stage in corpus_pipeline.STAGES:
        if seen:
            assert docs.schema.simpleString() == start.simpleString(), name
        docs = common.materialise(stage(spark, docs, sf))
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < 200
    whole = corpus_pipeline.run(spark, sf)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in docs.collect()}
