"""Quality rules: word and line counts, and a linear-chain CRF that labels lines as content or boilerplate.

Each line with a word gets ten features; Viterbi decoding of a two-state chain marks it content or
boilerplate, and a document whose content lines hold at least `least_share` of its word characters is kept.

The chain is fitted on a bounded sample of labelled documents (`sample_docs`, those with the smallest
xxhash64 of doc_id, up to `sample_bytes` of line features in all): lines of documents with quality 1 count as content, of quality 0 as boilerplate. The
fit maximises the conditional likelihood with a penalty on the distance from PRIOR, so that with few or no
labels (empty table, one class) PRIOR itself decides. All counts cover whole texts.

Defined cases: null or empty text: no words, all counts 0, base_failed and not kept. A text without lines that
carry a word has content share 0. Repeated rows are judged each by itself; columns besides doc_id and text
are not read. Null doc_id passes through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_map, long_ids, table, texts, within_bytes

FEATURES = ("one", "symbols", "bangs", "upper", "digits", "pipes", "repeated", "short", "word_length", "stop")
#: Weights of boilerplate minus content for each feature, and the bonus for staying in a state.
PRIOR = np.array([-2.0, 6.0, 2.0, 3.0, 2.0, 3.0, 0.5, 0.2, 0.0, -0.5])
PRIOR_STAY = 1.0
#: Longer texts are fitted as several chains of so many lines, so that chains can step together.
CHAIN = 400

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v == n:
        return 0
    pair = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * v + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def line_features(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """Features and word characters (bytes) of each line with a word; the number of repeated lines."""
    rows, chars, dup = [], [], 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        w = len(words)
        flat = b"".join(words)
        n = len(flat)
        rows.append(
            [
                1.0,
                (n - len(flat.translate(None, _SYMBOLS))) / n,
                min(1.0, flat.count(b"!") / w),
                (n - len(flat.translate(None, _UPPER))) / n,
                (n - len(flat.translate(None, _DIGITS))) / n,
                min(1.0, flat.count(b"|") / w),
                float(again),
                float(w < 3),
                min(n / w, 20.0) / 10.0,
                float(flat[-1:] in b".?!:;"),
            ]
        )
        chars.append(n)
    return rows, chars, dup


def viterbi(unary: list[float], stay: float) -> list[bool]:
    """The best labelling (True: boilerplate) where unary is its score against content's, stay the bonus for no change."""
    best0 = best1 = 0.0
    back: list[tuple[bool, bool]] = []
    for u in unary:
        from0, from1 = best1 > best0 + stay, best1 + stay > best0
        back.append((from0, from1))
        best0, best1 = (best1 if from0 else best0 + stay), (best1 + stay if from1 else best0) + u
    out = []
    state = best1 > best0
    for step in reversed(back):
        out.append(state)
        state = step[1] if state else step[0]
    return out[::-1]


def likelihood(x: list[np.ndarray], y: np.ndarray, w: np.ndarray, stay: float) -> tuple[float, np.ndarray]:
    """Log-likelihood of chains whose every line has its chain's label y, and its gradient by w and stay.

    x: for each place in a chain the features of all chains that reach it, the longest chains first."""
    alive = [len(a) for a in x]
    most = len(x)
    u = [a @ w for a in x]
    fwd = [np.zeros((alive[0], 2))]
    fwd[0][:, 1] = u[0]
    for t in range(1, most):
        p = fwd[-1][: alive[t]]
        a = np.logaddexp(p[:, 0] + stay, p[:, 1])
        b = np.logaddexp(p[:, 0], p[:, 1] + stay)
        fwd.append(np.stack([a, b + u[t]], 1))
    bwd = np.zeros((alive[0], 2))
    value, grad, gstay = 0.0, np.zeros(len(w)), 0.0
    logz = np.zeros(alive[0])
    for t in range(most - 1, -1, -1):
        ends = slice(alive[t + 1] if t + 1 < most else 0, alive[t])
        logz[ends] = np.logaddexp(fwd[t][ends, 0], fwd[t][ends, 1])
        if t + 1 < most:
            i = alive[t + 1]
            nxt = bwd[:i] + np.stack([np.zeros(i), u[t + 1]], 1)
            z = logz[:i]
            same = np.exp(fwd[t][:i, 0] + stay + nxt[:, 0] - z) + np.exp(fwd[t][:i, 1] + stay + nxt[:, 1] - z)
            gstay += (1.0 - same).sum()  # the labelled chains never change state
            value += stay * i
            bwd[:i] = np.stack([np.logaddexp(nxt[:, 0] + stay, nxt[:, 1]), np.logaddexp(nxt[:, 0], nxt[:, 1] + stay)], 1)
        p1 = np.exp(fwd[t][:, 1] + bwd[: alive[t], 1] - logz[: alive[t]])
        value += y[: alive[t]] @ u[t]
        grad += (y[: alive[t]] - p1) @ x[t]
    return float(value - logz.sum()), np.r_[grad, gstay]


def fit(lines: list[np.ndarray], bad: list[int], rounds: int = 60, penalty: float = 2.0) -> tuple[np.ndarray, float]:
    """Conditional maximum likelihood of the chain by Adam; all chains step through their lines together."""
    if not lines or len(set(bad)) < 2:
        return PRIOR.copy(), PRIOR_STAY
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    seqs, y = [lines[i] for i in order], np.array([bad[i] for i in order], float)
    n = np.array([len(s) for s in seqs])
    x = [np.stack([s[t] for s in seqs[: int((n > t).sum())]]) for t in range(int(n[0]))]
    w, stay = PRIOR.copy(), PRIOR_STAY
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    total = n.sum()
    for k in range(1, rounds + 1):
        g = likelihood(x, y, w, stay)[1] / total - penalty * (np.r_[w, stay] - np.r_[PRIOR, PRIOR_STAY]) / total
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, stay = w + step[:-1], min(float(stay + step[-1]), 2.0)
    return w, stay


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_bytes: int = 64 << 20) -> tuple[np.ndarray, float]:
    """Weights fitted on at most sample_docs labelled documents with sample_bytes of line features (40 bytes a line), which
    come to the driver, rounded."""
    picked = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_docs)
    )
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [np.asarray(line_features(t)[0], np.float32).tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays(
            [long_ids(batch), batch.column("quality"), pa.array(got, pa.binary())], ["doc_id", "quality", "lines"]
        )

    found = arrow_map(rows, features, "doc_id long, quality int, lines binary")
    got = within_bytes(found, "lines", [F.xxhash64("doc_id"), "doc_id", "lines"], sample_bytes).collect()
    got = sorted((r for r in got if r["lines"]), key=lambda r: (r["doc_id"], bytes(r["lines"])))
    lines = [np.frombuffer(r["lines"], np.float32).reshape(-1, len(FEATURES)).astype(float) for r in got]
    pieces = [(x[a : a + CHAIN], int(r["quality"] == 0)) for x, r in zip(lines, got) for a in range(0, len(x), CHAIN)]
    return fit([x for x, _ in pieces], [bad for _, bad in pieces])


def _judge(batch: pa.RecordBatch, w: np.ndarray, stay: float, least_share: float) -> list[list]:
    cols: list[list] = [[] for _ in range(8)]
    for raw, text in zip(texts(batch), batch.column("text").to_pylist()):
        words = raw.split()
        n = len(words)
        rep = repeat_words(words)
        rows, chars, dup = line_features(raw)
        failed = n < 50 or 100 * rep > 50 * n
        share = 0.0
        if rows:
            marks = viterbi((np.asarray(rows, np.float32).astype(float) @ w).tolist(), stay)
            share = sum(c for c, bad in zip(chars, marks) if not bad) / sum(chars)
        gone = sum(map((text or "").count, " \t\n\v\f\r"))
        values = (
            n,
            len(text or "") - gone,
            len(raw) - len(raw.translate(None, _SYMBOLS)),
            dup,
            rep,
            failed,
            share,
            not failed and share >= least_share,
        )
        for col, value in zip(cols, values):
            col.append(value)
    return cols


def quality_rules(docs: DataFrame, weights: np.ndarray, stay: float, least_share: float = 0.5) -> DataFrame:
    """Counts and verdict for each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = _judge(batch, weights, stay, least_share)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([long_ids(batch), *map(pa.array, cols, kinds)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def keep(docs: DataFrame, weights: np.ndarray, stay: float, least_share: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_judge(batch, weights, stay, least_share)[-1], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, *train(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
