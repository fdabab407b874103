import numpy as np
import pytest
import xxhash

from pelagia.llm import simhash as S


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    v = np.array([f for _, f in fps], np.uint64)
    ids = [i for i, _ in fps]
    label = list(range(len(v)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    order = np.argsort(ids)
    for a in order:
        for b in np.flatnonzero(np.bitwise_count(v ^ v[a]) <= 4):
            x, y = root(a), root(b)
            if x != y:
                x, y = sorted((x, y), key=lambda k: ids[k])
                label[y] = x
    return {ids[i]: ids[root(i)] for i in range(len(v))}


@pytest.mark.parametrize("dense", [20_000, 12])
def test_whole_table_against_brute_force(spark, sf, dense):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash(docs, dense=dense).collect()}
    want = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    assert {i: f"{f:016x}" for i, f in want} == {i: x[0] for i, x in got.items()}
    assert slow_components(want) == {i: x[1] for i, x in got.items()}


def test_partitions_of_some_bits():
    rng = np.random.default_rng(1)
    bits = sorted(rng.choice(64, 23, replace=False).tolist())
    v = (rng.random((500, 64)) < 0.5).astype(float)
    groups, ts = S.plan(500, v.T @ v, 4, bits)
    assert sorted(b for g in groups for b in g) == bits and sum(ts) == 4 - len(groups) + 1
    groups, ts = S.plan(500, v.T @ v, 4, bits[:3])
    assert sorted(b for g in groups for b in g) == bits[:3] and sum(ts) == 4 - len(groups) + 1


@pytest.mark.parametrize("dense", [20_000, 60])
def test_links_of_planted_chains(spark, dense):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    fps = list(base)
    for b in base[:60]:  # chains whose ends are far apart
        x = b
        for _ in range(6):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x = x ^ (np.uint64(1) << np.uint64(bit))
            fps.append(x)
    center = np.uint64(rng.integers(0, 2**63))
    fps += [center ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(20) for j in range(i)]
    fps = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    got = {r.node: r.component for r in S.components(S.links(nodes, dense=dense)).collect()}
    want = slow_components(list(enumerate(fps)))
    assert {i: got.get(i, i) for i in want} == want


def test_partition_thresholds_cover_the_radius():
    rng = np.random.default_rng(0)
    for n in (10**3, 10**6, 10**9):
        bits = rng.random((2000, 64)) < 0.5
        both = (bits.T.astype(float) @ bits) * n / 2000
        groups, ts = S.plan(n, both)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(ts) == S.RADIUS - len(groups) + 1


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (4, "a b", 9), (4, "a b", 9), (5, "A\tB", 9), (None, "a b", 9), (None, "q r s t u", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (None, 4), (None, None)], key=str)
    assert S.simhash(docs.limit(0)).count() == 0
