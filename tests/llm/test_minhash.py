import re

import numpy as np
import pytest

from gleanery.llm import common as C
from gleanery.llm.minhash import near_duplicates, shingle_sets, super_minhash


def words(text, n):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return ({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) if w else set()


def brute(rows, n, percent):
    sets = [(i, words(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def variants(seed, base_words, copies, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(edits):
            w[rng.integers(len(w))] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    texts = variants(1, 120, 40, 3) + variants(2, 60, 30, 2) + ["", None, "one", "One", "two words", "  \t\n", "a b c"] + [" ".join(["again"] * 5000)] * 3
    texts += [" ".join(f"u{k}_{i}" for i in range(30)) for k in range(20)]
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_shingles string, component_id int")
    for n, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=n, percent=percent).collect()}
        assert got == brute(rows, n, percent)


def test_large_group_with_stragglers(spark, monkeypatch):
    """More members than a block holds, many of them linked only over others, so all three steps matter."""
    import gleanery.llm.minhash as M

    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(5000)}" for _ in range(60)]
    texts = []
    for _ in range(130):
        w = list(base)
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(len(w))] = f"x{rng.integers(40)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=3, percent=85).collect()}
    want = brute(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 3
    assert got == want


def test_components_by_shuffle(spark, monkeypatch):
    import gleanery.llm.components as K

    monkeypatch.setattr(K, "FEW", 0)
    monkeypatch.setattr(K, "HUB", 4)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(70 + k, 69 + k) for k in range(20)] + [(100, 101 + k) for k in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    out = {r.rep: r.comp for r in K.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in root}


def test_groups_that_percolate(spark, monkeypatch):
    """Texts that share half of their words collide in many buckets without being links; near copies hide among them."""
    import gleanery.llm.minhash as M

    monkeypatch.setattr(M, "BLOCK", 16)
    rng = np.random.default_rng(4)
    common = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(90):
        own = [f"o{k}_{i}" for i in range(60 if k % 3 else 20)]
        texts.append(" ".join(common + own))
        if k % 5 == 0:  # a chain of copies, each linked with the last
            for _ in range(3):
                own = list(own)
                own[rng.integers(len(own))] = f"x{rng.integers(10**6)}"
                texts.append(" ".join(common + own))
    rows = [(int(i), texts[k]) for k, i in enumerate(rng.permutation(len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, 3, 85)
    assert 60 < len({c for _, c in want.values()}) < 120
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=3, percent=85).collect()} == want


def test_words_are_told_apart(spark):
    """Two words whose polynomial hashes modulo 2**64 are equal whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    out = near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert all(r.kept for r in out)


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_super_minhash_is_the_sequential_algorithm():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 500):
        elems = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        got = super_minhash(elems, np.array([0, size]))[0]
        want = np.full(64, np.iinfo(np.uint64).max, np.uint64)
        for e in elems:
            p = list(range(64))
            for j in range(64):
                r = int(C.mix(np.array([e], np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(j + 1))[0])
                k = j + (r >> 40) % (64 - j)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], (j << 32) | (r & 0xFFFFFFFF))
        assert (got == want).all()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    sets = np.concatenate([pool[:1000], pool[200:1200]])
    sig = super_minhash(sets, np.array([0, 1000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.2


@pytest.mark.parametrize("text,n", [("A b  c\td", 2), ("a b c", 1), ("a", 0), ("", 0)])
def test_shingles(text, n):
    data = np.frombuffer(text.encode(), np.uint8)
    _, bounds = shingle_sets(data, np.array([0, len(data)]), 3)
    assert bounds[-1] == len(words(text, 3))
