"""The Jaccard join: every component equals that of all pairs compared, whatever way sets meet."""

import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import jaccard, minhash, verify


def shingles(text, words):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    return {tuple(ws)} if 0 < len(ws) < words else {tuple(ws[i : i + words]) for i in range(len(ws) - words + 1)}


def brute(rows, words, percent):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([(i, s) for (i, _), s in zip(rows, sets, strict=True) if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


def family(rnd, words, copies, edits):
    """A text of random words and copies of it with up to so many words replaced, left out or added."""
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        ws = list(base)
        for _ in range(rnd.randint(0, edits)):
            at = rnd.randrange(len(ws))
            ws[at : at + 1] = rnd.choice([[], [rnd.choice(vocabulary)], [ws[at], rnd.choice(vocabulary)]])
        out.append(" ".join(ws) + rnd.choice(["", " end", "\n"]))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "one two three", "É one two", "é one two"]
    for words, copies, edits in [(11, 25, 1), (13, 25, 2), (20, 30, 1), (24, 20, 2), (40, 40, 2), (90, 60, 3), (300, 30, 6), (12, 3, 0)]:
        texts += family(rnd, words, copies, edits)
    common = " ".join(f"c{k}" for k in range(60))  # a passage that most texts are made of
    texts += [f"{common} {rnd.random()} {rnd.random()} x" for _ in range(40)]
    rnd.shuffle(texts)
    return list(enumerate(texts, start=-5))


def got(df, words, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words=words, percent=percent).collect())


@pytest.mark.parametrize(("percent", "block", "at_once", "large"), [(90, 512, 10**9, None), (80, 4, 0, 30), (90, 5, 10**9, 0)])
def test_equals_all_pairs(spark, monkeypatch, percent, block, at_once, large):
    """With lists, enumerated subsets up to a forced size, blocks smaller than families, stars before blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(verify, "AT_ONCE", at_once)
    monkeypatch.setattr(verify, "WIDE", 3)
    if large is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: large)
    rows = corpus(percent + block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df.withColumns({"rep": F.lit("x"), "n": F.lit(1), "component_id": F.lit(2)}), 3, percent) == brute(rows, 3, percent)


def test_every_way_to_meet_is_complete():
    """Sets that link share a subset key if both are small, an entry of the lists, and a part key: checked for all of them without Spark."""
    import numpy as np

    rnd = random.Random(4)
    for percent in (80, 90):
        sets = []
        for n in [9, 10, 11, 14, 18, 20, 22, 25] * 6:
            base = [rnd.getrandbits(64) for _ in range(n)]
            sets += [set(base), set(base[1:]), set(base[1:]) | {rnd.getrandbits(64)}, set(base[2:]) | {rnd.getrandbits(64)}]
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        batch = pa.record_batch([pa.array(range(len(arrays)), pa.int64()), pa.array([a.tobytes() for a in arrays], pa.binary())], ["rep", "sh"])
        keys = {}
        for b in jaccard._enumerated([batch], percent, 64 if percent == 90 else 15):
            for k, rep in zip(b.column("b").to_pylist(), b.column("rep").to_pylist(), strict=True):
                keys.setdefault(("subset", rep), set()).add(k)
        own, at, below, below_at = jaccard.part_keys(jaccard._remixed(np.concatenate(arrays)), np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), percent)
        for i in range(len(arrays)):
            keys["own", i], keys["below", i] = set(own[at[i] : at[i + 1]].tolist()), set(below[below_at[i] : below_at[i + 1]].tolist())
        for i, j in combinations(range(len(sets)), 2):
            a, b = sets[i], sets[j]
            if a != b and 100 * len(a & b) >= percent * len(a | b):
                assert keys["own", i] & keys["own", j] or keys["own", i] & keys["below", j] or keys["below", i] & keys["own", j]
                if percent == 90 or max(len(a), len(b)) < 15:
                    assert keys[("subset", i)] & keys[("subset", j)]
                first = lambda s: sorted(s)[: len(s) - -(-percent * len(s) // 100) + 1]
                assert set(first(a)) & set(first(b))


def test_the_boundary_follows_cost():
    """Few entries to scan: lists for all. Very long lists of small sets: these are enumerated."""
    assert jaccard.boundary([(10, 100, 200), (20, 100, 300)], 90) == 0
    assert jaccard.boundary([(9, 100, 100), (20, 100, 300)], 90) in (0, 10)
    assert jaccard.boundary([(10, 1000, 900_000), (20, 1000, 900_000), (40, 1000, 900_000)], 90) == 21
    assert jaccard.boundary([], 90) == 0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string"), 3, 90) == []
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (9, text + " x"), (None, text), (None, None), (3, None), (3, None)]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()), key=repr)
    assert out == sorted([(5, 48, 5), (5, 48, 5), (9, 49, 5), (None, 48, None), (None, 0, None), (3, 0, 3), (3, 0, 3)], key=repr)


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, text), (2, text + " more"), (3, " ".join(f"v{i}" for i in range(200_000)))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90) == [(1, 199_998, 1), (2, 199_999, 1), (3, 199_998, 3)]
