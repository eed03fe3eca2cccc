"""The prefix trie equals one built by putting every prefix of every rebuilt conversation into a dictionary."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + ts[h:])
    return out


def brute(rows):
    members, ends = defaultdict(set), defaultdict(list)
    for c, seq in rebuilt(rows).items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * len(k[-1][1].encode() if k else b"") + sum(saved[x] for x in kids[k])
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(k)) for k, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in trie.prefix_trie(df).collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n, most=9, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-20, 3 * n), n):
        if rnd.random() < 0.3:  # a copy of a common one, or its beginning
            rows += [(c, t, "user", f"common {t}") for t in range(rnd.choice([3, most, most]))]
        else:
            rows += [(c, t, rnd.choice(["user", "bot", None]), rnd.choice([None, "", "é", *(f"w{k}" for k in range(words))])) for t in range(rnd.randint(1, most))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "most"), [(1, 400, 9), (2, 60, 30)])
def test_equals_a_dictionary_of_prefixes(spark, seed, n, most):
    """Turns of few kinds: long common beginnings, copies on both sides of every border between runs."""
    rows = conversations(seed, n, most)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df.withColumns({"seq": F.lit(1), "depth": F.lit("x"), "five": F.lit(2), "node": F.lit(3)})) == brute(rows)


def test_copies_over_many_runs(spark):
    """Most conversations are one and the same: their ids are hashed in order across all runs, in pieces."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(500) for t in range(12)] + [(5 * c + 1, 0, "user", "other") for c in range(40)]
    before, trie.PIECE = trie.PIECE, 64
    try:
        out = got(spark.createDataFrame(rows, SCHEMA))
    finally:
        trie.PIECE = before
    assert out == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "a", "b"), (1, 0, "a", "c"), (1, 0, "a", "c"), (1, 7, None, "x"), (None, 0, "a", "b"), (0, 3, "a", "é"), (0, None, "q", ""), (10, None, None, "z"), (11, 0, "ab", "c"), (16, 0, "a", "bc"), (-3, 1, "u", "v"), (-5, 1, "u", "w")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "u", "gone"), (c, 1, "u", "gone too")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute(rows)


def test_empty_table_and_long_texts(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(c, t, "u", "x" * 3_000_000) for c in (0, 5) for t in range(10)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_forests_of_single_runs():
    """Without Spark: the forest's nodes are the branchings and ends of a sorted run."""
    rnd = random.Random(9)
    for _ in range(200):
        seqs = sorted(bytes(b for _ in range(rnd.randint(0, 5)) for b in [rnd.randint(0, 2)] * 16) for _ in range(rnd.randint(1, 12)))
        turns = np.array([len(s) // 16 for s in seqs])
        depth, lo, hi, up = trie.Forest(turns, trie.shared_turns(seqs)).compact()
        prefixes = {s[: 16 * d] for s in seqs for d in range(len(s) // 16 + 1)}
        kids = {p: {q for q in prefixes if len(q) == len(p) + 16 and q.startswith(p)} for p in prefixes}
        want = sorted((len(p) // 16, sum(s < p and not s.startswith(p) for s in seqs), sum(s.startswith(p) for s in seqs)) for p in prefixes if len(kids[p]) > 1 or p in seqs)
        assert sorted(zip(depth.tolist(), lo.tolist(), (hi - lo + 1).tolist(), strict=True)) == want
        assert all(u < 0 or (depth[u] < d and lo[u] <= a and b <= hi[u]) for d, a, b, u in zip(depth, lo, hi, up, strict=True)) and (up < 0).sum() == 1
