import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.llm.suffix import Suffixes, exact_substring_dedup


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("aeioustné"), rng.integers(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = []
    for k in range(60):
        t = prose(int(rng.integers(0, 120)))
        if k % 3 == 0:
            t += " " + shared[k % 4][int(rng.integers(0, 40)) :] + prose(int(rng.integers(0, 10)))
        if k % 7 == 0 and texts:
            t = texts[int(rng.integers(len(texts)))] or ""
        if k % 11 == 0:
            t = t + t + "z" * int(rng.integers(0, 400))
        texts.append(t)
    return texts + ["", None, "ab" * 300, "ab" * 200, "x" * 99, "x" * 100, "x" * 101]


@pytest.mark.parametrize("length,many", [(100, 64), (40, 64), (100, 2)])
def test_against_brute_force(spark, length, many):
    rows = [(5 * i, t) for i, t in enumerate(corpus(length))]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, bucket string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_substring_dedup(df, length=length, digests=True, many=many).collect()}
    assert got == brute(rows, length)


def test_repeated_rows_nulls_and_empty(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(150)) + "end"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, len(r.kept)) for r in exact_substring_dedup(df).collect())
    first = brute([(1, t)], 100)[1][1]
    assert got == [(0, 0, 0), (1, first, len(t) - first), (1, first, len(t) - first), (2, len(t), 0)]
    assert exact_substring_dedup(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """Each is cut where its own text repeats, in the order of (id, text's hash)."""
    w = "".join(chr(97 + i * i % 23) for i in range(150))
    t = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(300))
    texts = [(1, t), (3, w + t), (3, "".join(chr(97 + (i * i * 3 + 5 * i) % 25) for i in range(420))), (3, "x" * 30), (None, t[:200]), (None, w)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    order = [r.text for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    want = brute(list(enumerate(order)), 100)
    got = {r.kept_sha256 + str(r.n_bytes): r.n_removed for r in exact_substring_dedup(df, digests=True).collect()}
    assert got == {v[3] + str(v[0]): v[1] for v in want.values()} and sum(got.values()) > 300


def test_long_texts_go_piece_by_piece(spark, monkeypatch):
    import gleanery.llm.suffix as S

    monkeypatch.setattr(S, "PIECE", 256)
    rng = np.random.default_rng(4)
    x, y = ("".join(rng.choice(list("abcdefgh"), n)) for n in (900, 3000))
    data = [(1, x), (2, y[:700] + x + y[700:]), (3, y[100:2000] + x[:300])]
    raw = [t.encode() for _, t in data]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    windows = np.zeros(at[-1], int)
    for r in S._cut_pieces(np.frombuffer(b"".join(raw), np.uint8), at, 100):
        for s, n in zip(r["s"], r["n"], strict=True):
            windows[s : s + n] += 1
    for a, b in zip(at[:-1], at[1:], strict=True):  # every window start once
        assert (windows[a : b - 99] == 1).all() and not windows[b - 99 : b].any()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), digests=True).collect()}
    assert got == brute(data, 100)


def test_bytes_are_compared_behind_hashes(spark, monkeypatch):
    """With hashes that call all contexts of a k-gram equal, a task still removes only what is equal."""
    import gleanery.llm.suffix as S

    real = S.runs
    monkeypatch.setattr(S, "runs", lambda *a: (r := real(*a)) | {"c1": np.zeros_like(r["c1"]), "c2": np.zeros_like(r["c2"])})
    rng = np.random.default_rng(9)
    x = "".join(rng.choice(list("abcdefgh"), 150))
    texts = [(k, x[:110] + "".join(rng.choice(list("abcdefgh"), 60))) for k in range(5)] + [(9, x)]
    batch = pa.record_batch([[i for i, _ in texts], [0] * 6, [t for _, t in texts]], ["doc_id", "row", "text"])
    gone = [C.unpack([b], S.MARK) for out in S._cut(iter([batch]), 100, 7, 64) for k, b in zip(*(c.to_pylist() for c in out.columns), strict=True) if k >= 7]
    seen = {t[s : s + 100] for i, t in texts for s in range(len(t) - 99) if sum(u.count(t[s : s + 100]) for _, u in texts) > 1}
    marked = [dict(texts)[d][s + k : s + k + 100] for m in gone for d, s, n in zip(m["doc"], m["s"], m["n"], strict=True) for k in range(n)]
    assert set(marked) <= seen


def test_suffix_sort():
    rng = np.random.default_rng(3)
    buffer = rng.choice(np.frombuffer(b"ab", np.uint8), 4000)
    start = rng.integers(0, 3800, 900)
    size = rng.integers(0, 150, 900)
    group = np.sort(rng.integers(0, 40, 900))
    s = Suffixes(buffer, start, size)
    order, lcp = s.ordered(group)
    text = [buffer[a : a + n].tobytes() for a, n in zip(start, size)]
    assert [(group[i], text[i]) for i in order] == sorted((group[i], text[i]) for i in range(900))
    for i in range(1, 900):
        x, y = text[order[i - 1]], text[order[i]]
        n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert lcp[i] == (n if group[order[i - 1]] == group[order[i]] else -1)


def test_collisions_are_found_out(monkeypatch):
    monkeypatch.setattr(Suffixes, "common", lambda self, x, y: np.minimum(self.size[x], self.size[y]))
    s = Suffixes(np.frombuffer(b"cabb", np.uint8), np.array([0, 1, 2]), np.array([1, 1, 1]))
    order, lcp = s.ordered(np.zeros(3, int))
    assert order.tolist() == [1, 2, 0] and lcp.tolist() == [-1, 0, 0]
