import numpy as np
from pyspark.sql import functions as F

from gleanery.llm.cdc import GEAR, chunk_dedup, chunks, gear
from tests_llm_corpus import prose


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_gear_is_the_rolling_hash():
    texts = ["héllo wörld " * 9, "", "abc" * 40]
    data, at = arrays(texts)
    want = []
    for t in texts:
        h = 0
        for b in t.encode():
            h = (2 * h + int(GEAR[b])) % 2**32
            want.append(h)
    assert gear(data, at).tolist() == want


def test_chunks_cover_rows_and_characters():
    texts = [prose(1, 300), "", "é" * 3000, "x", prose(2, 5000)]
    data, at = arrays(texts)
    s, e = chunks(data, at, 5, 12, 512)
    assert (s[1:] == e[:-1]).all() and s[0] == 0 and e[-1] == len(data) and (e - s).max() <= 512
    assert set(at[1:].tolist()) <= set(e.tolist())
    for a, b in zip(s, e):
        data[a:b].tobytes().decode()
    shifted, _ = chunks(*arrays(["Some words before. " + texts[0]]), 5, 12, 512)
    own, _ = chunks(*arrays([texts[0]]), 5, 12, 512)
    assert len(set((shifted - 19).tolist()) & set(own.tolist())) > 0.8 * len(own)


def brute(rows, least_run):
    """Chunks by the operator's cuts, compared as text in order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        s, e = chunks(*arrays([t or ""]), 4, 8, 512)
        dup = []
        for a, z in zip(s, e):
            dup.append(b[a:z] in seen)
            seen.add(b[a:z])
        kept, k = [], 0
        while k < len(s):
            j = k
            while j < len(s) and dup[j] == dup[k]:
                j += 1
            if not (dup[k] and e[j - 1] - s[k] >= least_run):
                kept.append(b[s[k] : e[j - 1]])
            k = j
        out[i] = b"".join(kept)
    return out


def test_against_brute_force(spark):
    shared = prose(9, 80)
    texts = [prose(k, 20 + 3 * k) + (" " + shared + " " + prose(100 + k, 9) if k % 2 else "") for k in range(40)]
    texts += [texts[3], texts[3] + " more", "", None, "z" * 2000]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: bytes(r.kept) for r in chunk_dedup(df).collect()}
    assert got == brute(rows, 96)
    assert all(len(got[3 * k]) < len(texts[k].encode()) - 0.6 * len(shared.encode()) for k in range(3, 40, 2))
    assert all(got[3 * k] == texts[k].encode() for k in range(0, 40, 2))


def test_repeated_rows_nulls_and_empty(spark):
    t = prose(5, 90)
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in chunk_dedup(df, digests=True).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(t.encode()))]
    assert chunk_dedup(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    w, t = prose(1, 30), prose(2, 90)
    texts = [(1, t), (3, w + t), (3, prose(3, 120)), (3, "x" * 30), (None, prose(4, 50)), (None, w)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    order = [r.text for r in df.orderBy("doc_id", F.xxhash64("text")).collect()]
    want = brute(list(enumerate(order)), 96)
    got = sorted(bytes(r.kept) for r in chunk_dedup(df).collect())
    assert got == sorted(want.values()) and len(b"".join(got)) < len("".join(order).encode()) - 300
