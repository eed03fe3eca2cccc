import re
import zlib
from collections import Counter
from math import log, log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tests_llm_corpus import prose

from gleanery.llm import common as C
from gleanery.llm.pst import DEPTH, END, _grams, block_words, canonical, retained, roots, score

SPLIT = r"[^\x20\x09-\x0D]+"


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(SPLIT, t), None]


def rows():
    words = prose(1, 200).split()
    rng = np.random.default_rng(0)
    out = [(k, " ".join(rng.choice(words, rng.integers(1, 80))).title()) for k in range(300)]
    return out + [(1000, ""), (1001, None), (1002, "  \t\n "), (1003, "Unseen12 wörds here"), (1004, "x" * 3000)]


def test_base_score_and_counts(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in data], "doc_id long, text string, score double, train_tokens int").repartition(3)
    train = Counter(w for i, t in data if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    out = {r.doc_id: r for r in score(df).collect()}
    assert len(out) == len(data)
    for i, t in data:
        r, ws = out[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-6)
        assert r.score < 0
    held = [r for r in out.values() if r.held_out and r.doc_id < 1000]
    out_ids = [k for k in range(5000, 9000) if zlib.crc32(str(k).encode()) % 10 == 0]  # held out too, or their letters would be learned
    shuffled = [(out_ids[n], "".join(np.random.default_rng(1).permutation(list(dict(data)[r.doc_id])))) for n, r in enumerate(held)]
    mixed = score(spark.createDataFrame([*data, *shuffled], "doc_id long, text string")).where("doc_id >= 5000").collect()
    assert sum(r.score for r in mixed) < 1.3 * sum(r.score for r in held)  # the order of letters was learned


def brute(data, least=2):
    """The retained contexts, found one by one, and the log10 probability of each text."""
    streams = {}
    counts = {}
    for i, t in data:
        streams[i] = b = b"\0" * DEPTH + b" ".join(w.encode() for w in tokens(t)[:-1]) + b"\n"
        if zlib.crc32(str(i).encode()) % 10:
            for k in range(DEPTH, len(b)):
                for d in range(DEPTH + 1):
                    counts.setdefault(b[k - d : k], Counter())[b[k]] += 1
    total = {c: sum(n.values()) for c, n in counts.items()}

    def passes(c):
        n = counts[c]
        gain = sum(k * log(k / total[c] / (counts[c[1:]][b] / total[c[1:]])) for b, k in n.items())
        return total[c] >= least and gain > 0.5 * len(n) * log(total[c])

    kept = {c for c in counts if c and passes(c)}
    kept |= {c[j:] for c in kept for j in range(len(c) - 1)}
    kept = {c for c in kept if passes(c[-1:])}

    def p(c, b):
        if not c:
            return (counts[b""][b] + 0.5) / (total[b""] + 128)
        up = p(c[1:], b)
        return (counts[c][b] + len(counts[c]) * up) / (total[c] + len(counts[c])) if c in kept else up

    return kept, counts, {i: sum(log10(p(s[k - DEPTH : k], s[k])) for k in range(DEPTH, len(s))) for i, s in streams.items()}


def test_against_brute_force(spark):
    data = rows()[:60] + rows()[-5:]
    kept, counts, want = brute(data)
    assert 100 < len(kept) < 0.9 * sum(len(c) > 0 for c in counts) and {len(c) for c in kept} == set(range(1, DEPTH + 1))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for mb in (1, 16):
        got = {r.doc_id: r.score for r in score(df, block_mb=mb).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-4) for i in want)
    # the retained contexts themselves, both ways
    gram = Counter({(c, b): n for c, x in counts.items() if len(c) == DEPTH for b, n in x.items()})
    key = np.array([int.from_bytes(c + bytes([b]), "big") for c, b in gram], np.uint64)
    pair = Counter({(c[0] << 8) | b: n for c, x in counts.items() if len(c) == 1 for b, n in x.items()})
    top = roots(np.array(list(pair)), np.array(list(pair.values())), 2)
    got = {g.tobytes()[::-1][8 - k - 1 : 7] for k, grams, _ in retained(key, np.array(list(gram.values())), top, 2) for g in grams}
    assert got == {c for c in kept if len(c) > 1} and {bytes([c]) for c in np.flatnonzero(top.keep)} == {c for c in kept if len(c) == 1}


def test_words_are_told_apart(spark):
    """Two words whose polynomial hashes modulo 2**64 are equal whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    train, held = next(k for k in range(9, 99) if zlib.crc32(str(k).encode()) % 10), next(k for k in range(9, 999) if not zlib.crc32(str(k).encode()) % 10)
    out = {r.doc_id: r for r in score(spark.createDataFrame([(train, a), (held, b)], "doc_id long, text string")).collect()}
    assert (out[train].n_known, out[held].n_known) == (2, 1)


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (2, None)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in score(df).collect())
    assert out == [(0, 3, 2, 7), (1, 3, 3, 7), (1, 3, 3, 7), (2, 1, 1, 7)]
    assert score(df.limit(0)).count() == 0


def test_a_rare_context_keeps_its_probability_when_the_corpus_grows(spark):
    """The same 20 texts of a rare vocabulary, alone and beside 3 MB of others: a share of all bytes would drop their contexts."""
    ids = [k for k in range(100000) if zlib.crc32(str(k).encode()) % 10]
    rare = [(k, "qxjzv wqkzx") for k in ids[:20]]
    words = prose(2, 300).split()
    rng = np.random.default_rng(3)
    many = [(k, " ".join(rng.choice(words, 600))) for k in ids[20:1020]]
    df = spark.createDataFrame([*rare, *many], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in score(df).where(F.col("doc_id") <= ids[19]).collect()}
    assert all(got[k] > -6 for k, _ in rare)


def table(texts):
    return pa.table([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([0] * len(texts), pa.int32())], names=["doc_id", "text", "block"])


def test_a_block_digests_each_word_once(monkeypatch):
    """Blocks are read in slices of a megabyte; their common words were digested again in each."""
    words = [f"w{k}" for k in range(500)]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(words, 5000)) for _ in range(150)]
    assert sum(map(len, texts)) > 3 << 20
    seen, digest = [], xxhash.xxh3_128_digest
    monkeypatch.setattr(xxhash, "xxh3_128_digest", lambda w: seen.append(w) or digest(w))
    got, n = block_words(table(texts), 10)
    assert sorted(seen) == sorted(w.encode() for w in words)
    train = Counter(w for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10 for w in tokens(t))
    want = {digest(w.encode()) if w else END.tobytes(): c for w, c in train.items()}
    assert {d.tobytes(): c for d, c in zip(got, n, strict=True)} == want


@pytest.mark.parametrize("texts", [[], [""], ["", " \t", ""], ["A", "", " b\x0bC ", "\0", "\0 \0\0", "É ÀZ　z", "x\n", "\nx", "  ", "Zz"], ["", "a" * (1 << 20), "", "b c" * 400000, " "]])
def test_the_form_that_is_read(texts):
    data, at = C.binary(table(texts).column("text"))
    c = canonical(data, at)
    words = [[w.encode() for w in tokens(t)[:-1]] for t in texts]
    rows = [b" ".join(w) + b"\n" for w in words]
    assert c.x.tobytes() == b"".join(b"\0" * DEPTH + r for r in rows)
    assert c.x[c.real].tobytes() == b"".join(rows) and c.sizes.tolist() == [*map(len, rows)]
    assert c.letters.tobytes() == b"".join(w for r in words for w in r)
    assert c.lengths.tolist() == [len(w) for r in words for w in r] and c.words.tolist() == [*map(len, words)]
    some = np.flatnonzero(c.real)[:: max(1, int(c.real.sum()) // 1000)]
    key = dict(zip(np.flatnonzero(c.real), _grams(c), strict=True))
    assert all(int(key[k]) == int.from_bytes(c.x[k - DEPTH : k + 1].tobytes(), "big") for k in some)


def test_odd_bytes_and_long_texts_against_brute_force(spark):
    """NUL bytes beside the zero bytes before a text, bare texts, and a text that is a slice of its own."""
    rng = np.random.default_rng(5)
    words = ["\0", "\0\0a", "é", "　", *prose(6, 40).split()]
    data = [(k, " ".join(rng.choice(words, 30))) for k in range(40)]
    data += [(50, ""), (51, None), (52, "\n"), (53, "\0" * 9), (54, " ".join(rng.choice(words, 220000))), (55, " ")]
    assert len(data[-2][1]) > 1 << 20
    kept, _, want = brute(data)
    got = {r.doc_id: r for r in score(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    train = Counter(w for i, t in data if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in data:
        assert got[i].score == pytest.approx(want[i], rel=1e-4)
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)))
        assert got[i].base_score == pytest.approx(sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), rel=1e-9)
