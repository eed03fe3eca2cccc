import math
import zlib

import regex
import xxhash
import zstandard
from tests_llm_corpus import prose

from gleanery.llm.toxicity import fit, saved, toxicity, train, windows

BAD = ["grumblefrot", "wibblesnark", "plonkwhistle"]


def text(k, toxic):
    w = prose(k, 20 + k % 60).split()
    if toxic:
        for j in range(2):
            w[(7 * j + k) % len(w)] = BAD[(k + j) % 3].upper() + ("," if j else "")
    return " ".join(w)


def test_held_out_accuracy(spark):
    rows = [(i, text(i, i % 4 == 0), "x", 9.0) for i in range(900)]
    docs = spark.createDataFrame([*rows, (5000, "", "x", 1.0), (5001, None, "x", 1.0), (None, "a", "x", 1.0), (8, rows[8][1], "x", 1.0)], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)] + [(3, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity(docs, train(docs, labels)).collect()
    assert len(out) == 904
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert [r.predicted for r in out if r.doc_id in (5000, 5001)] == [0, 0]
    assert len({r.score for r in out if r.doc_id == 8}) == 1


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity(docs, train(docs, labels)).collect()] == [0, 0]
    assert toxicity(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_windows_cover_the_whole_text():
    t = text(5, True) * 40
    assert b"".join(windows(t)).split() == t.lower().encode().replace(b",", b" ").split()
    m = fit([text(i, i % 2 == 0) for i in range(200)], [int(i % 2 == 0) for i in range(200)], 0.5)
    assert saved(prose(1, 3000) + " " + BAD[0], *m.compressors())[0] > 0


def test_scores_follow_from_the_lengths_of_all_windows(spark):
    texts = [text(i, i % 3 == 0) for i in range(300)]
    m = fit(texts, [int(i % 3 == 0) for i in range(300)], 0.3)
    params = zstandard.ZstdCompressionParameters.from_level(1, write_content_size=False, write_dict_id=False, strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=20, hash_log=17, chain_log=17, search_log=6, target_length=1)

    def lengths(content, coded):
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params)
        return [len(c.compress(w)) for w in coded]

    tail = prose(3, 40000) + " " + " ".join(BAD * 30)  # what tells is at the end of a long text
    for t in [*texts[:20], tail, "", "?! ...", "é" * 100000, texts[0] + "\x00" + texts[1]]:
        found = regex.findall(r"[a-z0-9\P{ASCII}]+", t.lower())
        coded = [b"".join(xxhash.xxh3_128(w.encode()).digest() for w in found[i : i + 16]) for i in range(0, len(found), 16)]
        d = [a - b for a, b in zip(lengths(m.ordinary, coded), lengths(m.toxic, coded), strict=True)]
        x = max([0, *d]), math.log1p(sum(v for v in d if v > 0)), sum(d) / max(1, len(d))
        assert saved(t, *m.compressors()) == (x[0], math.log1p(sum(v for v in d if v > 0)), x[2])
        z = sum(a * b for a, b in zip(m.weights, (*x, 1.0), strict=True))
        rows = spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")
        assert [round(r.score, 9) for r in toxicity(rows, m).collect()] == [round(1 / (1 + math.exp(-max(-30, min(30, z)))), 9)] * 2


def test_words_of_any_script_tell(spark):
    bad = ["réeuxment", "глупыйдурак", "achlichö", "笨蛋笨蛋"]

    def of(k):
        w = prose(k, 30 + k % 50).split()
        if k % 4 == 0:
            w[k % len(w)] = bad[k // 4 % 4]
            w[(k + 9) % len(w)] = bad[k // 4 % 4].capitalize()
        return " ".join(w)

    m = fit([of(k) for k in range(1200)], [int(k % 4 == 0) for k in range(1200)], 0.25)
    got = [m.score(saved(of(k), *m.compressors())) >= 0.5 for k in range(1200, 1600)]
    assert sum(g == (k % 4 == 0) for g, k in zip(got, range(1200, 1600), strict=True)) >= 0.97 * 400
    for b in range(4):
        assert sum(got[k - 1200] for k in range(1200, 1600) if k % 4 == 0 and k // 4 % 4 == b) >= 20


def test_held_out_rows_of_the_given_documents(spark):
    """AUC of 0.93 and nine tenths of the toxic rows, hardly a clean one, from what the fit never saw."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity(docs, train(docs, labels)).where("held_out").join(labels.where("toxic in (0, 1)"), "doc_id").select("score", "predicted", "toxic").toPandas()
    ranks, t = out.score.rank(), out.toxic == 1
    assert (ranks[t].sum() - t.sum() * (t.sum() + 1) / 2) / (t.sum() * (~t).sum()) >= 0.93
    assert out.predicted[t].mean() >= 0.85 and out.predicted[~t].mean() <= 0.01
