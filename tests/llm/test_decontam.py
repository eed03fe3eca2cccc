import numpy as np
import regex
from tests_llm_corpus import prose

import gleanery.llm.decontam as D
from gleanery.llm.decontam import SHORT_CHARS, SPAN, leaks


def toks(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def brute(docs, items, window=13, percent=80):
    """Every window on every diagonal; knows no seeds, so it also measures what they find."""
    out = {}
    for i, t in docs:
        d = toks(t)
        for j, u in items:
            q = toks(u)
            if not q or (len(q) < SPAN and len("".join(q)) < SHORT_CHARS):
                continue
            for diag in range(-len(q), len(d)):
                eq = [0 <= diag + k < len(d) and d[diag + k] == q[k] for k in range(len(q))]
                w = min(window, len(q))
                best = max(sum(eq[k : k + w]) for k in range(len(q) - w + 1))
                if best * 100 >= w * (percent if len(q) >= SPAN else 100):
                    out[i, j] = max(out.get((i, j), (0, 0, -(10**9))), (best, w, -diag))
    return {k: (m, w, -d) for k, (m, w, d) in out.items()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    items = [(k, prose(k, 14 + k)) for k in range(12)] + [(50, "too short to tell"), (51, prose(51, 9)), (52, None), (53, prose(53, 8)), (54, prose(54, 10)), (55, "extraordinarily longwinded benchmark sentence"), (56, "unüberwindlicheschwierigkeiten")]
    docs = []
    for k in range(60):
        w = prose(1000 + k, 60).split()
        if k % 2:
            p = (items[k % 12][1] or "").split()
            for _ in range(k % 5):
                p[rng.integers(len(p))] = "swapped"
            w[20:20] = p
        docs.append((k, " ".join(w).upper() if k % 3 == 0 else ", ".join(w)))
    for n, k in enumerate((13, 15, 16)):  # all patterns of one and two substitutions in short items
        p = items[k][1].split()
        for i in range(len(p)):
            for j in range(i, len(p)):
                docs.append((1000 + 200 * n + 13 * i + j, " ".join(["x"] * (i % 3) + [f"sub{i}" if m in (i, j) else w for m, w in enumerate(p)] + ["y"] * (j % 3))))
    docs += [(200, "some " + items[17][1] + " more"), (201, items[17][1].replace("longwinded", "other")), (202, items[18][1] + "."), (203, items[18][1] + "x")]
    docs += [(100, items[13][1]), (101, ""), (102, None), (103, items[51 - 38][1]), (104, items[0][1] + " " + items[0][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_match, r.n_tokens, r.doc_start) for r in leaks(df, bench).collect()}
    assert got == brute(docs, items)
    assert {(k, k % 12) for k in range(1, 60, 2) if k % 5 < 3} | {(200, 55), (202, 56)} <= set(got)


def test_many_seeds_go_by_a_bitmap(spark, monkeypatch):
    items = [(k, prose(k, 20)) for k in range(8)]
    docs = [(k, prose(100 + k, 10) + " " + items[k % 8][1] + " " + prose(200 + k, 9)) for k in range(12)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "MANY", 5)
    monkeypatch.setattr(D, "WORDS", 40)
    assert {(r.doc_id, r.item_id): (r.n_match, r.n_tokens, r.doc_start) for r in leaks(df, bench).collect()} == brute(docs, items)


def test_nulls_repeated_rows_and_empty(spark):
    t = prose(3, 20)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, t), (7, t), (None, t)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in leaks(df, bench).collect()] == [(1, 7)]
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, prose(3, 20))], "doc_id long, text string")
    plan = leaks(df, df.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
