import hashlib

import public_tokenizers
import test_cdc
import test_decontam
import test_minhash
from tokenizers import Tokenizer

import corpus_pipeline
from gleanery.llm import toxicity


def threes(text):
    """Runs of three words. A window with 80 % equal words has at most two others in 13, so it holds such a run whole."""
    w = test_decontam.toks(text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_against_brute_force(spark, sf):
    docs, bench, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, labels)
    both = model.compressors()
    rows = {i: t for i, t in rows.items() if model.score(toxicity.saved(t or "", *both)) < 0.5}
    near = test_minhash.brute(sorted(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if near[i][1] == i}
    kept = test_cdc.brute(rows.items(), 96)
    rows = {i: kept[i].decode() for i, t in rows.items() if kept[i].strip() or kept[i] == (t or "").encode()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    runs = [(x, threes(x[1])) for x in items]
    found = {i for i, t in rows.items() if (own := threes(t)) and test_decontam.brute([(i, t)], [x for x, r in runs if r & own])}
    rows = {i: t for i, t in rows.items() if i not in found}
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in rows.items():
        ids = known.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
    assert 0.5 * docs.count() < len(want) < docs.count()


def test_nulls_repeated_rows_and_clashing_columns(spark, sf):
    from tests_llm_corpus import prose

    t = [prose(k, 80) for k in range(4)]
    rows = [(1, t[0]), (1, t[0]), (2, t[0]), (3, None), (4, ""), (None, t[1]), (None, None), (5, t[1] + " " + t[2]), (6, t[3])]
    df = spark.createDataFrame([(i, x, k, "x", -1, 0.5, True) for k, (i, x) in enumerate(rows)], "doc_id long, text string, bucket int, rest string, row int, score double, kept boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.schema.names == df.schema.names, name
        got = {r.bucket: (r.doc_id, r.text, r.rest, r.row, r.score, r.kept) for r in out.collect()}
        gone = {2} if name == "minhash_near_dedup" else {2} if name == "substring_dedup" else set()  # the copy of document 1
        assert set(range(len(rows))) - set(got) == gone, name
        assert all((v[0], *v[2:]) == (rows[k][0], "x", -1, 0.5, True) for k, v in got.items()), name
        changed = {k for k, v in got.items() if (v[1] or "") != (rows[k][1] or "")}
        assert changed == ({7} if name == "substring_dedup" else set()), name


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
