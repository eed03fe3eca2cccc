"""Every registered query with SQL against DuckDB on the smallest tables; the others by what must hold."""

import datetime
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import ann
from gleanery.operators import retrieval as R
from gleanery.plans import jobs  # noqa: F401
from gleanery.plans.queries import ORACLES, QUERIES
from gleanery.plans.views import view
from gleanery.sources import archives as AR

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if math.isnan(float(v)) else round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_ivf_recall(spark, sf):
    exact = {(r.query_id, r.id) for r in R.nearest(view(spark, sf, "chunk_vectors"), view(spark, sf, "search_queries"), 10).collect()}
    index, centers = ann.build_ivf(view(spark, sf, "chunk_vectors"), 8)
    q = view(spark, sf, "search_queries").where("vector is not null")
    near = {(r.query_id, r.id) for r in ann.knn_ivf(index, centers, q, 10, probes=6).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and index.count() == view(spark, sf, "chunk_vectors").count()


def test_hybrid_edges(spark, sf):
    chunks = view(spark, sf, "corpus_chunks")
    terms, vectors = R.postings(chunks), view(spark, sf, "chunk_vectors")
    v = vectors.orderBy("id").first().embedding
    q = spark.createDataFrame([(1, "what is the", v), (2, "the idiot and tion", None)], "query_id long, query string, vector array<float>")
    hits = R.hybrid_search(chunks, terms, vectors, q).collect()
    assert all(h.keyword_rank is None for h in hits if h.query_id == 1) and all(h.semantic_rank is None and h.similarity == 0 for h in hits if h.query_id == 2)
    only = R.hybrid_search(chunks, terms, vectors, q, languages=["Go"]).collect()
    assert only and {h.language for h in only} == {"Go"}


def test_archives(spark):
    files = spark.createDataFrame([("r", "src/" + "long/" * 30 + "a.ts", "x" * 10), ("r", "b.py", "y" * 300_000)], "repo_id string, path string, content string")
    packed = AR.pack_archives(files)
    out = {r.path: r for r in AR.open_archives(packed).collect()}
    assert bytes(out["src/" + "long/" * 30 + "a.ts"].content) == b"x" * 10 and out["b.py"].content is None and out["b.py"].size == 300_000
    assert all(len(r.commit_sha) == 40 for r in out.values())
    assert [r.problem for r in AR.open_archives(packed, most=10).collect()] == ["too large"]
    assert [r.problem for r in AR.open_archives(packed.withColumn("length", F.lit(1)), most=4000).collect() if r.problem] == ["unpacks to too much"]
    assert [r.problem for r in AR.open_archives(packed.withColumn("content", F.lit(b"no archive"))).collect()] == ["damaged"]


def test_a_repo_above_the_limit_keeps_all_its_files(spark):
    body = lambda k: "".join(np.random.default_rng(k).choice(list("0123456789abcdef"), 20_000))
    files = spark.createDataFrame([(repo, f"src/{k}.ts", body(k)) for repo, n in (("big", 60), ("r.part1-2", 2), (None, 1)) for k in range(n)], "repo_id string, path string, content string")
    packed = AR.pack_archives(files, most=100_000)
    assert packed.count() > 12 and packed.agg(F.max("length")).first()[0] < 100_000
    out = AR.open_archives(packed, most=100_000).withColumn("archive", AR.repo_of(F.col("archive"))).collect()
    want = [("big.tar.gz", f"src/{k}.ts", body(k)) for k in range(60)] + [("r.part1-2.tar.gz", f"src/{k}.ts", body(k)) for k in range(2)] + [("None.tar.gz", "src/0.ts", body(0))]
    assert sorted((r.archive, r.path, bytes(r.content).decode()) for r in out) == sorted(want)


def test_rejected_archives_have_rows(spark, sf, monkeypatch):
    whole = AR.pack_archives
    monkeypatch.setattr(AR, "pack_archives", lambda files: whole(files).withColumn("length", F.lit(AR.MAX_BYTES + 1).cast("long")))
    out = QUERIES["s1_archives"](spark, sf).collect()
    assert out and all(r.path is None and r.archive.endswith(".tar.gz") for r in out)


def test_every_benchmark_row_is_a_query(spark, sf, tmp_path):
    for t in ("benchmark", "embeddings", "documents"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        if t == "benchmark":
            df = df.union(df.select((F.col("item_id") + 40).alias("item_id"), "text"))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    first, all_ = (view(spark, d, "search_labels").collect() for d in (sf, str(tmp_path)))
    assert sorted(all_) == sorted([*first, *((r.query_id + 40, r.id) for r in first)])
    assert {r.query_id for r in QUERIES["t19_hybrid_search"](spark, str(tmp_path)).collect()} == set(range(80))


def test_throttle_and_expiry(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts", "event_type").orderBy("ts", "event_id").collect()
    last, kept = {}, set()
    for r in events:
        if r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() >= 4 * 3600:
            last[r.user_id] = r.ts
            kept.add(r.event_id)
    assert {r.event_id for r in QUERIES["st4_throttle"](spark, sf).collect()} == kept
    times = {}
    for r in events:
        if r.event_type == "signup":
            times.setdefault(r.user_id, []).append(r.ts)
    ttl, end = datetime.timedelta(days=5), max(t for ts in times.values() for t in ts) - datetime.timedelta(minutes=10)
    want = {(u, (a + ttl).replace(microsecond=0)) for u, ts in times.items() for a, b in zip(ts, [*ts[1:], None]) if (b is not None and b - a > ttl) or (b is None and a + ttl < end)}
    got = {(r.user_id, r.expired_at.replace(microsecond=0)) for r in QUERIES["st5_expire"](spark, sf).collect()}
    assert got == want


def test_second_run_changes_nothing(spark, sf):
    from gleanery.operators import incremental as I

    new = view(spark, sf, "snapshot_new")
    diff = I.diff_snapshot(new, new)
    assert diff.where("change != 'unchanged'").count() == 0 and I.stale_paths(diff).count() == 0


def test_vectors_are_unit(spark, sf):
    rows = R.hashed_embedding(view(spark, sf, "corpus_chunks")).collect()
    assert np.allclose([np.linalg.norm(r.embedding) for r in rows], 1) and {len(r.embedding) for r in rows} == {64}


def test_chunks_from_archives_are_those_of_the_files(spark, sf):
    from gleanery.operators import admission as AD
    from gleanery.operators import chunking as C

    files = view(spark, sf, "corpus_files").where(F.octet_length("content") <= 200 * 1024)
    want = C.chunk_files(AD.admit_files(files).where("reason is null")).select("id", "content").collect()
    assert sorted(QUERIES["c1_s4_archive_chunks"](spark, sf).select("id", "content").collect()) == sorted(want) and len(want) > 100


def test_wanted_paths_are_those_that_admission_keeps(spark):
    from gleanery.functions import paths as P

    paths = ["a.ts", "src/.hidden/a.ts", "./a.py", "node_modules/x.js", "a/b.min.js", "Dockerfile", "x/.py", "nodot", "a.PY", "v/CHANGELOG.md", "a_pb2.py", "b.PB.go", "dist", "x/package.json", "a.d.ts", "yarn.lock", "testdata/a.go", "a.png"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", P.skip_reason_path(F.col("path")).isNull().alias("keep")).collect()
    assert [P.wants_content(r.path) for r in rows] == [r.keep for r in rows]


def test_vectors_without_length(spark):
    v = spark.createDataFrame([(1, "r", "Go", [0.0, 0.0]), (2, "r", "Go", [1.0, 0.0]), (3, "r", "Go", None), (4, "r", "Go", [0.0, -2.0])], "id long, repo_id string, language string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<float>")
    got = {(r.query_id, r.id): (r.similarity, r.semantic_rank) for r in R.nearest(v, q).collect()}
    assert got == {(1, 2): (1.0, 1), (1, 1): (0.0, 2), (1, 4): (0.0, 3), (2, 1): (0.0, 1), (2, 2): (0.0, 2), (2, 4): (0.0, 3)}
    sims = v.crossJoin(q.withColumnRenamed("query_id", "q")).select("id", "q", R.cosine(F.col("embedding"), F.col("vector")).alias("s")).collect()
    assert {(r.q, r.id): r.s for r in sims if r.s is not None} == {k: s for k, (s, _) in got.items()}
    assert {(r.id, r.query_id) for r in R.best_query(v, q).collect()} == {(1, 1), (2, 1), (4, 1)}


def test_many_queries_meet_blocks_of_vectors(spark, sf):
    v, q = view(spark, sf, "chunk_vectors"), view(spark, sf, "search_queries").where("vector is not null").withColumn("repo_id", F.when(F.col("query_id") % 3 == 0, "src1"))
    want = R.nearest(v, q, 7).collect()
    blocks = R._nearest_blocks(v.where("embedding is not null"), q.select("query_id", "vector", "repo_id"), 7, q_rows=9, v_rows=30)
    got = R.ranked(blocks, [F.desc("similarity"), F.asc("id")], 7, "semantic_rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100


def test_an_embedder_of_ones_own(spark, sf):
    chunks = view(spark, sf, "corpus_chunks").limit(20)
    out = R.embed(chunks, lambda df: df.select("id", F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))).collect()
    assert len(out) == 20 and all(np.allclose(r.embedding, [0.6, 0.8]) for r in out)
    assert R.embed(chunks, lambda df: df.select("id", F.array(F.lit(0.0)).alias("embedding"))).count() == 0


def test_stored_postings_answer_as_fresh_ones(spark, sf, tmp_path):
    from gleanery.sources import tables as TB

    terms, q = R.postings(view(spark, sf, "corpus_chunks")), view(spark, sf, "search_queries")
    TB.write_terms(terms, f"{tmp_path}/t")
    stems = R.query_stems(q)
    got = TB.read_terms(spark, f"{tmp_path}/t", stems)
    assert sorted(map(tuple, R.text_rank(got, q).collect())) == sorted(map(tuple, R.text_rank(terms, q).collect()))
    assert got.select("term").distinct().count() <= stems.select("term").distinct().count()
    assert [TB.bucket_count(n) for n in (0, 1, 10**9)] == [16, 16, 512]


def test_containing_finds_all_texts(spark):
    docs = [(1, "x the quick brown fox jumps over y"), (2, "the quick  brown fox jumps over"), (3, "athe quick brown fox jumps overb"), (4, None), (5, "short one"), (6, "")]
    items = [(1, "the quick brown fox jumps over"), (2, "one"), (3, None), (4, "quick brown fox jumps"), (5, "the quick  brown fox jumps over")]
    out = R.containing(spark.createDataFrame(items, "query_id long, text string"), spark.createDataFrame(docs, "id long, text string")).collect()
    want = {(q, i) for q, t in items for i, d in docs if t is not None and d is not None and t in d}
    assert {(r.query_id, r.id) for r in out} == want and len(out) == len(want)


def both(spark, name, tables, folder):
    """A query's rows over own tables (name -> DataFrame), and those of its SQL, in the same order."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    return [sorted(rows, key=str) for rows in (map(tuple, QUERIES[name](spark, str(folder)).select(*want.columns).collect()), want.fetchall())]


def test_vector_literals_round_as_the_sql_does(spark, sf, tmp_path):
    odd = [[0.0703125, -0.0703125, 0.0234375, 123456.0078125], [float("nan"), float("inf"), float("-inf"), 1e30, -0.0, -1e-9], [1.0, None, 2.0], [], None]
    vectors = spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>")
    documents = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") < len(odd))
    got, want = both(spark, "f15_vector_literal", {"embeddings": vectors, "documents": documents}, tmp_path)
    assert got == want and len(got) == len(odd) and got[0][1] == "[0.070312,-0.070312,0.023438,123456.007812]"


def test_archive_texts_at_the_limits_of_admission(spark, tmp_path):
    texts = ["x" * 300, "x" * 301, "é" * 299, "a\n" + "x" * 598, "b\n" * 20 + "x" * 2000, "b\n" * 20 + "x" * 2001, "b\n" * 20 + "x" * 1999 + "\n", "", "a\0b", "�", "x" * 299 + "�", "﻿" + "x" * 299, "\n", None, ("y" * 99 + "\n") * 2047 + "y" * 96, ("y" * 99 + "\n") * 2047 + "y" * 97]
    documents = spark.createDataFrame([(6 * k + 1, t, "en", "s") for k, t in enumerate(texts) if (6 * k + 1) % 13 and (6 * k + 1) % 17] + [(6 * (k + 300) + 1, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got, want = both(spark, "f6_s4_archive_texts", {"documents": documents}, tmp_path)
    assert got == want and {r[3] for r in got} == {"kept", "minified", "binary"} and len(got) > len(texts)
