"""Questions with repos and languages of their own."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import retrieval as R
from gleanery.plans.views import view
from gleanery.sources import tables as TB

SCHEMA = "query_id long, query string, vector array<float>, repo_ids array<string>, languages array<string>"


@pytest.fixture(scope="module")
def corpus(spark, sf):
    chunks = view(spark, sf, "corpus_chunks")
    return chunks, TB.materialize(R.postings(chunks)), view(spark, sf, "chunk_vectors")


def asked(spark, sf):
    """Every mix of scopes, for one question each."""
    q = view(spark, sf, "search_queries").where("vector is not null").orderBy("query_id").limit(16).collect()
    repos, languages = ([None], ["src1"], ["src2", "src5", None], []), (["Go"], None, ["Markdown", "Rust"], [])
    scopes = list(itertools.product([None, *repos[1:]], languages))
    return [(r.query_id, r.query, r.vector, *scope) for r, scope in zip(q, scopes, strict=True)]


def test_each_question_finds_what_a_search_of_its_scope_alone_finds(spark, sf, corpus):
    """The mixed set equals one search a question over the chunks that it may find, so neither leg ranks others."""
    chunks, terms, vectors = corpus
    rows = asked(spark, sf)
    hits = R.hybrid_search(chunks, terms, vectors, spark.createDataFrame(rows, SCHEMA))
    got = {k: sorted(tuple(r) for r in v) for k, v in itertools.groupby(sorted(hits.drop("path").collect(), key=lambda r: r.query_id), lambda r: r.query_id)}
    for query_id, query, vector, repos, languages in rows:
        only = lambda df: df.where((F.col("repo_id").isin([r for r in repos or [] if r]) if repos else F.lit(True)) & (F.col("language").isin(languages) if languages else F.lit(True)))  # noqa: B023, E731
        alone = spark.createDataFrame([(query_id, query, vector)], "query_id long, query string, vector array<float>")
        want = R.hybrid_search(only(chunks), only(terms), only(vectors), alone).drop("path").collect()
        assert got.get(query_id, []) == sorted(tuple(r) for r in want)


def test_one_repo_id_a_question(spark, sf, corpus):
    """A keyword hit of another repo doesn't come in (repo_id as validate_queries names it)."""
    chunks, terms, vectors = corpus
    rows = [(r[0], r[1], r[2], f"src{r[0] % 7}") for r in asked(spark, sf)]
    hits = R.hybrid_search(chunks, terms, vectors, spark.createDataFrame(rows, "query_id long, query string, vector array<float>, repo_id string"))
    out = hits.join(chunks.select("id", "repo_id"), "id").collect()
    assert len(out) > 10 and all(r.repo_id == f"src{r.query_id % 7}" for r in out)
    assert any(r.keyword_rank for r in out) and any(r.semantic_rank for r in out)


def test_checked_requests_are_searched_in_their_scope(spark, sf, corpus):
    chunks, terms, vectors = corpus
    repos = spark.createDataFrame([("src1", "ready", 5), ("src2", "indexing", 5), ("src3", "ready", 0)], "id string, status string, embedded_chunks int")
    text = asked(spark, sf)[0][1]
    requests = spark.createDataFrame([(1, "src1", text, ["Go", None]), (2, "src2", text, None), (3, "src3", text, None), (4, "src9", text, None), (5, "src1", " ", None)], "query_id long, repo_id string, query string, languages array<string>")
    ok = R.validate_queries(requests, repos).where("problem is null").withColumn("vector", F.lit(None).cast("array<float>"))
    out = R.hybrid_search(chunks, terms, vectors, ok).join(chunks.select("id", "repo_id"), "id").collect()
    assert {r.query_id for r in out} <= {1, 2} and all((r.repo_id, r.language) == ("src1", "Go") for r in out if r.query_id == 1) and any(r.repo_id == "src2" for r in out)


def test_many_words_meet_postings_by_repo_and_term(spark, sf, corpus, monkeypatch):
    q = spark.createDataFrame(asked(spark, sf), SCHEMA)
    want = sorted(map(tuple, R.text_rank(corpus[1], q).collect()))
    monkeypatch.setattr(R, "fits", lambda *a, **k: False)
    assert sorted(map(tuple, R.text_rank(corpus[1], q).collect())) == want and len(want) > 50


def test_many_scoped_questions_meet_blocks(spark, sf, corpus):
    q = spark.createDataFrame(asked(spark, sf), SCHEMA)
    want = sorted(map(tuple, R.nearest(corpus[2], q, 7).collect()))
    blocks = R._nearest_blocks(corpus[2].where("embedding is not null"), q, 7, q_rows=3, v_rows=40)
    assert sorted(map(tuple, R.ranked(blocks, [F.desc("similarity"), F.asc("id")], 7, "semantic_rank").collect())) == want


def test_wide_questions_are_dealt_into_blocks(spark, sf, corpus, monkeypatch):
    """The bound is on bytes: questions above it aren't sent to all tasks, whatever their number."""
    q = spark.createDataFrame(asked(spark, sf), SCHEMA)
    near, best = (sorted(map(tuple, f.collect())) for f in (R.nearest(corpus[2], q, 5), R.best_query(corpus[2], q)))
    monkeypatch.setattr(R, "MANY_BYTES", 100)
    assert R.local_queries(q.select("query_id", "vector")) is None
    assert sorted(map(tuple, R.nearest(corpus[2], q, 5).collect())) == near and sorted(map(tuple, R.best_query(corpus[2], q).collect())) == best


def test_postings_stored_by_repo(spark, sf, corpus, tmp_path):
    """Scoped words list the buckets of their (repo, term) only, and repos are part of the scan's filters."""
    q = spark.createDataFrame(asked(spark, sf), SCHEMA)
    want = sorted(map(tuple, R.text_rank(corpus[1], q).collect()))
    TB.write_terms(corpus[1], f"{tmp_path}/t", buckets=64, by_repo=True)
    assert sorted(map(tuple, R.text_rank(TB.read_terms(spark, f"{tmp_path}/t", R.query_stems(q)), q).collect())) == want
    one = spark.createDataFrame([(1, "the idiot and tion", None, ["src1"], None)], SCHEMA)
    got = TB.read_terms(spark, f"{tmp_path}/t", R.query_stems(one))
    assert sorted(map(tuple, R.text_rank(got, one).collect())) == sorted(map(tuple, R.text_rank(corpus[1], one).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(repo_id, [src1])" in plan or "EqualTo(repo_id,src1)" in plan
    assert got.select("bucket").distinct().count() <= R.query_stems(one).count() < 64


def test_scopes(spark):
    q = spark.createDataFrame([(1, "a", None, ["b", None, "a", "b"], []), (2, "a", None, [None], None)], SCHEMA)
    assert [(r.in_repos, r.in_languages) for r in R.scoped(q).orderBy("query_id").collect()] == [(["a", "b"], None), (None, None)]
    assert np.all([r.in_repos is None for r in R.scoped(q.select("query_id")).collect()])
