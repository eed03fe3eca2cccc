"""Hybrid retrieval for a set of questions over a corpus: term postings, nearest vectors, rank fusion, path priors.

Tables: chunks (id, repo_id, path, language, symbol, kind, start_line, content), terms (id, repo_id, language, term,
weight, tf), vectors (id, repo_id, language, embedding), queries (query_id, query, vector). A question's words and
vector are small; chunks stay where they are and each leg reads only its own table.

Each question may have a scope of its own: repo_id or repo_ids (an array), and languages (an array). None of them, null
or an array without values stands for all. Both legs keep to it before they rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..functions.paths import path_prior
from ..sources.tables import materialize, planned_bytes

CANDIDATES, RESULTS, RRF_K, KEYWORD_WEIGHT = 40, 10, 60, 0.6
#: Weight of a term in a name or path, and in a body.
WEIGHTS = {"A": 1.0, "D": 0.1}
#: Up to so many queries of so many bytes are sent to every task; more are joined by shuffle or dealt into blocks.
MANY_QUERIES, MANY_BYTES = 20_000, 64 << 20
#: Up to so many repos or languages go into a scan's filter.
MANY_VALUES = 1000


def fits(df: DataFrame, most: int = 100_000, kb: int = 1024, size: Column | None = None) -> bool:
    """Whether df may be broadcast: known to be small (files or local rows of at most so many KB), or counted and of few rows. size: bytes of a row that isn't a few numbers; their sum is bounded by MANY_BYTES."""
    if planned_bytes(df) <= kb << 10:
        return True
    if size is None:
        return df.limit(most + 1).count() <= most
    rows, total = df.limit(most + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return rows <= most and (total or 0) <= MANY_BYTES


def few(df: DataFrame, most: int = 100_000, kb: int = 1024, size: Column | None = None) -> DataFrame:
    """df, to be broadcast if it fits; else it is joined by shuffle."""
    return F.broadcast(df) if fits(df, most, kb, size) else df


def scoped(queries: DataFrame) -> DataFrame:
    """queries with in_repos and in_languages: sorted arrays of what each may find, null for all."""
    names = set(queries.columns)
    none = F.lit(None).cast("array<string>")
    one = F.when(F.col("repo_id").isNotNull(), F.array(F.col("repo_id").cast("string"))) if "repo_id" in names else none
    repos = F.col("repo_ids") if "repo_ids" in names else one
    some = lambda c: F.nullif(F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))), F.array().cast("array<string>"))
    return queries.withColumns({"in_repos": some(repos), "in_languages": some(F.col("languages") if "languages" in names else none)})


def _within(value: str, scope: str) -> Column:
    return F.col(scope).isNull() | F.array_contains(F.col(scope), F.col(value))


def postings(chunks: DataFrame, most_body: int | None = None) -> DataFrame:
    """(id, repo_id, language, term, weight, tf): stemmed words of path and symbol with weight A, of the content (all of it, or up to most_body characters of its words) with weight D; English stop words go."""
    body = T.split_identifiers(F.col("content"))
    if most_body is not None:
        body = F.split(T.searchable_text(F.col("path"), F.col("symbol"), F.col("content"), most_body)["body"], " ")
    words = chunks.select("id", "repo_id", "language", F.explode(F.concat(F.transform(T.head_words(F.col("path"), F.col("symbol")), lambda w: F.struct(w.alias("word"), F.lit("A").alias("weight"))), F.transform(body, lambda w: F.struct(w.alias("word"), F.lit("D").alias("weight"))))).alias("w"))
    words = words.where((F.col("w.word") != "") & ~F.col("w.word").isin(T.ENGLISH_WORDS))
    return words.groupBy("id", "repo_id", "language", T.stem(F.col("w.word")).alias("term"), F.col("w.weight").alias("weight")).agg(F.count("*").alias("tf"))


def query_stems(queries: DataFrame) -> DataFrame:
    """(query_id, term, in_repos, in_languages): what the keyword leg looks for, and where."""
    terms = scoped(queries).select("query_id", "in_repos", "in_languages", F.explode(T.query_terms(F.col("query"))).alias("t"))
    return terms.where(~F.col("t.word").isin(T.ENGLISH_WORDS)).select("query_id", F.col("t.stem").alias("term"), "in_repos", "in_languages")


def ranked(df: DataFrame, order: list[Column], n: int, name: str = "rnk") -> DataFrame:
    """The first n of each query, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(name) <= n)


def text_rank(terms: DataFrame, queries: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, id, rank) of every chunk in a query's scope that holds any term of it: the sum of weight times occurrences.

    A question's words are broadcast with its scope, so other repos' postings go where they are read. More words than that
    meet the postings by (repo, term), those of questions without repos by the term.
    """
    weight = F.try_element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("weight"))
    stems = query_stems(queries)
    if fits(stems, size=F.lit(64) + 32 * F.coalesce(F.size("in_repos"), F.lit(0))):
        hits = terms.join(F.broadcast(stems), "term").where(_within("repo_id", "in_repos"))
    else:
        own = stems.where("in_repos is not null").withColumn("repo_id", F.explode("in_repos"))
        hits = terms.join(own, ["repo_id", "term"]).unionByName(terms.join(stems.where("in_repos is null"), "term"))
    hits = hits.where(_within("language", "in_languages"))
    return hits.groupBy("query_id", "id").agg(F.round(F.sum(weight * F.col("tf")), 6).alias("rank"))


def keyword_leg(terms: DataFrame, queries: DataFrame, n: int = CANDIDATES) -> DataFrame:
    return ranked(text_rank(terms, queries), [F.desc("rank"), F.asc("id")], n, "keyword_rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; 0 if one of them has no length."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = add(F.zip_with(d(a), d(b), lambda x, y: x * y))
    norm = lambda x: F.sqrt(add(F.transform(d(x), lambda v: v * v)))
    both = F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(dot / both, F.lit(0.0)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of equally long arrays without nulls, straight from its buffers; a row without length stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def best_of(sim: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest of one query's similarities, ties by the smaller id."""
    if len(sim) > 4 * n:  # only what can be among them is sorted
        some = np.flatnonzero(sim >= np.partition(sim, len(sim) - n)[len(sim) - n])
        return some[np.lexsort((rows[some], -sim[some]))[:n]]
    return np.lexsort((rows, -sim))[:n]


def _nearest(v: np.ndarray, rows: np.ndarray, held: dict[str, np.ndarray], q: np.ndarray, ids: np.ndarray, scopes: list[tuple], n: int) -> Iterator[pa.RecordBatch]:
    """The n best rows of a block for each query of a block. Queries of one scope are multiplied with the rows in it; held: the rows' repo and language."""
    groups: dict[tuple, list[int]] = {}
    for k, scope in enumerate(scopes):
        groups.setdefault(scope, []).append(k)
    for scope, members in groups.items():
        ok = np.arange(len(rows))
        for column, wanted in zip(("repo_id", "language"), scope, strict=True):
            if wanted is not None:
                ok = ok[np.isin(held[column][ok], np.array(wanted, object))]
        if not len(ok):
            continue
        inside, names = (v, rows) if len(ok) == len(rows) else (v[ok], rows[ok])
        for start in range(0, len(members), 256):
            some = members[start : start + 256]
            sim, out = np.round(q[some] @ inside.T, 6), []
            for k, x in zip(some, sim, strict=True):
                best = best_of(x, names, n)
                out.append((np.full(len(best), ids[k]), names[best], x[best]))
            yield pa.record_batch([np.concatenate(x) for x in zip(*out, strict=True)], ["query_id", "id", "similarity"])


def _rows(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    text = lambda c: np.array(["" if x is None else x for x in batch.column(c).to_pylist()], object)
    return matrix(batch.column("embedding")), batch.column("id").to_numpy(), {c: text(c) for c in ("repo_id", "language") if c in batch.schema.names}


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Unit vectors, ids and scopes of queries."""
    scope = [[None if x is None else tuple(x) for x in table.column(c).to_pylist()] for c in ("in_repos", "in_languages")]
    return matrix(table.column("vector")), table.column("query_id").to_numpy().astype(np.int64), list(zip(*scope, strict=True))


def local_queries(own: DataFrame) -> pa.Table | None:
    """The rows of own (with a vector) if they are few and small enough to be sent to all tasks."""
    first = own.limit(1001).toArrow()
    if first.num_rows <= 1000:
        return first if first.nbytes <= MANY_BYTES else None
    most = min(MANY_QUERIES, MANY_BYTES * first.num_rows // max(first.nbytes, 1))
    got = own.limit(most + 1).toArrow()
    return got if got.num_rows <= most else None


NEAREST = "query_id long, id long, similarity double"


def nearest(vectors: DataFrame, queries: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """(query_id, id, similarity, semantic_rank): exact nearest chunks in each query's scope by cosine, similarities rounded to 6 digits, ties by id.

    Every task multiplies its vectors with the queries, block by block, and keeps n of each query, so only those are
    shuffled. Queries that are few and small come to the tasks from the driver, and if all of them name repos or
    languages, these reach the scan as a filter; more queries are dealt into blocks that meet the vectors' blocks by
    shuffle. A vector without length has similarity 0; null ones are no candidates.
    """
    own = scoped(queries).where("vector is not null").select("query_id", "vector", "in_repos", "in_languages")
    asked = local_queries(own)
    have = vectors.where("embedding is not null")
    if asked is None:
        local = _nearest_blocks(have, queries, n)
    else:
        q, ids, scopes = _asked(asked)
        for k, column in enumerate(("repo_id", "language")):
            if column in have.columns and scopes and all(s[k] is not None for s in scopes):
                wanted = sorted({x for s in scopes for x in s[k]})
                have = have.where(F.col(column).isin(wanted)) if len(wanted) <= MANY_VALUES else have

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield from _nearest(*_rows(batch), q, ids, scopes, n)

        local = have.select("id", *_scope_columns(have), "embedding").mapInArrow(near, NEAREST)
    return ranked(local, [F.desc("similarity"), F.asc("id")], n, "semantic_rank")


def _scope_columns(vectors: DataFrame) -> list[str]:
    return [c for c in ("repo_id", "language") if c in vectors.columns]


def _nearest_blocks(vectors: DataFrame, queries: DataFrame, n: int, q_rows: int = MANY_QUERIES, v_rows: int = 200_000) -> DataFrame:
    """A block matrix product: each block of queries meets each block of vectors in one task, and n of each query leave it."""
    queries = scoped(queries).where("vector is not null")
    nq, nv = (max(1, -(-df.count() // rows)) for df, rows in ((queries, q_rows), (vectors, v_rows)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    v = vectors.select(block("id", nv).alias("vb"), every(nq).alias("qb"), "id", *_scope_columns(vectors), "embedding")
    q = queries.select(every(nv).alias("vb"), block("query_id", nq).alias("qb"), "query_id", "vector", "in_repos", "in_languages")

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        return pa.Table.from_batches(_nearest(*_rows(a), *_asked(b), n), schema)

    return v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(near, NEAREST)


def best_query(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, query_id, similarity): of each vector the query that it answers best, every one compared, ties to the smaller query. Many queries meet the vectors in blocks."""
    own = queries.where("vector is not null").select("query_id", "vector")
    have = vectors.where("embedding is not null").select("id", "embedding")
    asked = local_queries(own)
    if asked is None:  # the same search with sides changed
        turned = _nearest_blocks(own.select(F.col("query_id").alias("id"), F.col("vector").alias("embedding")), have.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 1, q_rows=200_000, v_rows=MANY_QUERIES)
        best_ = ranked(turned, [F.desc("similarity"), F.asc("id")], 1, "rnk")
        return best_.select(F.col("query_id").alias("id"), F.col("id").alias("query_id"), "similarity")
    asked = asked.sort_by("query_id")
    q, ids = matrix(asked.column("vector")), asked.column("query_id").to_numpy().astype(np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                sim = np.round(matrix(batch.column("embedding")) @ q.T, 6)
                at = sim.argmax(axis=1)
                yield pa.record_batch([batch.column("id"), pa.array(ids[at]), pa.array(sim[np.arange(len(at)), at])], ["id", "query_id", "similarity"])

    return have.mapInArrow(best, "id long, query_id long, similarity double")


def rrf_fuse(semantic: DataFrame, keyword: DataFrame, k: int = RRF_K, weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """(query_id, id, semantic_rank, keyword_rank, score): reciprocal rank fusion; a missing side adds nothing."""
    both = semantic.select("query_id", "id", "semantic_rank").join(keyword.select("query_id", "id", "keyword_rank"), ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", F.round(part("semantic_rank") + F.lit(weight) * part("keyword_rank"), 6))


def apply_prior(fused: DataFrame, chunks: DataFrame, n: int = RESULTS) -> DataFrame:
    """The n best of each query after tests and prose are weighed down; (…, score, final_rank)."""
    where = chunks.select("id", "path", "language")
    named = where.join(few(fused), "id").withColumn("score", F.round(F.col("score") * path_prior(F.col("path"), F.col("language")), 6))
    return ranked(named, [F.desc("score"), F.asc("id")], n, "final_rank")


def hybrid_search(chunks: DataFrame, terms: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = RESULTS, languages: list[str] | None = None) -> DataFrame:
    """The n best chunks of each query: query_id, id, path, language, semantic_rank, keyword_rank, score, similarity, final_rank.

    Each query finds only what is in its scope: its repos and languages, or all (see `scoped`). A query without terms is
    answered by its vector alone, one without a vector by its terms; a chunk without a vector has similarity 0.
    languages: for all queries, only chunks in those; none or an empty list: all. The fused ids are written to the shared
    folder, so the legs run when this is called.
    """
    if languages:
        terms, vectors = terms.where(F.col("language").isin(languages)), vectors.where(F.col("language").isin(languages))
    # both are a few dozen rows a query and read several times below
    fused = materialize(rrf_fuse(nearest(vectors, queries), keyword_leg(terms, queries)))
    top = materialize(apply_prior(fused, chunks, n))
    with_vectors = vectors.select("id", "embedding").join(few(top.select("query_id", "id")), "id").join(few(queries.select("query_id", "vector"), size=F.size("vector") * 8), "query_id")
    similarity = with_vectors.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("similarity"))
    return top.join(similarity, ["query_id", "id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def containing(items: DataFrame, docs: DataFrame, run: int = 4) -> DataFrame:
    """(query_id, id): the documents (id, text) that hold an item's (query_id, text) whole text.

    Words inside an item, all but its first and last, stand in such a document as words too, so the first `run` of them
    bring both together; then the text itself decides. Items of fewer words are compared with every document.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    key = lambda ws, i: F.xxhash64(*(F.get(ws, i + k) for k in range(run)))
    items = items.where("text is not null").select("query_id", F.col("text").alias("item"), words(F.col("text")).alias("ws"))
    long = items.where(F.size("ws") >= run + 2).select("query_id", "item", key(F.col("ws"), 1).alias("key"))
    ws = docs.select("id", "text", words(F.col("text")).alias("ws"))
    keys = F.transform(F.when(F.size("ws") >= run, F.sequence(F.lit(0), F.size("ws") - run)).otherwise(F.array().cast("array<int>")), lambda i: key(F.col("ws"), i))
    met = ws.select("id", F.explode(F.array_distinct(keys)).alias("key")).join(few(long.select("key", "query_id")), "key").select("id", "query_id").distinct()
    found = docs.join(few(met), "id").join(few(long.drop("key"), size=F.octet_length("item")), "query_id").where(F.contains("text", "item")).select("query_id", "id")
    short = items.where(F.size("ws") < run + 2)
    if short.take(1):
        found = found.union(docs.join(few(short, size=F.octet_length("item")), F.contains("text", "item")).select("query_id", "id"))
    return found.distinct()


def validate_queries(requests: DataFrame, repos: DataFrame, most_chars: int = 300, most_languages: int = 20) -> DataFrame:
    """(query_id, repo_id, query, languages, problem, partial) of search requests (query_id, repo_id, query, languages).

    The text is trimmed and cut to 300 characters, languages to the first 20 that are not null. problem: 'empty' without
    text, 'not found' without its repo, 'no embeddings' if that has none yet, else null. partial: the repo isn't ready.
    """
    text = F.left(F.trim(F.coalesce("query", F.lit(""))), F.lit(most_chars))
    languages = F.slice(F.filter(F.coalesce("languages", F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, most_languages)
    known = repos.select(F.col("id").alias("repo_id"), "status", "embedded_chunks").dropDuplicates(["repo_id"])
    df = requests.select("query_id", "repo_id", text.alias("query"), languages.alias("languages")).join(known, "repo_id", "left")
    none = F.coalesce("embedded_chunks", F.lit(0)) == 0
    problem = F.when(F.col("query") == "", "empty").when(F.col("status").isNull(), "not found").when(none, "no embeddings")
    return df.select("query_id", "repo_id", "query", "languages", problem.alias("problem"), (F.col("status") != "ready").alias("partial"))


def hit_at_k(hits: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """One row: labelled queries, those with a labelled chunk in their first k, and the share."""
    found = hits.where(F.col("final_rank") <= k).join(labels, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    per = labels.select("query_id").distinct().join(found, "query_id", "left")
    return per.agg(F.count("*").alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"))


#: Turns (id, text) into (id, embedding): a model's pandas UDF or map over Arrow batches, or the default below.
Embedder = Callable[[DataFrame], DataFrame]


def embed(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(id, embedding) of chunks (id, path, symbol, kind, content): unit vectors of their embedding text. Vectors without length are left out."""
    if embedder is None:
        return hashed_embedding(chunks)
    text = T.embedding_text(F.col("path"), F.col("symbol"), F.col("kind"), F.col("content"))
    made = embedder(chunks.select("id", text.alias("text"))).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return made.where(norm > 0).select("id", F.transform("e", lambda x: x / norm).alias("embedding"))


def hashed_embedding(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """(id, embedding) without a model: each word adds +1 or -1 to a dimension, both taken from its MD5, then unit length. A text without words has none."""
    text = T.embedding_text(F.col("path"), F.col("symbol"), F.col("kind"), F.col("content"))
    words = chunks.select("id", F.explode(T.split_identifiers(text)).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    h = F.md5(F.col("w"))
    number = lambda a, b: F.conv(F.substring(h, a, b), 16, 10).cast("long")
    parts = words.groupBy("id", (number(1, 8) % dims).alias("dim")).agg(F.sum(F.when(number(9, 1) < 8, F.col("n")).otherwise(-F.col("n"))).cast("double").alias("v"))
    vec = parts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0)))
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x * x))
    return vec.where(norm > 0).select("id", F.transform(dense, lambda x: x / norm).alias("embedding"))


@F.arrow_udf(ArrayType(DoubleType()))
def _hashed_vector(words: pa.Array, dims: pa.Array) -> pa.Array:
    n, size = len(words), dims[0].as_py() if len(dims) else 1
    coded = words.flatten().dictionary_encode()
    digests = [hashlib.md5(w.encode()).digest() for w in coded.dictionary.to_pylist()]
    at = np.array([int.from_bytes(h[:4], "big") % size for h in digests], np.int64)
    sign = np.array([1.0 if h[4] < 128 else -1.0 for h in digests])
    codes, row = coded.indices.to_numpy(), np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    sums = np.bincount(row * size + at[codes], sign[codes], n * size).reshape(n, size)
    norm = np.sqrt((sums * sums).sum(1))
    some = norm > 0
    ends = np.concatenate([[0], np.cumsum(some * size)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((sums[some] / norm[some, None]).ravel()), mask=pa.array(~some))


def hashed_vector(words: Column, dims: int = 64) -> Column:
    """The vector that `hashed_embedding` has for a text of these words, row by row: no shuffle. Null without words, or where they cancel out."""
    return _hashed_vector(words, F.lit(dims))
