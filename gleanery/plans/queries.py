"""Registered queries of the retrieval engine and their DuckDB twins, by operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import paths as P
from ..functions import text as T
from ..operators import access as A
from ..operators import admission as AD
from ..operators import catalog as K
from ..operators import incremental as I
from ..operators import retrieval as R
from ..operators.explain import explain_hits
from ..sources.tables import materialize, read_repo_meta, read_terms, shared_dir, write_terms
from . import sqltext as S
from .views import AS_OF, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


def joined(c) -> F.Column:
    return F.array_join(c, " ")


def text(x: str) -> str:
    return f"array_to_string({x}, ' ')"


# ---- text analysis

_SYMBOL, _PATH = "symbol", "path"


@query(f"SELECT path, {text(S.split_identifiers('content'))} AS words FROM corpus_files")
def t1_split_identifiers(spark, d):
    return view(spark, d, "corpus_files").select("path", joined(T.split_identifiers(F.col("content"))).alias("words"))


@query(f"SELECT word, {S.stem('word')} AS stem, count(*) AS n FROM (SELECT unnest({S.split_identifiers('content')}) AS word FROM corpus_files) GROUP BY 1")
def t2_stem(spark, d):
    words = view(spark, d, "corpus_files").select(F.explode(T.split_identifiers(F.col("content"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", T.stem(F.col("word")))


@query(f"WITH {S.TERMS} SELECT query_id, string_agg(word || '/' || stem, ' ' ORDER BY pos) AS terms, string_agg(word, ' | ' ORDER BY pos) AS or_query FROM q_terms GROUP BY 1")
def t5_query_terms(spark, d):
    terms = T.query_terms(F.col("query"))
    df = view(spark, d, "search_queries").select("query_id", terms.alias("t")).where(F.size("t") > 0)
    return df.select("query_id", joined(F.transform("t", lambda t: F.concat(t["word"], F.lit("/"), t["stem"]))).alias("terms"), T.or_query(F.col("t")).alias("or_query"))


@query(f"SELECT id, {text(f'list_concat({S.split_identifiers(_SYMBOL)}, {S.split_identifiers(_PATH)})')} AS head, {text(S.split_identifiers('content'))} AS body FROM corpus_chunks")
def t7_searchable_text(spark, d):
    both = T.searchable_text(F.col("path"), F.col("symbol"), F.col("content"))
    return view(spark, d, "corpus_chunks").select("id", both["head"].alias("head"), both["body"].alias("body"))


@query(f"WITH {S.POSTINGS} SELECT * FROM terms")
def t8_postings(spark, d):
    return R.postings(view(spark, d, "corpus_chunks"))


@query(f"WITH {S.LEGS} SELECT query_id, id, rank FROM text_ranks")
def t10_text_rank(spark, d):
    return R.text_rank(R.postings(view(spark, d, "corpus_chunks")), view(spark, d, "search_queries"))


@query(f"WITH {S.LEGS} SELECT query_id, id, keyword_rank FROM keyword")
def w2_keyword_leg(spark, d):
    return R.keyword_leg(R.postings(view(spark, d, "corpus_chunks")), view(spark, d, "search_queries")).select("query_id", "id", "keyword_rank")


@query(f"SELECT id, concat(CASE WHEN coalesce(symbol, '') <> '' THEN concat(path, ' — ', kind, ' ', symbol, ' (', {text(S.split_identifiers('symbol'))}, ')') ELSE path END, chr(10), content) AS text FROM corpus_chunks")
def t11_embedding_text(spark, d):
    return view(spark, d, "corpus_chunks").select("id", T.embedding_text(F.col("path"), F.col("symbol"), F.col("kind"), F.col("content")).alias("text"))


_EMB = f"concat(CASE WHEN coalesce(symbol, '') <> '' THEN concat(path, ' — ', kind, ' ', symbol, ' (', {text(S.split_identifiers('symbol'))}, ')') ELSE path END, chr(10), content)"


@query(
    f"WITH w AS (SELECT id, unnest({S.split_identifiers(_EMB)}) AS w FROM corpus_chunks), n AS (SELECT id, w, count(*) AS n, md5(w) AS h FROM w GROUP BY 1, 2), "
    "p AS (SELECT id, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % 64 AS dim, sum(CASE WHEN CAST(concat('0x', substr(h, 9, 1)) AS BIGINT) < 8 THEN n ELSE -n END)::DOUBLE AS v FROM n GROUP BY 1, 2) "
    "SELECT id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS v FROM p QUALIFY sum(v * v) OVER (PARTITION BY id) > 0 AND v <> 0"
)
def t12_hashed_embedding(spark, d):
    e = R.hashed_embedding(view(spark, d, "corpus_chunks"))
    return e.select("id", F.posexplode("embedding").alias("dim", "v")).where("v != 0").select("id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


@query(f"SELECT id, query_id, similarity FROM (SELECT v.id, q.query_id, {S.SIMILARITY} AS similarity FROM chunk_vectors v, search_queries q WHERE q.vector IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, query_id) = 1")
def t13_cosine(spark, d):
    """Every vector scored against every query; the best one is reported."""
    return R.best_query(view(spark, d, "chunk_vectors"), view(spark, d, "search_queries"))


@query(f"WITH {S.LEGS} SELECT * FROM semantic")
def t14_nearest(spark, d):
    return R.nearest(view(spark, d, "chunk_vectors"), view(spark, d, "search_queries"))


@query(f"WITH s AS (SELECT q.query_id, v.id, {S.SIMILARITY} AS similarity FROM chunk_vectors v JOIN search_queries q ON v.repo_id = concat('src', q.query_id % 20) WHERE q.vector IS NOT NULL AND v.language IN ('Go', 'Markdown')) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS semantic_rank FROM s) WHERE semantic_rank <= 40")
def p8_p9_filtered_nearest(spark, d):
    q = view(spark, d, "search_queries").withColumn("repo_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return R.nearest(view(spark, d, "chunk_vectors").where(F.col("language").isin("Go", "Markdown")), q)


def _hits(spark, d, n=10):
    chunks = view(spark, d, "corpus_chunks")
    return R.hybrid_search(chunks, R.postings(chunks), view(spark, d, "chunk_vectors"), view(spark, d, "search_queries"), n)


@query(f"WITH {S.LEGS} SELECT query_id, id, semantic_rank, keyword_rank, score FROM fused")
def t17_rrf_fuse(spark, d):
    q = view(spark, d, "search_queries")
    return R.rrf_fuse(R.nearest(view(spark, d, "chunk_vectors"), q), R.keyword_leg(R.postings(view(spark, d, "corpus_chunks")), q))


@query(f"WITH {S.LEGS} SELECT h.query_id, h.id, h.path, h.language, h.semantic_rank, h.keyword_rank, h.score, h.final_rank, CASE WHEN q.vector IS NULL OR v.embedding IS NULL THEN 0 ELSE {S.SIMILARITY} END AS similarity FROM hits h JOIN search_queries q USING (query_id) LEFT JOIN chunk_vectors v ON v.id = h.id")
def t19_hybrid_search(spark, d):
    return _hits(spark, d)


@query(f"WITH {S.SCOPED_LEGS} SELECT h.query_id, h.id, c.repo_id, h.language, h.semantic_rank, h.keyword_rank, h.score, h.final_rank, CASE WHEN q.vector IS NULL OR v.embedding IS NULL THEN 0 ELSE {S.SIMILARITY} END AS similarity FROM hits h JOIN scoped_queries q USING (query_id) JOIN corpus_chunks c ON c.id = h.id LEFT JOIN chunk_vectors v ON v.id = h.id")
def p8_p9_t19_scoped_search(spark, d):
    """Hybrid search in which each question has its own repos and languages, one, several or all; both legs keep to them."""
    chunks = view(spark, d, "corpus_chunks")
    hits = R.hybrid_search(chunks, R.postings(chunks), view(spark, d, "chunk_vectors"), view(spark, d, "scoped_queries"))
    return hits.join(chunks.select("id", "repo_id"), "id").select("query_id", "id", "repo_id", "language", "semantic_rank", "keyword_rank", "score", "final_rank", "similarity")


@query(f"WITH {S.SCOPED_LEGS} SELECT query_id, id, rank FROM text_ranks")
def p9_s11_scoped_terms(spark, d):
    """Postings stored by repo and term; a question reads those of its own repos."""
    path, q = shared_dir(spark, "terms"), view(spark, d, "scoped_queries")
    write_terms(R.postings(view(spark, d, "corpus_chunks")), path, by_repo=True)
    return R.text_rank(read_terms(spark, path, R.query_stems(q)), q)


@query(f"WITH {S.LEGS} SELECT query_id, id, final_rank FROM hits WHERE final_rank <= 3")
def k8_top_three(spark, d):
    return _hits(spark, d).where("final_rank <= 3").select("query_id", "id", "final_rank")


@query(f"WITH {S.LEGS}, f AS (SELECT DISTINCT h.query_id FROM hits h JOIN search_labels l USING (query_id, id) WHERE h.final_rank <= 3) SELECT count(*) AS queries, count(f.query_id) AS hits, round(count(f.query_id) / count(*), 6) AS hit_rate FROM (SELECT DISTINCT query_id FROM search_labels) l LEFT JOIN f USING (query_id)")
def t24_hit_at_k(spark, d):
    return R.hit_at_k(_hits(spark, d), view(spark, d, "search_labels"))


_STEMMED = S.stem("tok")
_LINES = f"""h AS (SELECT h.query_id, h.id, h.semantic_rank, h.keyword_rank, c.path, c.symbol, c.kind, c.start_line, c.content FROM hits h JOIN corpus_chunks c USING (id)),
parts AS (SELECT query_id, id, 0 AS line, 0 AS src, path AS t FROM h UNION ALL SELECT query_id, id, 0, 1, symbol FROM h UNION ALL
SELECT query_id, id, generate_subscripts(string_split(content, chr(10)), 1), 2, unnest(string_split(content, chr(10))) FROM h),
toks AS (SELECT query_id, id, src, line, unnest({S.split_identifiers('t')}) AS tok, generate_subscripts({S.split_identifiers('t')}, 1) AS p FROM parts),
stemmed AS (SELECT *, {_STEMMED} AS s FROM toks),
met AS (SELECT k.query_id, k.id, k.src, k.line, k.p, t.word, t.pos FROM stemmed k JOIN q_terms t ON k.query_id = t.query_id AND (k.s = t.stem OR (length(t.stem) >= 4 AND starts_with(k.s, t.stem)) OR (length(k.s) >= 4 AND starts_with(t.stem, k.s)))),
firsts AS (SELECT query_id, id, word, min((src, line, p, pos)) AS f FROM met GROUP BY ALL),
matched AS (SELECT query_id, id, list(word ORDER BY f) AS words FROM firsts GROUP BY ALL),
per AS (SELECT DISTINCT query_id, id, line, word FROM met WHERE src = 2),
starts AS (SELECT DISTINCT query_id, id, line - o AS line FROM per, (SELECT unnest([0, 1, 2]) AS o) WHERE line - o >= 1),
sizes AS (SELECT s.query_id, s.id, s.line, count(DISTINCT p.word) AS n FROM starts s JOIN per p ON p.query_id = s.query_id AND p.id = s.id AND p.line BETWEEN s.line AND s.line + 2 GROUP BY ALL),
best AS (SELECT query_id, id, arg_max(line, (n, -line)) AS line FROM sizes GROUP BY ALL),
lit AS (SELECT b.query_id, b.id, list(DISTINCT h.start_line + p.line - 1 ORDER BY h.start_line + p.line - 1) AS ls FROM best b JOIN per p ON p.query_id = b.query_id AND p.id = b.id AND p.line BETWEEN b.line AND b.line + 2 JOIN h ON h.query_id = b.query_id AND h.id = b.id GROUP BY ALL),
e AS (SELECT h.*, coalesce(m.words, []) AS words, coalesce(l.ls, []) AS ls,
CASE WHEN coalesce(symbol, '') <> '' THEN concat(kind, ' ', string_split(symbol, ', ')[1]) WHEN kind = 'file' THEN 'this file' ELSE 'this block' END AS w,
list_transform(list_slice(coalesce(m.words, []), 1, 4), lambda x: concat('“', x, '”')) AS q FROM h LEFT JOIN matched m USING (query_id, id) LEFT JOIN lit l USING (query_id, id)),
e2 AS (SELECT *, CASE WHEN len(q) <= 1 THEN array_to_string(q, '') ELSE concat(array_to_string(list_slice(q, 1, len(q) - 1), ', '), ' and ', q[-1]) END AS quoted FROM e)"""
_REASON = """concat(CASE WHEN semantic_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN concat('Matched on meaning and keywords: ', w, ' is #', semantic_rank, ' by embedding similarity and shares ', CASE WHEN len(words) > 0 THEN quoted ELSE 'terms' END, ' with your question.')
WHEN semantic_rank IS NOT NULL AND len(words) > 0 THEN concat('Matched on meaning (#', semantic_rank, ' by embedding similarity); ', w, ' also mentions ', quoted, '.')
WHEN semantic_rank IS NOT NULL THEN concat('Matched on meaning only (#', semantic_rank, ' by embedding similarity): no shared keywords, but ', w, ' is close to your question in embedding space.')
ELSE concat('Keyword match (#', keyword_rank, ' by full-text rank) on ', CASE WHEN len(words) > 0 THEN quoted ELSE 'your terms' END, '; weaker semantic similarity.') END,
CASE WHEN len(ls) = 0 THEN '' WHEN ls[1] = ls[-1] THEN concat(' See line ', ls[1], '.') ELSE concat(' See lines ', ls[1], '–', ls[-1], '.') END)"""


@query(f"WITH {S.LEGS}, {_LINES} SELECT query_id, id, {text('words')} AS matched_terms, {text('ls')} AS highlight_lines, {_REASON} AS reason FROM e2")
def t23_explain_hits(spark, d):
    hits = materialize(_hits(spark, d).select("query_id", "id", "semantic_rank", "keyword_rank"))
    full = view(spark, d, "corpus_chunks").join(R.few(hits), "id")
    out = explain_hits(full, view(spark, d, "search_queries"))
    return out.select("query_id", "id", joined("matched_terms").alias("matched_terms"), joined(F.transform("highlight_lines", lambda x: x.cast("string"))).alias("highlight_lines"), "reason")


# ---- functions


@query("SELECT id, nullif(regexp_replace(o, '^$', ''), '') AS owner, n AS name FROM (SELECT id, CASE WHEN ok THEN o END AS o, CASE WHEN ok THEN n END AS n FROM (SELECT *, coalesce(regexp_full_match(o, '[A-Za-z0-9][A-Za-z0-9-]{0,38}') AND regexp_full_match(n, '[A-Za-z0-9._-]{1,100}') AND n NOT IN ('.', '..'), false) AS ok FROM (SELECT id, p[1] AS o, regexp_replace(p[2], '(?i)\\.git$', '') AS n FROM (SELECT id, list_filter(string_split(regexp_extract(regexp_replace(regexp_replace(trim(ref), '(?i)^git@github\\.com:', ''), '(?i)^(https?://)?(www\\.)?github\\.com/', ''), '^[^?#]*'), '/'), lambda x: x <> '') AS p FROM refs_v))))")
def f1_parse_repo_ref(spark, d):
    return view(spark, d, "refs_v").select("id", D.parse_repo_ref(F.col("ref")).alias("r")).select("id", "r.owner", "r.name")


@query("SELECT id, concat('https://github.com/o/n/blob/', CASE WHEN id % 4 = 0 THEN 'HEAD' ELSE sha1(path) END, '/', array_to_string(list_transform(string_split(concat(path, '/a b!(~)+é&'), '/'), lambda x: replace(replace(replace(replace(replace(url_encode(x), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')), '/'), CASE WHEN start_line <= 5 THEN concat('#L', start_line) ELSE concat('#L', start_line, '-L', start_line + 7) END) AS url FROM corpus_chunks")
def f2_blob_url(spark, d):
    end = F.when(F.col("start_line") <= 5, F.col("start_line")).otherwise(F.col("start_line") + 7)
    sha = F.when(F.col("id") % 4 != 0, F.sha1("path"))
    return view(spark, d, "corpus_chunks").select("id", D.blob_url(F.lit("o"), F.lit("n"), sha, F.concat("path", F.lit("/a b!(~)+é&")), F.col("start_line"), end).alias("url"))


@query("SELECT path, sha1(content) AS content_hash, sha256(content) AS sha, lower(concat(repo_id, '/', path)) AS slug, len(string_split(content, chr(10))) AS line_count, regexp_extract(path, '^(.*/)?', 0) AS dir_part, substr(path, length(regexp_extract(path, '^(.*/)?', 0)) + 1) AS file_part, length(regexp_replace(replace(content, chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g')) AS normal FROM corpus_files")
def f3_f9_file_functions(spark, d):
    c = F.col("content")
    return view(spark, d, "corpus_files").select("path", F.sha1(c.cast("binary")).alias("content_hash"), F.sha2(c.cast("binary"), 256).alias("sha"), D.slug(F.col("repo_id"), F.col("path")).alias("slug"), P.line_count(c).cast("long").alias("line_count"), P.dir_part(F.col("path")).alias("dir_part"), P.file_part(F.col("path")).alias("file_part"), F.char_length(D.normalize_newlines(F.replace(c, F.lit("\n"), F.lit("\r\n")))).cast("long").alias("normal"))


_R = "CAST(floor({} + 0.5) AS BIGINT)"


@query(
    "SELECT id, CASE WHEN n IS NULL THEN '' WHEN n >= 10000 THEN printf('%.0fk', floor(n / 1000 + 0.5)) WHEN n >= 1000 THEN printf('%.1fk', floor(n / 100 + 0.5) / 10) ELSE CAST(n AS VARCHAR) END AS compact, format('{:,}', n) AS thousands, "
    "round(greatest(0.06, least(1.0, (id % 100 / 100.0 - 0.7) / 0.22)), 6) AS strength, round(CASE WHEN status = 'indexing' AND total_chunks <> 0 THEN least(100.0, embedded_chunks / total_chunks * 100) WHEN status = 'fetching' THEN 6 WHEN status = 'ready' THEN 100 ELSE 1 END, 6) AS pct, "
    f"coalesce({_R.format('embedded_chunks / nullif(total_chunks, 0) * 100')}, 0) AS share FROM (SELECT *, CASE WHEN id % 10 > 0 THEN stars * 13 END AS n FROM repos_v)"
)
def f10_f14_numbers(spark, d):
    n = F.when(F.col("id") % 10 > 0, F.col("stars") * 13)
    sim = F.col("id") % 100 / 100.0
    return view(spark, d, "repos_v").select("id", D.compact(n).alias("compact"), D.thousands(n).alias("thousands"), F.round(D.strength(sim), 6).alias("strength"), F.round(D.progress_pct(F.col("status"), F.col("embedded_chunks"), F.col("total_chunks")), 6).alias("pct"), D.share_pct(F.col("embedded_chunks"), F.col("total_chunks")).alias("share"))


@query(f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN m < 60 THEN concat(m, ' min ago') WHEN h < 24 THEN concat(h, ' h ago') WHEN dd < 30 THEN concat(dd, ' d ago') ELSE strftime(ts, '%b %-d, %Y') END AS ago FROM (SELECT *, {_R.format('h / 24')} AS dd FROM (SELECT *, {_R.format('m / 60')} AS h FROM (SELECT *, {_R.format('s / 60')} AS m FROM (SELECT event_id, ts, greatest(1, epoch(TIMESTAMP '2024-02-02 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT) AS s FROM search_log))))")
def f12_time_ago(spark, d):
    return view(spark, d, "search_log").select("event_id", D.time_ago(F.col("ts"), F.lit("2024-02-02 00:00:00").cast("timestamp")).alias("ago"))


@query("SELECT id, concat('[', array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ','), ']') AS v FROM chunk_vectors")
def f15_vector_literal(spark, d):
    return view(spark, d, "chunk_vectors").select("id", D.vector_literal(F.col("embedding")).alias("v"))


@query("SELECT id, regexp_replace(coalesce(nullif(trim(CASE WHEN id % 2 = 0 THEN '  ' END), ''), nullif(trim(symbol), ''), nullif(trim(left(content, 90)), '')), '\\s+', ' ', 'g') AS answer, concat('Question: ', CASE WHEN id % 7 = 0 THEN '(none)' ELSE 'why' END, chr(10), 'File: ', path, CASE WHEN symbol IS NOT NULL THEN concat(' — ', symbol) ELSE '' END, ' (', language, ')', chr(10), chr(10), left(content, 4000)) AS prompt FROM corpus_chunks")
def f18_f19_answers(spark, d):
    c = view(spark, d, "corpus_chunks")
    answer = D.first_non_empty(F.when(F.col("id") % 2 == 0, "  "), F.col("symbol"), F.left("content", F.lit(90)))
    prompt = D.explain_prompt(F.when(F.col("id") % 7 != 0, "why"), F.col("path"), F.col("symbol"), F.col("language"), F.col("content"))
    return c.select("id", answer.alias("answer"), prompt.alias("prompt"))


@query("SELECT id, array_to_string(list_slice(l, b + 1, b + 5), chr(10)) AS preview FROM (SELECT id, l, greatest(0, least(id % 9 - 1, len(l) - 5)) AS b FROM (SELECT id, string_split(content, chr(10)) AS l FROM corpus_chunks))")
def f22_preview(spark, d):
    return view(spark, d, "corpus_chunks").select("id", D.preview(F.col("content"), F.col("start_line"), (F.col("start_line") + F.col("id") % 9).cast("int")).alias("preview"))


# ---- admission


@query(f"SELECT path, {S.PATH_REASON} AS reason, {S.LANGUAGE} AS language, {S.GRAMMAR} AS grammar FROM corpus_files")
def p1_p4_paths(spark, d):
    info = P.detect_language(F.col("path"))
    return view(spark, d, "corpus_files").select("path", P.skip_reason_path(F.col("path")).alias("reason"), info["language"].alias("language"), info["grammar"].alias("grammar"))


@query(f"SELECT path, {S.CONTENT_REASON} AS reason, {S.LONGEST} AS longest, {S.LINES} AS lines FROM corpus_files")
def p5_content(spark, d):
    c = F.col("content")
    return view(spark, d, "corpus_files").select("path", P.skip_reason_content(c).alias("reason"), P.longest_line(c).cast("long").alias("longest"), P.line_count(c).cast("long").alias("lines"))


@query(f"SELECT repo_id, coalesce({S.REASON}, 'kept') AS reason, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM corpus_files GROUP BY 1, 2")
def p7_admission(spark, d):
    return AD.admission_report(AD.admit_files(view(spark, d, "corpus_files")))


@query("WITH c AS (SELECT repo_id, path, row_number() OVER w AS rn, coalesce(sum(n) OVER (PARTITION BY repo_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT repo_id, path, length(content) // 500 AS n FROM corpus_files) WINDOW w AS (PARTITION BY repo_id ORDER BY path)), k AS (SELECT *, rn <= 30 AND before < 120 AS ok FROM c) SELECT repo_id, path, NOT bool_and(ok) OVER (PARTITION BY repo_id) AS truncated FROM k QUALIFY ok")
def w7_caps(spark, d):
    files = view(spark, d, "corpus_files").withColumn("n_chunks", F.floor(F.char_length("content") / 500))
    return AD.apply_caps(files, most_files=30, most_chunks=120).select("repo_id", "path", "truncated")


@query(f"SELECT id, round({S.prior('path', 'language')}, 6) AS prior FROM corpus_chunks")
def p12_path_prior(spark, d):
    return view(spark, d, "corpus_chunks").select("id", P.path_prior(F.col("path"), F.col("language")).alias("prior"))


@query("SELECT query_id, repo_id, query, len(languages) AS languages, CASE WHEN query = '' THEN 'empty' WHEN status IS NULL THEN 'not found' WHEN embedded_chunks = 0 THEN 'no embeddings' END AS problem, status <> 'ready' AS partial FROM (SELECT item_id AS query_id, item_id * 10 AS repo_id, substr(trim(CASE WHEN item_id % 7 = 3 THEN '   ' ELSE concat('  ', text) END), 1, 300) AS query, list_slice(list_filter(list_transform(generate_series(1, 1 + item_id % 30), lambda i: CASE WHEN i % 9 > 0 THEN 'Go' END), lambda x: x IS NOT NULL), 1, 20) AS languages FROM benchmark) q LEFT JOIN repos_v r ON r.id = q.repo_id")
def p17_valid_queries(spark, d):
    item = F.col("item_id")
    languages = F.transform(F.sequence(F.lit(1), (1 + item % 30).cast("int")), lambda i: F.when(i % 9 > 0, "Go"))
    requests = spark.read.parquet(f"{d}/benchmark.parquet").select(item.alias("query_id"), (item * 10).alias("repo_id"), F.when(item % 7 == 3, "   ").otherwise(F.concat(F.lit("  "), F.col("text"))).alias("query"), languages.alias("languages"))
    out = R.validate_queries(requests, view(spark, d, "repos_v"))
    return out.withColumn("languages", F.size("languages").cast("long"))


@query("SELECT id, regexp_full_match(id, '[0-9a-f-]{36}') AS uuid_like, regexp_full_match(CAST(user_id AS VARCHAR), '\\d+') AS digits FROM sessions_v")
def p23_id_shapes(spark, d):
    uuid_like, digits = K.id_shapes(F.col("id"), F.col("user_id").cast("string"))
    return view(spark, d, "sessions_v").select("id", uuid_like.alias("uuid_like"), digits.alias("digits"))


# ---- incremental indexing


_DIFF = "diff AS (SELECT repo_id, path, CASE WHEN o.content_hash IS NULL THEN 'added' WHEN n.content_hash IS NULL THEN 'removed' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM snapshot_old o FULL OUTER JOIN snapshot_new n USING (repo_id, path))"


def _diff(spark, d):
    return I.diff_snapshot(view(spark, d, "snapshot_old"), view(spark, d, "snapshot_new"))


@query(f"WITH {_DIFF} SELECT * FROM diff")
def j5_diff_snapshot(spark, d):
    return _diff(spark, d)


@query(f"WITH {_DIFF} SELECT repo_id, path FROM diff WHERE change IN ('changed', 'removed')")
def j6_stale_paths(spark, d):
    return I.stale_paths(_diff(spark, d))


@query("SELECT repo_id, path, content_hash FROM snapshot_new")
def i3_apply_diff(spark, d):
    return I.apply_diff(view(spark, d, "snapshot_old"), _diff(spark, d), view(spark, d, "snapshot_new"))


@query(f"WITH {_DIFF} SELECT repo_id, count(*) FILTER (change IN ('added', 'changed')) AS changed, count(*) FILTER (change = 'removed') AS removed, printf('%d changed, %d removed.', count(*) FILTER (change IN ('added', 'changed')), count(*) FILTER (change = 'removed')) AS note FROM diff GROUP BY 1")
def a10_change_summary(spark, d):
    return I.change_summary(_diff(spark, d))


@query(f"SELECT * FROM chunks_v WHERE NOT embedded AND (claimed_at IS NULL OR claimed_at < {NOW} - INTERVAL 120 SECOND) ORDER BY id LIMIT 12")
def i4_pending_chunks(spark, d):
    return I.pending_chunks(view(spark, d, "chunks_v"), AS_OF)


_COUNTS = "counts AS (SELECT repo_id, coalesce(f.files, 0) AS files, coalesce(c.chunks, 0) AS chunks, coalesce(c.embedded, 0) AS embedded FROM (SELECT repo_id, count(*) AS files FROM files_v GROUP BY 1) f FULL OUTER JOIN (SELECT repo_id, count(*) AS chunks, count(*) FILTER (embedded) AS embedded FROM chunks_v GROUP BY 1) c USING (repo_id))"


def _counts(spark, d):
    return K.repo_counts(view(spark, d, "files_v"), view(spark, d, "chunks_v"))


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def a2_repo_counts(spark, d):
    return _counts(spark, d)


_STATUS = "CASE WHEN chunks = 0 THEN 'error' WHEN embedded < chunks THEN 'indexing' ELSE 'ready' END AS status, CASE WHEN chunks = 0 THEN 'Nothing to index' WHEN embedded < chunks THEN 'Generating embeddings' ELSE 'Index is up to date' END AS message"


@query(f"WITH {_COUNTS} SELECT *, {_STATUS} FROM counts")
def i5_index_status(spark, d):
    return I.index_status(_counts(spark, d))


@query(f"WITH {_COUNTS}, {_DIFF}, s AS (SELECT *, {_STATUS} FROM counts), n AS (SELECT repo_id, printf('%d changed, %d removed. ', count(*) FILTER (change IN ('added', 'changed')), count(*) FILTER (change = 'removed')) AS note FROM diff GROUP BY 1) SELECT s.repo_id, trim(concat(CASE WHEN files >= 15 THEN concat('Large repo: indexed the first ', format('{{:,}}', files), ' files. ') ELSE '' END, coalesce(note, ''), message)) AS message FROM s LEFT JOIN n USING (repo_id)")
def f20_status_message(spark, d):
    return I.status_message(_counts(spark, d), I.change_summary(_diff(spark, d)), most_files=15)


@query("SELECT id, owner, name FROM repos_v WHERE commit_sha IS NOT NULL AND total_chunks > 0 AND embedded_chunks >= total_chunks AND id % 2 = 0")
def i1_up_to_date(spark, d):
    repos = view(spark, d, "repos_v")
    archives = repos.select("id", F.when(F.col("id") % 2 == 0, F.col("commit_sha")).otherwise("other").alias("commit_sha"))
    return I.up_to_date(repos, archives).select("id", "owner", "name")


@query("SELECT id, status FROM (SELECT id, CASE WHEN id % 50 = 0 THEN 'paused' WHEN id % 70 = 0 THEN NULL ELSE status END AS status FROM repos_v) WHERE status IS NULL OR status NOT IN ('queued', 'fetching', 'indexing', 'ready', 'error')")
def i6_status_violations(spark, d):
    status = F.when(F.col("id") % 50 == 0, "paused").when(F.col("id") % 70 != 0, F.col("status"))
    return K.status_violations(view(spark, d, "repos_v").withColumn("status", status)).select("id", "status")


@query(f"SELECT id FROM repos_v WHERE status = 'fetching' AND updated_at < {NOW} - INTERVAL 6 MINUTE")
def i7_stale_runs(spark, d):
    return K.stale_runs(view(spark, d, "repos_v"), AS_OF).select("id")


_ACTIVE = f"(status IN ('fetching', 'indexing') AND updated_at > {NOW} - INTERVAL 10 MINUTE)"


@query(f"WITH s AS (SELECT *, (SELECT count(*) FILTER ({_ACTIVE}) FROM repos_v) - CASE WHEN {_ACTIVE} THEN 1 ELSE 0 END AS others FROM repos_v) SELECT id, others FROM s WHERE (status = 'queued' OR (status = 'fetching' AND updated_at < {NOW} - INTERVAL 6 MINUTE)) AND others < 100000")
def i8_eligible_repos(spark, d):
    return K.eligible_repos(view(spark, d, "repos_v"), AS_OF, most=100000).select("id", "others")


# ---- catalog


_PUBLIC = "NOT is_private AND status <> 'error'"


@query(f"SELECT id, status FROM repos_v WHERE {_PUBLIC} ORDER BY status = 'ready' DESC, coalesce(indexed_at, updated_at) DESC, id LIMIT 12")
def k4_recent_repos(spark, d):
    return K.recent_repos(view(spark, d, "repos_v")).select("id", "status")


@query("SELECT id, status FROM repos_v WHERE NOT is_private AND (status <> 'error' OR indexed_at IS NOT NULL) ORDER BY coalesce(indexed_at, updated_at) DESC, id LIMIT 200")
def k5_all_repos(spark, d):
    return K.all_repos(view(spark, d, "repos_v")).select("id", "status")


@query("SELECT mode, id, n AS position FROM (SELECT 'recent' AS mode, id, row_number() OVER (ORDER BY coalesce(indexed_at, updated_at) DESC, id) AS n FROM repos_v UNION ALL SELECT 'searched', id, row_number() OVER (ORDER BY search_count DESC, id) FROM repos_v UNION ALL SELECT 'largest', id, row_number() OVER (ORDER BY total_chunks DESC, id) FROM repos_v UNION ALL SELECT 'stars', id, row_number() OVER (ORDER BY coalesce(stars, 0) DESC, id) FROM repos_v)")
def k6_sort_modes(spark, d):
    repos, out = view(spark, d, "repos_v"), None
    for mode in ("recent", "searched", "largest", "stars"):
        part = K.positions(K.sort_repos(repos, mode)).select(F.lit(mode).alias("mode"), "id", "position")
        out = part if out is None else out.union(part)
    return out


@query("SELECT id FROM repos_v ORDER BY updated_at DESC, id LIMIT 120")
def k9_page(spark, d):
    return K.page(view(spark, d, "repos_v"), [F.desc("updated_at"), F.asc("id")], 60, 2).select("id")


@query("SELECT count(*) FILTER (status = 'ready') AS ready, coalesce(sum(total_chunks), 0)::BIGINT AS chunks, coalesce(sum(search_count), 0)::BIGINT AS searches, coalesce(sum(total_files), 0)::BIGINT AS files FROM repos_v WHERE NOT is_private")
def a1_site_stats(spark, d):
    return K.site_stats(view(spark, d, "repos_v"))


@query("SELECT repo_id, language, n FROM (" + S.HISTOGRAM + ")")
def a3_language_histogram(spark, d):
    return K.language_histogram(view(spark, d, "files_v")).select("repo_id", F.explode("languages").alias("language", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"WITH h AS ({S.HISTOGRAM}), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) AS pos, sum(n) OVER (PARTITION BY repo_id) AS total FROM h) SELECT repo_id, pos - 1 AS pos, language, n AS files, round(n / total, 6) AS share FROM r WHERE pos <= 5")
def a11_language_share(spark, d):
    out = K.language_share(K.language_histogram(view(spark, d, "files_v")))
    return out.withColumns({"pos": F.col("pos").cast("long"), "files": F.col("files").cast("long")})


_TOP = f"t AS (SELECT repo_id, language FROM ({S.HISTOGRAM}) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) = 1)"


@query(f"WITH {_TOP} SELECT language, count(*) AS repos FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def a4_language_facets(spark, d):
    return K.language_facets(K.language_histogram(view(spark, d, "files_v")))


@query(f"WITH {_TOP} SELECT repo_id FROM t WHERE language = '1-URGENT'")
def p16_top_language_filter(spark, d):
    return K.top_language_filter(K.language_histogram(view(spark, d, "files_v")), "1-URGENT").select("repo_id")


@query("SELECT count(*) AS all_, count(*) FILTER (is_private) AS private, count(*) FILTER (NOT is_private) AS public, count(*) FILTER (indexed_at IS NOT NULL) AS indexed FROM repos_v")
def a5_tab_counts(spark, d):
    return K.tab_counts(view(spark, d, "repos_v"))


@query("SELECT count(*) AS repos FROM repos_v")
def a7_count_repos(spark, d):
    return view(spark, d, "repos_v").agg(F.count("*").alias("repos"))


@query("SELECT repo_id, count(*) AS search_count, max(ts) AS last_searched_at FROM search_log GROUP BY 1")
def a12_search_counters(spark, d):
    return K.search_counters(view(spark, d, "search_log"))


@query("SELECT id FROM repos_v WHERE contains(lower(concat(owner, '/', name, ' ', coalesce(description, ''))), 'furniture/customer')")
def p14_text_filter(spark, d):
    return K.text_filter(view(spark, d, "repos_v"), "  Furniture/Customer ").select("id")


@query("SELECT 'private' AS tab, id FROM repos_v WHERE is_private UNION ALL SELECT 'public', id FROM repos_v WHERE NOT is_private UNION ALL SELECT 'indexed', id FROM repos_v WHERE indexed_at IS NOT NULL")
def p15_tab_filter(spark, d):
    repos, out = view(spark, d, "repos_v"), None
    for tab in ("private", "public", "indexed"):
        part = K.tab_filter(repos, tab).select(F.lit(tab).alias("tab"), "id")
        out = part if out is None else out.union(part)
    return out


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(f"SELECT id, owner, name, description, stars, status, status_message AS \"statusMessage\", commit_sha AS \"commitSha\", total_files AS \"totalFiles\", skipped_files AS \"skippedFiles\", total_chunks AS \"totalChunks\", embedded_chunks AS \"embeddedChunks\", search_count AS \"searchCount\", is_private AS \"isPrivate\", {_ISO.format('indexed_at')} AS \"indexedAt\", {_ISO.format('updated_at')} AS \"updatedAt\" FROM repos_v")
def p19_public_repo(spark, d):
    return K.public_repo(view(spark, d, "repos_v"))


@query("SELECT id FROM repos_v WHERE concat(owner, '/', name) IN (SELECT concat(owner, '/', name) FROM repos_v WHERE id % 17 = 0)")
def j9_repos_by_slug(spark, d):
    repos = view(spark, d, "repos_v")
    return K.repos_by_slug(repos, repos.where("id % 17 = 0").select(F.upper(D.slug(F.col("owner"), F.col("name"))).alias("slug"))).select("id")


@query(f"SELECT id, CASE WHEN go THEN 'queued' ELSE status END AS status, CASE WHEN go THEN 'Checking GitHub for changes' ELSE status_message END AS status_message, CASE WHEN go THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *, id % 4 = 1 AND status IN ('ready', 'error') AS go FROM repos_v)")
def p18_requeue(spark, d):
    repos = view(spark, d, "repos_v")
    return K.requeue(repos, repos.where("id % 4 = 1").select("id"), AS_OF).select("id", "status", "status_message", "updated_at")


_IN = "inc AS (SELECT concat(owner, '/', name) AS slug, id % 2 = 0 AS p FROM repos_v WHERE id % 3 = 0 UNION ALL SELECT concat('new/r', id), id % 2 = 0 FROM repos_v WHERE id % 10 = 0)"


@query(f"WITH {_IN} SELECT CASE WHEN r.id IS NOT NULL THEN concat(r.owner, '/', r.name) ELSE i.slug END AS slug, CASE WHEN r.id IS NULL OR (i.slug IS NOT NULL AND r.status = 'error') THEN 'queued' ELSE r.status END AS status, CASE WHEN r.id IS NULL OR (i.slug IS NOT NULL AND r.status = 'error') THEN NULL ELSE r.status_message END AS status_message, coalesce(r.is_private, false) OR coalesce(i.p, false) AS is_private, CASE WHEN r.id IS NULL OR (i.slug IS NOT NULL AND r.status = 'error') THEN {NOW} ELSE r.updated_at END AS updated_at FROM repos_v r FULL OUTER JOIN inc i ON concat(r.owner, '/', r.name) = i.slug")
def s13_upsert_repos(spark, d):
    repos = view(spark, d, "repos_v")
    new = repos.where("id % 10 = 0").select(F.lit("New").alias("owner"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("name"), (F.col("id") % 2 == 0).alias("is_private"))
    incoming = repos.where("id % 3 = 0").select("owner", "name", (F.col("id") % 2 == 0).alias("is_private")).union(new)
    return K.upsert_repos(repos, incoming, AS_OF)


@query("SELECT id, is_private AND id % 14 <> 0 AS is_private FROM repos_v")
def s16_mark_public(spark, d):
    repos = view(spark, d, "repos_v")
    return K.mark_public(repos, repos.where("id % 14 = 0").select("id")).select("id", "is_private")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN concat('meta ', id) ELSE description END AS description, CASE WHEN id % 2 = 0 THEN coalesce(CASE WHEN id % 6 > 0 THEN id END, stars) ELSE stars END AS stars, CASE WHEN id % 2 = 0 THEN 'Go' END AS primary_language FROM repos_v")
def s6_j13_enrich_repos(spark, d):
    """Metadata comes as lines of JSON, as a code host's answers would be stored."""
    repos, path = view(spark, d, "repos_v"), shared_dir(spark, "meta")
    repos.where("id % 2 = 0").select("id", F.concat(F.lit("meta "), F.col("id").cast("string")).alias("description"), F.when(F.col("id") % 6 > 0, F.col("id")).alias("stars"), F.lit("Go").alias("language")).write.json(path)
    return K.enrich_repos(repos, read_repo_meta(spark, path)).select("id", "description", "stars", "primary_language")


@query("SELECT repo_id, ts, event_id, done, CASE WHEN n >= 3 AND r > 0 THEN round(r, 6) END AS per_second FROM (SELECT *, (done - first(done) OVER w) / nullif(floor(epoch(ts)) - floor(epoch(first(ts) OVER w)), 0) AS r, count(*) OVER w AS n FROM progress_v WINDOW w AS (PARTITION BY repo_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))")
def w9_progress_rate(spark, d):
    return K.progress_rate(view(spark, d, "progress_v"))


@query("SELECT id, CASE WHEN embedded_chunks = 0 OR total_chunks <= embedded_chunks THEN 'measuring speed…' WHEN s < 60 THEN concat('about ', greatest(5, CAST(floor(s / 5 + 0.5) AS BIGINT) * 5), ' s left') ELSE concat('about ', CAST(floor(s / 60 + 0.5) AS BIGINT), ' min left') END AS eta FROM (SELECT *, floor((total_chunks - embedded_chunks) / nullif(embedded_chunks / 50.0, 0) + 0.5) AS s FROM repos_v)")
def w9_eta_text(spark, d):
    """As if a repo's chunks had been embedded within the last 50 seconds."""
    rate = F.nullif(F.col("embedded_chunks") / 50.0, F.lit(0.0))
    return view(spark, d, "repos_v").select("id", D.eta_text(rate, F.col("total_chunks") - F.col("embedded_chunks")).alias("eta"))


@query("SELECT repo_id, event_id, max(done) OVER (PARTITION BY repo_id ORDER BY ts, event_id) AS shown FROM progress_v")
def w11_monotone_progress(spark, d):
    return K.monotone_progress(view(spark, d, "progress_v")).select("repo_id", "event_id", "shown")


@query("WITH l AS (SELECT * FROM opens QUALIFY row_number() OVER (PARTITION BY user_id, lower(slug) ORDER BY ts DESC, event_id DESC) = 1) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM l QUALIFY pos <= 12")
def w12_recent_opens(spark, d):
    return K.recent_opens(view(spark, d, "opens")).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT * FROM (SELECT id, owner, name, is_private, pushed FROM (SELECT c_custkey // 2 AS id, lower(c_mktsegment) AS owner, c_name AS name, c_custkey % 3 = 0 AS is_private, CASE WHEN c_custkey % 4 > 0 THEN strftime(TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 90) DAY, '%Y-%m-%d') END AS pushed, c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c_custkey) = 1)")
def s7_granted_repos(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    pushed = F.when(F.col("c_custkey") % 4 > 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 90).cast("int")), "yyyy-MM-dd"))
    repo = F.struct(F.floor(F.col("c_custkey") / 2).alias("id"), F.struct(F.lower("c_mktsegment").alias("login")).alias("owner"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3 == 0).alias("private"), pushed.alias("pushed_at"))
    pages = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("pos")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", repo.alias("r")))).alias("rs")).select("pos", F.transform("rs", lambda x: x["r"]).alias("repositories"))
    return K.granted_repos(pages).select("id", "owner", "name", "is_private", F.col("pushed_at").alias("pushed"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE s_name END AS account, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 THEN 'User' ELSE 'Organization' END AS account_type FROM supplier")
def s8_installations(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    account = F.when(F.col("s_suppkey") % 3 != 0, F.struct(F.col("s_name").alias("login"), F.when(F.col("s_suppkey") % 2 != 0, "Organization").alias("type")))
    return K.installations(s.groupBy(F.col("s_nationkey")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), account.alias("account"))).alias("installations")))


@query("SELECT g.id, g.slug, r.id AS index_id, r.status AS index_status FROM (SELECT id, CASE WHEN id % 2 = 0 THEN concat(owner, '/', name) ELSE concat(owner, '/x', id) END AS slug FROM repos_v WHERE id % 3 = 0) g LEFT JOIN repos_v r ON g.slug = concat(r.owner, '/', r.name)")
def j8_my_repos(spark, d):
    repos = view(spark, d, "repos_v")
    granted = repos.where("id % 3 = 0").select("id", F.upper("owner").alias("owner"), F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.concat(F.lit("X"), F.col("id").cast("string"))).alias("name"))
    return K.my_repos(granted, repos).select("id", "slug", "index_id", "index_status")


# ---- access


@query(f"SELECT s.id AS session_id, s.user_id, u.login, u.name FROM sessions_v s JOIN users_v u ON s.user_id = u.id WHERE s.expires_at > {NOW}")
def j10_viewers(spark, d):
    return A.viewers(view(spark, d, "sessions_v"), view(spark, d, "users_v"), AS_OF)


@query(f"SELECT id, user_id, expires_at FROM sessions_v WHERE expires_at >= {NOW}")
def s17_purge_sessions(spark, d):
    return A.purge_sessions(view(spark, d, "sessions_v"), AS_OF).select("id", "user_id", "expires_at")


_ACCESS = "acc AS (SELECT repo_id, user_id, max(verified_at) AS verified_at FROM repo_access_v GROUP BY 1, 2), both_ AS (SELECT repo_id, user_id, a.verified_at, w.answer FROM acc a FULL OUTER JOIN answers_v w USING (repo_id, user_id))"


@query(f"WITH {_ACCESS} SELECT repo_id, user_id FROM both_ WHERE repo_id IN (SELECT id FROM repos_v WHERE is_private AND id % 14 <> 0) AND (coalesce(verified_at > {NOW} - INTERVAL 1 HOUR, false) OR coalesce(answer, '') = 'yes' OR (coalesce(answer, 'unknown') = 'unknown' AND verified_at IS NOT NULL)) UNION ALL SELECT id, NULL FROM repos_v WHERE NOT is_private OR id % 14 = 0")
def j11_visible_repos(spark, d):
    """Repos whose id 14 divides are reported public by now."""
    repos = view(spark, d, "repos_v")
    return A.visible_repos(repos, view(spark, d, "repo_access_v"), view(spark, d, "answers_v"), AS_OF, repos.where("id % 14 = 0"))


def _visible(spark, d):
    return A.visible_repos(view(spark, d, "repos_v"), view(spark, d, "repo_access_v"), view(spark, d, "answers_v"), AS_OF)


_SEEN = f"{_ACCESS}, seen AS (SELECT repo_id, user_id FROM both_ WHERE repo_id IN (SELECT id FROM repos_v WHERE is_private) AND (coalesce(verified_at > {NOW} - INTERVAL 1 HOUR, false) OR coalesce(answer, '') = 'yes' OR (coalesce(answer, 'unknown') = 'unknown' AND verified_at IS NOT NULL)))"


@query(f"WITH {_SEEN}, asked AS (SELECT CASE WHEN event_id % 10 = 0 THEN concat('x', event_id) ELSE CAST(event_id AS VARCHAR) END AS chunk_id, event_id AS id, event_id % 40 AS user_id FROM events) SELECT a.chunk_id, a.user_id, c.repo_id, c.path, c.content_hash FROM asked a JOIN (SELECT id, repo_id, path, content_hash FROM files_v) c ON c.id = a.id AND a.chunk_id = CAST(a.id AS VARCHAR) JOIN repos_v r ON r.id = c.repo_id WHERE NOT r.is_private OR EXISTS (SELECT 1 FROM seen s WHERE s.repo_id = c.repo_id AND s.user_id = a.user_id)")
def j14_chunk_detail(spark, d):
    """Every event asks for the chunk of its number (or for none) on behalf of one of 40 users; chunks are the catalog's files."""
    e, event = F.col("event_id"), spark.read.parquet(f"{d}/events.parquet")
    asked = event.select(F.when(e % 10 == 0, F.concat(F.lit("x"), e.cast("string"))).otherwise(e.cast("string")).alias("chunk_id"), (e % 40).alias("user_id"))
    chunks = view(spark, d, "files_v").select("id", "repo_id", "path", F.lit(None).cast("string").alias("symbol"), "language", F.col("content_hash").alias("content"))
    return K.chunk_detail(chunks, view(spark, d, "repos_v"), _visible(spark, d), asked).select("chunk_id", "user_id", "repo_id", "path", F.col("content").alias("content_hash"))


@query("SELECT 'id' AS by_, id, owner, name, status FROM repos_v WHERE id = 77 UNION ALL SELECT 'slug', id, owner, name, status FROM repos_v WHERE owner = 'machinery' AND name = (SELECT name FROM repos_v WHERE owner = 'machinery' ORDER BY id LIMIT 1) UNION ALL SELECT 'slug', id, owner, name, status FROM repos_v WHERE owner = 'nobody'")
def j15_get_repo(spark, d):
    repos = view(spark, d, "repos_v")
    name = repos.where("owner = 'machinery'").orderBy("id").first()["name"]
    found = K.get_repo(repos, id=77).select(F.lit("id").alias("by_"), "*")
    for owner, n in (("Machinery", name.upper()), ("nobody", "nothing")):
        found = found.unionByName(K.get_repo(repos, owner=owner, name=n).select(F.lit("slug").alias("by_"), "*"))
    return found.select("by_", "id", "owner", "name", "status")


@query(f"SELECT repo_id, user_id, verified_at > {NOW} - INTERVAL 1 HOUR AS fresh FROM repo_access_v")
def p21_access_freshness(spark, d):
    return view(spark, d, "repo_access_v").select("repo_id", "user_id", A.fresh(AS_OF).alias("fresh"))


@query(f"WITH {_ACCESS} SELECT repo_id, user_id, CASE WHEN answer = 'yes' THEN {NOW} ELSE verified_at END AS verified_at FROM both_ WHERE coalesce(answer, 'unknown') = 'yes' OR (coalesce(answer, 'unknown') = 'unknown' AND verified_at IS NOT NULL)")
def s14_apply_access(spark, d):
    return A.apply_access(view(spark, d, "repo_access_v"), view(spark, d, "answers_v"), AS_OF)


@query("SELECT id, CASE WHEN id % 5 = 0 THEN concat('new', id) ELSE login END AS login, CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'N' END ELSE name END AS name FROM users_v UNION ALL SELECT id + 100000, concat('new', id + 100000), NULL FROM users_v WHERE id % 5 = 1")
def s15_upsert_users(spark, d):
    u = view(spark, d, "users_v")
    named = lambda df: df.select("id", F.concat(F.lit("new"), F.col("id").cast("string")).alias("login"), F.when((F.col("id") % 2 == 0) & (F.col("id") < 100000), "N").alias("name"))
    return A.upsert_users(u, named(u.where("id % 5 = 0")).union(named(u.where("id % 5 = 1").select((F.col("id") + 100000).alias("id")))))


@query(f"WITH {_SEEN} SELECT f.id AS ref_id, CASE WHEN p.owner IS NOT NULL THEN lower(concat(p.owner, '/', p.name)) END AS slug, CASE WHEN p.owner IS NULL OR (coalesce(r.is_private, false) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.repo_id = r.id AND s.user_id = f.id % 40)) THEN 'not found' WHEN r.id IS NULL THEN 'created' WHEN r.status = 'error' THEN 'requeued' ELSE 'existing' END AS outcome, CASE WHEN p.owner IS NULL OR (coalesce(r.is_private, false) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.repo_id = r.id AND s.user_id = f.id % 40)) THEN NULL WHEN r.id IS NULL OR r.status = 'error' THEN 'queued' ELSE r.status END AS status FROM refs_v f LEFT JOIN (SELECT id, CASE WHEN ok THEN o END AS owner, CASE WHEN ok THEN n END AS name FROM (SELECT *, coalesce(regexp_full_match(o, '[A-Za-z0-9][A-Za-z0-9-]{{0,38}}') AND regexp_full_match(n, '[A-Za-z0-9._-]{{1,100}}') AND n NOT IN ('.', '..'), false) AS ok FROM (SELECT id, p[1] AS o, regexp_replace(p[2], '(?i)\\.git$', '') AS n FROM (SELECT id, list_filter(string_split(regexp_extract(regexp_replace(regexp_replace(trim(ref), '(?i)^git@github\\.com:', ''), '(?i)^(https?://)?(www\\.)?github\\.com/', ''), '^[^?#]*'), '/'), lambda x: x <> '') AS p FROM refs_v)))) p ON f.id = p.id LEFT JOIN repos_v r ON lower(concat(p.owner, '/', p.name)) = concat(r.owner, '/', r.name)")
def i9_open_repos(spark, d):
    """One of 40 users types each reference."""
    refs = view(spark, d, "refs_v").withColumn("user_id", F.col("id") % 40)
    return A.open_repos(refs, view(spark, d, "repos_v"), _visible(spark, d))
