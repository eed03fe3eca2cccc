"""Corpus, catalog and event views over the given tables. One SQL text serves Spark and DuckDB, so that both sides of a comparison start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import containing
from ..sources.tables import spread

AS_OF = "2024-01-31 00:00:00"
#: Tables of long rows, which a small file may give to a single task.
TEXTS = ("documents", "pages", "conversations")

VIEWS = {
    "corpus_files": """SELECT source AS repo_id,
  concat(CASE WHEN doc_id % 11 = 0 THEN 'tests/' WHEN doc_id % 13 = 0 THEN 'node_modules/' WHEN doc_id % 17 = 0 THEN '.cache/' ELSE 'src/' END,
         lang, '/doc', CAST(doc_id AS VARCHAR(20)),
         CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' WHEN 3 THEN '.png' WHEN 4 THEN '.min.js' ELSE '.yml' END) AS path,
  text AS content FROM {documents}""",
    "corpus_chunks": """SELECT d.doc_id AS id, d.source AS repo_id,
  concat(CASE WHEN d.doc_id % 11 = 0 THEN 'tests/' ELSE 'src/' END, d.lang, '/doc', CAST(d.doc_id AS VARCHAR(20)), '.md') AS path,
  CASE d.lang WHEN 'en' THEN 'Markdown' WHEN 'fr' THEN 'Python' WHEN 'de' THEN 'Go' ELSE 'Rust' END AS language,
  CASE WHEN d.doc_id % 3 = 0 THEN concat('read', upper(substr(d.lang, 1, 1)), 'Doc') END AS symbol,
  CASE WHEN d.doc_id % 3 = 0 THEN 'function' WHEN d.doc_id % 5 = 0 THEN 'file' ELSE 'section' END AS kind,
  CAST(d.doc_id % 50 + 1 AS INT) AS start_line, d.text AS content FROM {documents} d""",
    "chunk_vectors": """SELECT d.doc_id AS id, d.source AS repo_id, CASE d.lang WHEN 'en' THEN 'Markdown' WHEN 'fr' THEN 'Python' WHEN 'de' THEN 'Go' ELSE 'Rust' END AS language,
  e.embedding FROM {documents} d JOIN {embeddings} e ON d.doc_id = e.vec_id""",
    "search_queries": """SELECT b.item_id AS query_id, substr(trim(b.text), 1, 300) AS query, e.embedding AS vector
  FROM {benchmark} b LEFT JOIN {embeddings} e ON b.item_id = e.vec_id""",
    "scoped_queries": """SELECT b.item_id AS query_id, substr(trim(b.text), 1, 300) AS query, e.embedding AS vector,
  CASE b.item_id % 4 WHEN 1 THEN split(concat('src', CAST(b.item_id % 20 AS VARCHAR(20))), ',')
    WHEN 2 THEN split(concat('src', CAST(b.item_id % 20 AS VARCHAR(20)), ',src', CAST((b.item_id * 7 + 3) % 20 AS VARCHAR(20)), ',src', CAST((b.item_id + 11) % 20 AS VARCHAR(20))), ',') END AS repo_ids,
  CASE WHEN b.item_id % 4 = 2 THEN split('Go,Markdown', ',') WHEN b.item_id % 4 = 3 THEN split('Python,Rust,Markdown', ',') END AS languages
  FROM {benchmark} b LEFT JOIN {embeddings} e ON b.item_id = e.vec_id""",
    "search_labels": "SELECT b.item_id AS query_id, d.doc_id AS id FROM {benchmark} b JOIN {documents} d ON contains(d.text, b.text)",
    "talk_files": """SELECT concat('conv', CAST(conv_id % 10 AS VARCHAR(20))) AS repo_id, concat('docs/c', CAST(conv_id AS VARCHAR(20)), '_', CAST(turn AS VARCHAR(20)), '.md') AS path,
  concat('# ', role, chr(10), chr(10), text) AS content FROM {conversations}""",
    "repos_v": """SELECT c_custkey AS id, lower(c_mktsegment) AS owner, lower(replace(c_name, '#', '-')) AS name, CAST(floor(c_acctbal) AS INT) AS stars,
  CASE c_custkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'fetching' WHEN 2 THEN 'indexing' WHEN 3 THEN 'error' ELSE 'ready' END AS status,
  CASE WHEN c_custkey % 5 = 3 THEN 'failed' END AS status_message,
  c_custkey % 7 = 0 AS is_private, CAST(c_custkey % 300 AS INT) AS total_chunks, CAST(c_custkey * 7 % 400 AS INT) AS embedded_chunks, CAST(c_custkey % 90 AS INT) AS total_files,
  CAST(c_custkey % 13 AS INT) AS skipped_files, CAST(c_custkey * 31 % 101 AS INT) AS search_count, CASE WHEN c_custkey % 4 > 0 THEN concat('text of ', c_name) END AS description,
  CASE WHEN c_custkey % 6 > 0 THEN sha1(c_name) END AS commit_sha,
  CASE WHEN c_custkey % 3 = 0 THEN CAST('2024-01-30 00:00:00' AS TIMESTAMP) END AS indexed_at,
  CASE WHEN c_custkey % 2 = 0 THEN CAST('2024-01-30 23:58:00' AS TIMESTAMP) ELSE CAST('2024-01-30 23:52:30' AS TIMESTAMP) END AS updated_at FROM {customer}""",
    "files_v": """SELECT o_orderkey AS id, o_custkey AS repo_id, concat('src/f', CAST(o_orderkey AS VARCHAR(20)), '.ts') AS path, o_orderpriority AS language,
  sha1(concat(CAST(o_orderkey AS VARCHAR(20)), o_orderstatus)) AS content_hash FROM {orders}""",
    "chunks_v": """SELECT o.o_custkey AS repo_id, l.l_orderkey AS file_id, l.l_orderkey * 10 + l.l_linenumber AS id, l.l_returnflag <> 'N' AS embedded,
  CASE WHEN l.l_linenumber % 3 = 0 THEN CAST('2024-01-30 23:59:00' AS TIMESTAMP) WHEN l.l_linenumber % 3 = 1 THEN CAST('2024-01-30 22:00:00' AS TIMESTAMP) END AS claimed_at
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "snapshot_old": "SELECT o_custkey AS repo_id, concat('src/f', CAST(o_orderkey AS VARCHAR(20)), '.ts') AS path, sha1(CAST(o_orderkey AS VARCHAR(20))) AS content_hash FROM {orders} WHERE o_orderkey % 11 <> 0",
    "snapshot_new": """SELECT o_custkey AS repo_id, concat('src/f', CAST(o_orderkey AS VARCHAR(20)), '.ts') AS path,
  sha1(concat(CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE '' END)) AS content_hash FROM {orders} WHERE o_orderkey % 13 <> 0""",
    "search_log": "SELECT event_id, user_id AS repo_id, CAST(ts AS TIMESTAMP) AS ts FROM {events} WHERE event_type = 'view'",
    "progress_v": """SELECT user_id AS repo_id, CAST(ts AS TIMESTAMP) AS ts, event_id,
  12 * count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (event_id % 5) * 6 AS done FROM {events}""",
    "opens": "SELECT user_id, concat('Owner', CAST(event_id % 4 AS VARCHAR(20)), '/repo', CAST(event_id % 30 AS VARCHAR(20))) AS slug, CAST(ts AS TIMESTAMP) AS ts, event_id FROM {events} WHERE event_type = 'click'",
    "sessions_v": "SELECT md5(CAST(event_id AS VARCHAR(20))) AS id, user_id, CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) + INTERVAL '10' DAY AS expires_at FROM {events} WHERE event_type = 'signup'",
    "users_v": "SELECT DISTINCT user_id AS id, concat('user', CAST(user_id AS VARCHAR(20))) AS login, CASE WHEN user_id % 3 > 0 THEN concat('Name ', CAST(user_id AS VARCHAR(20))) END AS name FROM {events}",
    "repo_access_v": """SELECT user_id * 7 AS repo_id, event_id % 40 AS user_id, CASE WHEN event_id % 2 = 0 THEN CAST('2024-01-30 23:30:00' AS TIMESTAMP) ELSE CAST(max(ts) AS TIMESTAMP) END AS verified_at
  FROM {events} WHERE event_type = 'purchase' GROUP BY user_id * 7, event_id % 40, event_id % 2""",
    "answers_v": """SELECT DISTINCT user_id * 7 AS repo_id, event_id % 40 AS user_id, CASE (user_id + event_id % 40) % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unknown' ELSE 'yes' END AS answer
  FROM {events} WHERE event_type IN ('purchase', 'error')""",
    "refs_v": """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN concat('https://github.com/', lower(c_mktsegment), '/', lower(replace(c_name, '#', '-')), '.git?tab=x')
    WHEN 1 THEN concat('git@github.com:', c_mktsegment, '/', replace(c_name, '#', '-')) WHEN 2 THEN concat('  www.GitHub.com/', c_mktsegment, '/r', CAST(c_custkey AS VARCHAR(20)), '/tree/main ')
    WHEN 3 THEN c_name WHEN 4 THEN concat(c_mktsegment, '/..') WHEN 5 THEN concat('-bad/', c_name) WHEN 6 THEN concat(lower(c_mktsegment), '//', lower(replace(c_name, '#', '-')), '#readme')
    WHEN 7 THEN '' ELSE concat(lower(c_mktsegment), '/new', CAST(c_custkey AS VARCHAR(20))) END AS ref FROM {customer}""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = lambda t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) if t in TEXTS else spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "search_labels":  # the same rows without comparing every item with every document
        return containing(table("benchmark").select(F.col("item_id").alias("query_id"), "text"), table("documents").select(F.col("doc_id").alias("id"), "text"))
    return spark.sql(VIEWS[name], **{t: table(t) for t in tables_of(VIEWS[name])})


def with_views(body: str) -> str:
    """DuckDB SQL: the views that a query names, as common table expressions before it."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in named]
    if not ctes:
        return body
    head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(h)), "")
    return (head or "WITH ") + ", ".join(ctes) + (", " if head else " ") + body[len(head) :]
