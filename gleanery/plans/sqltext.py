"""Pieces of DuckDB SQL for the same text rules as functions/ has for Spark."""

from __future__ import annotations

from ..functions import paths as P
from ..functions import text as T
from ..operators.chunking import MAX_CHARS, MAX_LINES, MIN_CHARS, OVERLAP
from ..operators.folds import BLANKS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_list(ws) -> str:
    return "(" + ", ".join(map(lit, ws)) + ")"


def split_identifiers(x: str) -> str:
    humps = f"regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({humps}), '[^a-z0-9]+'), lambda w_: length(w_) > 1)"


def stem(w: str) -> str:
    n = f"length({w})"
    cut = (
        f"CASE WHEN {n} > 5 AND ends_with({w}, 'ing') THEN left({w}, {n} - 3) WHEN {n} > 4 AND ends_with({w}, 'ies') THEN left({w}, {n} - 3) || 'y' "
        f"WHEN {n} > 4 AND ends_with({w}, 'ed') THEN left({w}, {n} - 2) WHEN {n} > 4 AND regexp_matches({w}, '(ss|x|ch|sh)es$') THEN left({w}, {n} - 2) "
        f"WHEN {n} > 3 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, {n} - 1) ELSE {w} END"
    )
    return f"CASE WHEN length({cut}) > 3 AND ends_with({cut}, 'e') THEN left({cut}, length({cut}) - 1) ELSE {cut} END"


def aliases(w: str) -> str:
    return f"CASE {w} " + " ".join(f"WHEN {lit(k)} THEN [{', '.join(map(lit, v))}]" for k, v in T.ALIASES.items()) + " ELSE [] END"


#: (query_id, pos, word, stem) of all query terms, as a common table expression over search_queries.
TERMS = f"""q_words AS (SELECT query_id, unnest(list_transform({split_identifiers('query')}, lambda w: list_concat([w], {aliases('w')}))) AS ws, generate_subscripts({split_identifiers('query')}, 1) AS p FROM search_queries),
q_flat AS (SELECT query_id, p, unnest(ws) AS word, generate_subscripts(ws, 1) AS p2 FROM q_words),
q_kept AS (SELECT query_id, p, p2, word, {stem('word')} AS stem FROM q_flat WHERE length(word) >= 2 AND word NOT IN {words_list(T.QUESTION_WORDS)}),
q_first AS (SELECT *, row_number() OVER (PARTITION BY query_id, stem ORDER BY p, p2) AS nth FROM q_kept),
q_terms AS MATERIALIZED (SELECT * FROM (SELECT query_id, word, stem, row_number() OVER (PARTITION BY query_id ORDER BY p, p2) AS pos FROM q_first WHERE nth = 1) WHERE pos <= {T.MAX_TERMS})"""

BODY = split_identifiers("content")
#: (id, repo_id, language, term, weight, tf) of corpus_chunks.
POSTINGS = f"""p_words AS (SELECT id, repo_id, language, unnest(list_concat({split_identifiers('symbol')}, {split_identifiers('path')})) AS word, 'A' AS weight FROM corpus_chunks
UNION ALL SELECT id, repo_id, language, unnest({BODY}) AS word, 'D' AS weight FROM corpus_chunks),
terms AS MATERIALIZED (SELECT id, repo_id, language, {stem('word')} AS term, weight, count(*) AS tf FROM p_words WHERE word <> '' AND word NOT IN {words_list(T.ENGLISH_WORDS)} GROUP BY ALL)"""

SIMILARITY = "round(coalesce(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) / nullif(sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.vector, lambda x: CAST(x AS DOUBLE) * x))), 0), 0), 6)"
#: The two legs and what fusion makes of them.
LEGS = f"""{TERMS}, {POSTINGS},
text_ranks AS (SELECT t.query_id, p.id, round(sum(CASE p.weight WHEN 'A' THEN 1.0 ELSE 0.1 END * p.tf), 6) AS rank FROM terms p JOIN q_terms t ON p.term = t.stem WHERE t.word NOT IN {words_list(T.ENGLISH_WORDS)} GROUP BY 1, 2),
keyword AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, id) AS keyword_rank FROM text_ranks) WHERE keyword_rank <= 40),
sims AS MATERIALIZED (SELECT q.query_id, v.id, {SIMILARITY} AS similarity FROM chunk_vectors v, search_queries q WHERE q.vector IS NOT NULL),
semantic AS (SELECT * FROM (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS semantic_rank FROM sims) WHERE semantic_rank <= 40),
fused AS MATERIALIZED (SELECT query_id, id, semantic_rank, keyword_rank, round(coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + 0.6::DOUBLE * coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 6) AS score FROM semantic FULL OUTER JOIN keyword USING (query_id, id)),
priced AS (SELECT f.query_id, f.id, f.semantic_rank, f.keyword_rank, c.path, c.language, round(f.score * {{prior}}, 6) AS score FROM fused f JOIN corpus_chunks c USING (id)),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS final_rank FROM priced) WHERE final_rank <= 10)"""


def prior(path: str, language: str) -> str:
    return f"CASE WHEN regexp_matches({path}, {lit(P.TEST_PATH)}) THEN {P.TEST_PRIOR}::DOUBLE WHEN {language} = 'Markdown' THEN {P.DOCS_PRIOR}::DOUBLE ELSE 1.0::DOUBLE END"


LEGS = LEGS.replace("{prior}", prior("c.path", "c.language"))

#: The same where each question has repos and languages of its own.
_IN_SCOPE = "(q.repo_ids IS NULL OR list_contains(q.repo_ids, {t}.repo_id)) AND (q.languages IS NULL OR list_contains(q.languages, {t}.language))"
SCOPED_LEGS = (
    LEGS.replace("search_queries", "scoped_queries")
    .replace("JOIN q_terms t ON p.term = t.stem WHERE", f"JOIN q_terms t ON p.term = t.stem JOIN scoped_queries q ON q.query_id = t.query_id WHERE {_IN_SCOPE.format(t='p')} AND")
    .replace("WHERE q.vector IS NOT NULL)", f"WHERE q.vector IS NOT NULL AND {_IN_SCOPE.format(t='v')})")
)


def case(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items() if v) + " END"


BASE = "lower(list_extract(string_split(path, '/'), -1))"
EXT = f"CASE WHEN contains({BASE}, '.') THEN list_extract(string_split({BASE}, '.'), -1) END"
SPECIAL = case(BASE, P.SPECIAL_FILES)
LANGUAGE = f"coalesce({SPECIAL}, {case(EXT, {k: v[0] for k, v in P.EXTENSIONS.items()})})"
GRAMMAR = f"CASE WHEN {SPECIAL} IS NULL THEN {case(EXT, {k: v[1] for k, v in P.EXTENSIONS.items()})} END"
DIRS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
PATH_REASON = (
    f"CASE WHEN len(list_filter({DIRS}, lambda d: d IN {words_list(P.IGNORED_DIRS)} OR (starts_with(d, '.') AND d <> '.'))) > 0 THEN 'ignored-dir' "
    f"WHEN {' OR '.join(f'regexp_matches(path, {lit(p)})' for p in P.IGNORED_FILES)} THEN 'ignored-file' WHEN {LANGUAGE} IS NULL THEN 'unsupported' END"
)
LINES = "len(string_split(content, chr(10)))"
LONGEST = "list_max(list_transform(string_split(content, chr(10)), lambda x: length(x)))"
CONTENT_REASON = f"CASE WHEN contains(content, chr(0)) THEN 'binary' WHEN {LONGEST} > 2000 OR length(content) / {LINES} > 300 THEN 'minified' END"
REASON = f"coalesce({PATH_REASON}, CASE WHEN strlen(content) > {P.MAX_FILE_BYTES} THEN 'too-large' END, {CONTENT_REASON})"
HISTOGRAM = "SELECT repo_id, language, count(*) AS n FROM files_v GROUP BY 1, 2"

STRATEGY = f"CASE WHEN {LANGUAGE} = 'Markdown' THEN 'markdown' WHEN {GRAMMAR} IS NOT NULL THEN 'ast' ELSE 'lines' END"


def plain_chunks(files: str, columns: str) -> str:
    """Chunks of files (repo_id, path, language, strategy, content) without definitions: windows by recursion, joins by reduction."""
    blanks = lit(BLANKS)
    begin = "CASE WHEN {s} = 0 THEN 0 ELSE f.stops[{s}] END"
    reach = f"{{s}} + greatest(1, len(list_filter(list_slice(f.stops, {{s}} + 1, least({{b}}, {{s}} + {MAX_LINES - 1}) + 1), lambda x: x - ({begin}) <= {MAX_CHARS}))) - 1"
    span = "struct_pack(a := {a}, b := {b}, start := {start}, stop := {stop}, symbols := {symbols})"
    nxt = f"greatest(w.e - {OVERLAP - 1}, w.s + 1)"
    return f"""WITH RECURSIVE files AS ({files}),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS k, repo_id, path, language, strategy = 'markdown' AS md, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM files WHERE content <> ''),
l AS (SELECT k, md, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS text FROM numbered),
o AS MATERIALIZED (SELECT *, sum(length(text) + 1) OVER w::BIGINT AS stop, sum(CASE WHEN regexp_matches(text, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER w % 2 AS fenced FROM l WINDOW w AS (PARTITION BY k ORDER BY line)),
h AS (SELECT *, md AND fenced = 0 AND regexp_matches(text, '^#{{1,6}}\\s+.+') AS head FROM o),
parts AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY line) AS sec FROM h),
sections AS MATERIALIZED (SELECT k, md, sec, min(line) AS a, max(line) AS b, min(stop - length(text) - 1) AS start, max(stop) AS stop, nullif(left(trim(regexp_extract(arg_min(CASE WHEN head THEN text ELSE '' END, line), '^#{{1,6}}\\s+(.+)', 1), {blanks}), 80), '') AS name FROM parts GROUP BY ALL),
f AS MATERIALIZED (SELECT k, list(stop ORDER BY line) AS stops FROM o GROUP BY k),
long AS (SELECT *, stop - start - CASE WHEN md THEN 0 ELSE 1 END > {MAX_CHARS} AS is_long FROM sections),
w AS (SELECT k, sec, b, a AS s, {reach.format(s="a", b="b")} AS e FROM long JOIN f USING (k) WHERE is_long
UNION ALL SELECT w.k, w.sec, w.b, {nxt}, {reach.format(s=nxt, b="w.b")} FROM w JOIN f ON f.k = w.k WHERE w.e < w.b),
spans AS (SELECT k, sec, md, {span.format(a="a", b="b", start="start", stop="stop", symbols="CASE WHEN name IS NULL THEN []::VARCHAR[] ELSE [name] END")} AS sp FROM long WHERE NOT is_long
UNION ALL SELECT w.k, w.sec, md, {span.format(a="w.s", b="w.e", start=begin.format(s="w.s"), stop="f.stops[w.e + 1]", symbols="CASE WHEN name IS NULL THEN []::VARCHAR[] ELSE [name] END")} FROM w JOIN f ON f.k = w.k JOIN long ON long.k = w.k AND long.sec = w.sec),
by_section AS (SELECT k, sec, any_value(md) AS md, list(sp ORDER BY sp.a) AS sps FROM spans GROUP BY k, sec),
by_file AS (SELECT k, any_value(md) AS md, list(sps ORDER BY sec) AS secs FROM by_section GROUP BY k),
merged AS (SELECT k, md, list_reduce(secs, lambda x, y: CASE WHEN y[-1].stop - x[-1].start <= {2 * MIN_CHARS} THEN list_concat(x[:-2], [{span.format(a="x[-1].a", b="y[-1].b", start="x[-1].start", stop="y[-1].stop", symbols="x[-1].symbols")}]) ELSE list_concat(x, y) END) AS sps FROM by_file),
folded AS (SELECT k, md, list_reduce(list_transform(sps, lambda s: [s]), lambda x, y: CASE WHEN y[1].a <= x[-1].b + 2 AND 2 * least(x[-1].stop - x[-1].start, y[1].stop - y[1].start) < {MIN_CHARS} AND greatest(x[-1].stop, y[1].stop) - x[-1].start <= {MAX_CHARS} THEN list_concat(x[:-2], [{span.format(a="x[-1].a", b="greatest(x[-1].b, y[1].b)", start="x[-1].start", stop="greatest(x[-1].stop, y[1].stop)", symbols="list_concat(x[-1].symbols, y[1].symbols)")}]) ELSE list_concat(x, y) END) AS sps FROM merged),
flat AS (SELECT k, md, unnest(sps) AS sp FROM folded),
told AS (SELECT flat.k, flat.md, sp, n.ls, list_transform(list_slice(n.ls, sp.a + 1, sp.b + 1), lambda t: trim(t, {blanks}) <> '') AS t, list_filter(sp.symbols, lambda s, i: list_position(sp.symbols, s) = i) AS names FROM flat JOIN numbered n ON n.k = flat.k),
edges AS (SELECT *, sp.a + greatest(coalesce(list_position(t, true), 1), 1) AS first_line, sp.b + 2 - greatest(coalesce(list_position(list_reverse(t), true), 1), 1) AS last_line FROM told),
cut AS (SELECT k, first_line::INT AS start_line, last_line::INT AS end_line, nullif(left(concat(array_to_string(names[:3], ', '), CASE WHEN len(names) > 3 THEN concat(' +', len(names) - 3) ELSE '' END), 160), '') AS symbol, CASE WHEN md THEN 'section' WHEN list_sum(list_transform(ls, lambda t: length(t) + 1)) - 1 <= {MAX_CHARS} THEN 'file' ELSE 'block' END AS kind, array_to_string(list_slice(ls, first_line, last_line), chr(10)) AS content FROM edges)
SELECT {columns} FROM cut JOIN numbered USING (k) WHERE length(trim(content, {blanks})) >= 25"""


_CORPUS = "SELECT repo_id, path, {language} AS language, {strategy} AS strategy, content FROM (SELECT repo_id, path, content FROM corpus_files{more}) WHERE {reason} IS NULL"
_TALK = " UNION ALL SELECT repo_id, path, content FROM talk_files"


def admitted(strategy: str = STRATEGY, talk: bool = True) -> str:
    return _CORPUS.format(language=LANGUAGE, strategy=strategy, more=_TALK if talk else "", reason=REASON)
