"""The registered queries of the operators in this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cdc, decontam, fim, html_extract, jaccard, media, minhash, pst, suffix, toxicity, trie, warc
from .common import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.exact_substring_dedup(_read(spark, sf_dir, "documents"), length=100, digests=True)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary file stands; every executor has the package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op4_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.chunk_dedup(_read(spark, sf_dir, "documents"), digests=True)


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(_read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_warc(_read(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).drop("file", "offset", "url")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.text_to_png(_read(spark, sf_dir, "documents")), digests=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), words=3, percent=90)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(_read(spark, sf_dir, "documents"), seed=42, fim_percent=50, spm_percent=80))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_suffix_dedup, op3_bpe, op4_cdc_dedup, op5_suffix_tree, op6_decontamination, op7_html, op8_toxicity, op9_warc, op10_media, op11_prefix_trie, op12_jaccard_join, op13_fill_in_middle, pipeline)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""WITH RECURSIVE w AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])) END) AS sh FROM w),
n AS (SELECT doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT both_.b, r.c FROM r JOIN both_ ON r.doc_id = both_.a)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r JOIN n USING (doc_id) GROUP BY r.doc_id"""

OP12 = OP1.replace("100 * c >= 85 *", "100 * c >= 90 *").replace(", r.doc_id = min(c) AS kept", "")

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _seed_sql(table: str) -> str:
    key = lambda k, m: f"concat({k}, {', '.join(f"' ', ws[i + {o + 1}]" for o in m)})"
    masks = " UNION ALL ".join(f"SELECT id, i AS pos, {key(k, m)} AS seed FROM {table}_p" for k, m in enumerate(decontam.MASKS))
    return f"{table}_p AS (SELECT id, ws, unnest(generate_series(0, len(ws) - {decontam.SPAN})) AS i FROM {table} WHERE len(ws) >= {decontam.SPAN}), {table}_s AS ({masks})"


OP6 = f"""WITH d AS (SELECT DISTINCT doc_id AS id, {_TOKENS} AS ws FROM documents), q AS (SELECT DISTINCT item_id AS id, {_TOKENS} AS ws FROM benchmark), {_seed_sql("d")}, {_seed_sql("q")},
q_short AS (SELECT id, ws, len(ws) AS n, array_to_string(ws, ' ') AS seed FROM q WHERE len(ws) < {decontam.SPAN} AND length(array_to_string(ws, '')) >= {decontam.SHORT_CHARS}),
d_short AS (SELECT id, n, pos, array_to_string(ws[pos + 1:pos + n], ' ') AS seed FROM (SELECT id, ws, n, unnest(generate_series(0, len(ws) - n)) AS pos FROM d, (SELECT DISTINCT n FROM q_short) WHERE len(ws) >= n)),
h AS (SELECT DISTINCT d_s.id AS doc_id, q_s.id AS item_id, d_s.pos - q_s.pos AS diag FROM d_s JOIN q_s USING (seed)
UNION SELECT d_short.id, q_short.id, pos FROM d_short JOIN q_short USING (n, seed)),
m AS (SELECT doc_id, item_id, diag, least(len(q.ws), 13) AS n, list_transform(generate_series(1, len(q.ws)), lambda i: CASE WHEN diag + i >= 1 AND d.ws[diag + i] = q.ws[i] THEN 1 ELSE 0 END) AS eq FROM h JOIN d ON d.id = doc_id JOIN q ON q.id = item_id),
b AS (SELECT doc_id, item_id, diag, n, list_max(list_transform(generate_series(1, len(eq) - n + 1), lambda i: list_sum(list_slice(eq, i, i + n - 1)))) AS best FROM m)
SELECT doc_id, item_id, best::BIGINT AS n_match, n::BIGINT AS n_tokens, diag AS doc_start FROM b WHERE best * 100 >= n * 80 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY best DESC, n DESC, diag) = 1"""

_FIVES = ", ".join(f"substr('{warc.BASE32}', ((CAST(concat('0x', substr(sha1(p), {5 * g + 1}, 5)) AS INT) >> {s}) & 31) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0))
OP9 = f"""WITH r AS (SELECT page_id, coalesce(html, '') AS p FROM pages), d AS (SELECT page_id, strlen(p) AS payload_bytes, concat({_FIVES}) AS payload_digest FROM r),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_STEPS = "list_concat([4294967295::BIGINT], flatten(list_transform(str_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
_CRC = f"xor(4294967295::BIGINT, list_reduce({_STEPS}, lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END))"
OP11 = f"""WITH o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT *, {_CRC} % 9 AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(f.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(ts) AS n, md5(to_json(ts[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(ts[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(ts[d].t) ELSE 0 END AS bytes FROM (SELECT *, unnest(generate_series(0, len(ts))) AS d FROM b)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, any_value(up) AS up, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY 1, 2),
c AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.up = n.k) AS n_children FROM n),
s AS (SELECT p.d, p.k, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.bytes) AS saved FROM c JOIN p ON p.conv_id = c.conv_id AND p.d <= c.d GROUP BY 1, 2)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM c JOIN s ON s.d = c.d AND s.k = c.k LEFT JOIN n u ON u.d = c.d - 1 AND u.k = c.up"""

_HEX = lambda k: f"CAST(concat('0x', substr(h, {8 * k + 1}, 8)) AS BIGINT)"
OP13 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ts, sha256(concat('42:', doc_id)) AS h FROM documents),
c AS (SELECT *, len(ts) AS n, {_HEX(0)} % (len(ts) + 1) AS a, {_HEX(1)} % (len(ts) + 1) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_HEX(2)} % 100 >= 50 THEN 'plain' WHEN {_HEX(3)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, n, form, text, array_to_string(ts[1:least(a, b)], '') AS p, array_to_string(ts[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(ts[greatest(a, b) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express on whole tables; the others are tested against brute-force versions."""
    return {"op1_minhash": OP1, "op6_decontamination": OP6, "op9_warc": OP9, "op11_prefix_trie": OP11, "op12_jaccard_join": OP12, "op13_fill_in_middle": OP13}
