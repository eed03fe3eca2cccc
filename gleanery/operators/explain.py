"""Why a hit matched: shared words, lines worth a look, a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.display import quoted_list


def explain_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with matched_terms (array), highlight_lines (array) and reason.

    hits: query_id, path, symbol, kind, start_line, content, semantic_rank, keyword_rank. The highlighted window is the
    first 3 lines with the most distinct terms; its lines with any term are named by their number in the file.
    """
    terms = queries.select("query_id", T.query_terms(F.col("query")).alias("terms"))
    df = hits.join(terms, "query_id")
    df = df.withColumn("per_line", F.transform(F.split("content", "\n"), lambda x: T.term_hits(T.split_identifiers(x), F.col("terms"))))
    df = df.withColumn("matched_terms", F.array_distinct(F.concat(T.term_hits(T.split_identifiers(F.col("path")), F.col("terms")), T.term_hits(T.split_identifiers(F.col("symbol")), F.col("terms")), F.flatten("per_line"))))
    line = lambda i: F.coalesce(F.get("per_line", i), T.no_words())
    df = df.withColumn("sizes", F.transform(F.sequence(F.lit(0), F.size("per_line") - 1), lambda i: F.size(F.array_distinct(F.concat(line(i), line(i + 1), line(i + 2))))))
    df = df.withColumn("best", F.when(F.array_max("sizes") > 0, F.array_position("sizes", F.array_max("sizes")).cast("int") - 1))
    window = F.sequence(F.col("best"), F.least(F.col("best") + 2, F.size("per_line") - 1))
    lit = F.transform(F.filter(window, lambda i: F.size(F.get("per_line", i)) > 0), lambda i: i + F.col("start_line"))
    df = df.withColumn("highlight_lines", F.coalesce(lit, F.array().cast("array<int>")))
    return df.withColumn("reason", _reason()).drop("terms", "per_line", "sizes", "best")


def _reason():
    named = F.concat(F.col("kind"), F.lit(" "), F.get(F.split("symbol", ", "), F.lit(0)))
    where = F.when(F.coalesce("symbol", F.lit("")) != "", named).when(F.col("kind") == "file", "this file").otherwise("this block")
    words = quoted_list(F.col("matched_terms"))
    some = F.size("matched_terms") > 0
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    s, k = F.col("semantic_rank").cast("string"), F.col("keyword_rank").cast("string")
    both = text("Matched on meaning and keywords: ", where, " is #", s, " by embedding similarity and shares ", F.when(some, words).otherwise("terms"), " with your question.")
    meaning = text("Matched on meaning (#", s, " by embedding similarity); ", where, " also mentions ", words, ".")
    only = text("Matched on meaning only (#", s, " by embedding similarity): no shared keywords, but ", where, " is close to your question in embedding space.")
    keyword = text("Keyword match (#", k, " by full-text rank) on ", F.when(some, words).otherwise("your terms"), "; weaker semantic similarity.")
    base = F.when(s.isNotNull() & k.isNotNull(), both).when(s.isNotNull() & some, meaning).when(s.isNotNull(), only).otherwise(keyword)
    first, last = F.get("highlight_lines", F.lit(0)), F.try_element_at("highlight_lines", F.lit(-1))
    see = F.when(first.isNull(), "").when(first == last, text(" See line ", first.cast("string"), ".")).otherwise(text(" See lines ", first.cast("string"), "–", last.cast("string"), "."))
    return F.concat(base, see)
