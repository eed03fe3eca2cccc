"""Chunks of files without definitions as folds over arrays of lines: column expressions only, a file stays a row.

A span is (a, b, start, stop, symbols): first and last line from 0, the offset of its first character and the one after its
last newline, so that sizes of unions are differences. Every fold carries the last spans in its state and looks at one more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's str.strip knows it: fixed code points.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WS = r"[\s\x1c-\x1f]"
FENCE = rf"(?U)^{_WS}*(```|~~~)"
HEADING = rf"(?Us)^#{{1,6}}{_WS}+(.+)"
_SPAN = "struct<a:int,b:int,start:bigint,stop:bigint,symbols:array<string>>"
_MARK = "struct<a:int,start:bigint,name:string>"


def _none(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _int(n: int) -> Column:
    return F.lit(n).cast("int")


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("bigint")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: named by a lambda over an array of one."""
    return F.transform(F.array(x), f)[0]


def _span(a: Column, b: Column, start: Column, stop: Column, symbols: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), _long(start).alias("start"), _long(stop).alias("stop"), symbols.alias("symbols"))


def _last(xs: Column) -> Column:
    return F.get(xs, F.size(xs) - 1)


def _but_last(xs: Column) -> Column:
    return F.slice(xs, F.lit(1), F.size(xs) - 1)


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def lines_of(content: Column) -> Column:
    return F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")


def size_of(lines: Column) -> Column:
    """Characters of lines, each with its newline."""
    return F.aggregate(lines, _long(0), lambda n, x: n + F.char_length(x) + 1)


def line_windows(lines: Column, first: Column, offset: Column, symbols: Column, max_chars: int, max_lines: int, overlap: int) -> Column:
    """Windows over lines, of which the first is number `first` at `offset`. A window takes lines while it stays within max_chars and max_lines; the next shares `overlap` lines and begins a line later at least. A line that doesn't fit closes up to overlap + 1 windows, until one is left that takes it, so the fold over lines has one of that many steps inside; offsets are kept of the lines that a next window can begin with."""
    state = F.struct(first.cast("int").alias("s"), _long(offset).alias("s_at"), first.cast("int").alias("i"), _long(offset).alias("at"), _none("bigint").alias("recent"), _none(_SPAN).alias("out"))

    def take(st: Column, line: Column) -> Column:
        i, at = st["i"], st["at"]
        stop = at + F.char_length(line) + 1
        begun = F.concat(st["recent"], F.array(at))
        recent = F.when(F.size(begun) > overlap + 1, F.slice(begun, F.lit(2), F.size(begun) - 1)).otherwise(begun)
        inner = F.struct(st["s"].alias("s"), st["s_at"].alias("s_at"), st["out"].alias("out"))

        def close(c: Column, _: Column) -> Column:
            full = (c["s"] < i) & ((stop - c["s_at"] > max_chars) | (i - c["s"] >= max_lines))
            s = F.greatest(i - overlap, c["s"] + 1)
            return F.when(full, F.struct(s.alias("s"), F.get(recent, F.size(recent) - 1 - (i - s)).alias("s_at"), F.concat(c["out"], F.array(_span(c["s"], i - 1, c["s_at"], at, symbols))).alias("out"))).otherwise(c)

        fits = (stop - st["s_at"] <= max_chars) & (i - st["s"] < max_lines)
        done = F.when(fits, inner).otherwise(F.aggregate(F.sequence(_int(0), _int(overlap)), inner, close))
        return _let(done, lambda c: F.struct(c["s"].alias("s"), c["s_at"].alias("s_at"), (i + 1).cast("int").alias("i"), stop.alias("at"), recent.alias("recent"), c["out"].alias("out")))

    return F.aggregate(lines, state, take, lambda st: F.concat(st["out"], F.array(_span(st["s"], st["i"] - 1, st["s_at"], st["at"], symbols))))


def headings(lines: Column) -> Column:
    """(a, start, name) of each line outside fences that is a heading; an unnamed one stands first if the file begins without."""
    state = F.struct(_int(0).alias("i"), _long(0).alias("at"), F.lit(False).alias("fenced"), _none(_MARK).alias("marks"))

    def take(st: Column, line: Column) -> Column:
        fenced = st["fenced"] != line.rlike(FENCE)
        mark = F.struct(st["i"].alias("a"), st["at"].alias("start"), F.left(_strip(F.regexp_extract(line, HEADING, 1)), F.lit(80)).alias("name"))
        marks = F.when(~fenced & line.rlike(HEADING), F.concat(st["marks"], F.array(mark))).otherwise(st["marks"])
        return F.struct((st["i"] + 1).cast("int").alias("i"), (st["at"] + F.char_length(line) + 1).alias("at"), fenced.alias("fenced"), marks.alias("marks"))

    top = F.array(F.struct(_int(0).alias("a"), _long(0).alias("start"), F.lit("").alias("name")))
    return F.aggregate(lines, state, take, lambda st: F.when(F.coalesce(F.get(st["marks"], F.lit(0))["a"] == 0, F.lit(False)), st["marks"]).otherwise(F.concat(top, st["marks"])))


def heading_spans(lines: Column, marks: Column, total: Column, max_chars: int, min_chars: int, max_lines: int, overlap: int) -> Column:
    """Sections between marks: one that stays within 2 * min_chars with the span before it joins that, one above max_chars becomes windows."""

    def spans(m: Column, k: Column) -> Column:
        after = F.get(marks, k + 1)
        b, stop = F.coalesce(after["a"], F.size(lines)) - 1, F.coalesce(after["start"], total)
        symbols = F.when(m["name"] != "", F.array(m["name"])).otherwise(_none("string"))
        windows = line_windows(F.slice(lines, m["a"] + 1, b - m["a"] + 1), m["a"], m["start"], symbols, max_chars, max_lines, overlap)
        return F.struct(b.cast("int").alias("b"), stop.alias("stop"), F.when(stop - m["start"] > max_chars, windows).otherwise(F.array(_span(m["a"], b, m["start"], stop, symbols))).alias("spans"))

    def join(out: Column, s: Column) -> Column:
        p = _last(out)
        joined = F.concat(_but_last(out), F.array(_span(p["a"], s["b"], p["start"], s["stop"], p["symbols"])))
        return F.when((F.size(out) > 0) & (s["stop"] - p["start"] <= 2 * min_chars), joined).otherwise(F.concat(out, s["spans"]))

    return F.aggregate(F.transform(marks, spans), _none(_SPAN), join)


def fold_slivers(spans: Column, max_chars: int, min_chars: int) -> Column:
    """A span joins the one before it if at most two lines lie between, one of them is under half of min_chars, and both together stay within max_chars."""

    def join(out: Column, s: Column) -> Column:
        p = _last(out)
        stop = F.greatest(p["stop"], s["stop"])
        small = 2 * F.least(p["stop"] - p["start"], s["stop"] - s["start"]) < min_chars
        fits = (F.size(out) > 0) & (s["a"] <= p["b"] + 2) & small & (stop - p["start"] <= max_chars)
        joined = F.concat(_but_last(out), F.array(_span(p["a"], F.greatest(p["b"], s["b"]), p["start"], stop, F.concat(p["symbols"], s["symbols"]))))
        return F.when(fits, joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, _none(_SPAN), join)


def finalize(spans: Column, lines: Column, least: int = 25) -> Column:
    """(start_line, end_line, symbol, content) of spans, lines from 1: blank lines at the edges go, and so does what has fewer than `least` characters; the first three names and how many more."""

    def cut(s: Column) -> Column:
        told = F.transform(F.slice(lines, s["a"] + 1, s["b"] - s["a"] + 1), lambda x: _strip(x) != "")
        names = F.array_distinct(s["symbols"])
        more = F.when(F.size(names) > 3, F.concat(F.lit(" +"), (F.size(names) - 3).cast("string"))).otherwise("")
        symbol = F.left(F.concat(F.array_join(F.slice(names, 1, 3), ", "), more), F.lit(160))
        edges = _let(told, lambda t: F.struct((s["a"] + F.greatest(F.array_position(t, True), F.lit(1))).cast("int").alias("a"), (s["b"] - F.greatest(F.array_position(F.reverse(t), True), F.lit(1)) + 2).cast("int").alias("b")))
        return _let(edges, lambda e: F.struct(e["a"].alias("start_line"), e["b"].alias("end_line"), F.nullif(symbol, F.lit("")).alias("symbol"), F.array_join(F.slice(lines, e["a"], F.greatest(e["b"] - e["a"] + 1, _int(0))), "\n").alias("content")))

    return F.filter(F.transform(spans, cut), lambda c: F.char_length(_strip(c["content"])) >= least)


def plain_chunks(files: DataFrame, max_chars: int, min_chars: int, max_lines: int, overlap: int, most: int | None = None) -> DataFrame:
    """(repo_id, path, language, start_line, end_line, symbol, kind, content) of files (repo_id, path, language, strategy, content): Markdown by headings, other files up to max_chars whole, longer ones by windows. Null and empty contents have no chunks."""
    lines, total = F.col("_lines"), F.col("_total")
    limits = max_chars, min_chars, max_lines, overlap
    kept = files.where("content <> ''").select("repo_id", "path", "language", F.coalesce(F.col("strategy") == "markdown", F.lit(False)).alias("_md"), lines_of(F.col("content")).alias("_lines"))
    sized = kept.withColumn("_total", size_of(lines)).withColumn("_marks", F.when(F.col("_md"), headings(lines)))
    whole = ~F.col("_md") & (total - 1 <= max_chars)
    none = _none("string")
    spans = F.when(F.col("_md"), heading_spans(lines, F.col("_marks"), total, *limits)).when(whole, F.array(_span(_int(0), F.size(lines) - 1, _long(0), total, none))).otherwise(line_windows(lines, _int(0), _long(0), none, max_chars, max_lines, overlap))
    kind = F.when(F.col("_md"), "section").when(whole, "file").otherwise("block")
    joined = sized.select("repo_id", "path", "language", "_lines", kind.alias("kind"), spans.alias("_spans"))
    joined = joined.select("repo_id", "path", "language", "_lines", "kind", fold_slivers(F.col("_spans"), max_chars, min_chars).alias("_spans"))
    chunks = finalize(F.col("_spans"), lines)
    chunks = F.slice(chunks, 1, most) if most else chunks
    # the outer form, as the plain one would have the whole expression computed in a filter first
    out = joined.select("repo_id", "path", "language", "kind", F.explode_outer(chunks).alias("_c")).where("_c is not null")
    return out.select("repo_id", "path", "language", "_c.start_line", "_c.end_line", "_c.symbol", "kind", "_c.content")
