"""Files into search-sized chunks: headings, definitions or line windows; one row per chunk.

Each file is cut by itself, so the job is a map over files; line state within a file is a short loop. A boundary
provider says which lines define what; the default looks at signatures and indentation or brace depth, and a syntax
tree can be plugged in instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import plain_chunks

MAX_CHARS, MIN_CHARS, MAX_CHUNKS, MAX_LINES, OVERLAP = 1500, 350, 120, 81, 4


@dataclass
class Definition:
    """A named span of lines (0-based, inclusive) and what it is; depth tells what encloses it."""

    start: int
    end: int
    name: str
    kind: str
    depth: int


@dataclass
class Span:
    start: int
    end: int
    symbols: list[str] = field(default_factory=list)
    kind: str = "block"


BoundaryProvider = Callable[[list[str], str], list[Definition]]

# Node kinds that define something, what looks like them but doesn't, and calls that are tests.
DEFINES = r"(function|method|class|interface|struct|enum|trait|impl_item|mod_item|module|namespace|type_alias|type_declaration|type_item|constructor|record|singleton_method|rule_set|keyframes)"
DEFINES_NOT = r"(call|invocation|expression|parameter|argument|identifier|reference|modifier|body|signature_help)"
TEST_CALL = r"^(test|it|describe|suite|context|specify|bench)(\.\w+)*$"
# Fixed values, in this order: which part of a node kind gives which kind of chunk.
KINDS = (("interface", "interface"), ("class|record", "class"), ("method|constructor", "method"), ("function|arrow", "function"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("impl", "impl"), ("module|namespace|mod_item", "module"), ("rule_set|keyframes", "style"), ("type", "type"))


def definition_kind(node_type: Column) -> Column:
    out = F.when(F.lit(False), "")
    for part, kind in KINDS:
        out = out.when(node_type.rlike(part), kind)
    return out.otherwise("block")


def is_definition(node_type: Column) -> Column:
    return node_type.rlike(DEFINES) & ~node_type.rlike(DEFINES_NOT)


def is_test_call(name: Column) -> Column:
    return name.rlike(TEST_CALL)


# Signatures by family of languages: (pattern, kind, group of the name).
PYTHON = ((r"^\s*(?:async\s+)?def\s+(\w+)", "function"), (r"^\s*class\s+(\w+)", "class"))
RUBY = ((r"^\s*def\s+([\w.?!=]+)", "method"), (r"^\s*class\s+([\w:]+)", "class"), (r"^\s*module\s+([\w:]+)", "module"))
BRACES = (
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|abstract\s+|final\s+|sealed\s+|pub(?:\([^)]*\))?\s+|declare\s+|partial\s+)*(class|interface|struct|enum|trait|record|namespace|mod|impl)\s+(?:<[^>]*>\s*)?([\w.:<>]+)", None),
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"),
    (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*(?:fn|func)\s+(?:\([^)]*\)\s*)?(\w+)", "function"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", "function"),
    (r"^\s*([\w$]+(?:\.[\w$]+)+)\s*=\s*(?:async\s*)?(?:function\b|class\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", "member"),
    (r"^\s*((?:test|it|describe|suite|context|specify|bench)(?:\.\w+)*)\(", "test"),
    (r"^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=(?!=)", "variable"),
    (r"^\s*(?:(?:public|private|protected|internal|static|final|override|virtual|async|abstract|readonly|get|set)\s+)*(?:[\w<>\[\],.?*&:]+\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|do\b|new\b|throw\b|await\b)(\w+)\s*\([^;]*\)\s*(?::\s*[^={]+)?\{\s*$", "method"),
)
CLASSLIKE = {"class": "class", "record": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "namespace": "module", "mod": "module", "impl": "impl"}
IMPORTS = re.compile(r"^\s*(?:import|from\s+\S+\s+import|#include|use|using|require|package|const\s+.*=\s*require\()\b")
COMPILED: dict[str, list] = {k: [(re.compile(p), kind) for p, kind in v] for k, v in (("indent", PYTHON), ("ruby", RUBY), ("brace", BRACES))}


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _end_by_indent(lines: list[str], start: int, closing: bool) -> int:
    depth, end = _indent(lines[start]), start
    for i in range(start + 1, len(lines)):
        if not lines[i].strip():
            continue
        if _indent(lines[i]) <= depth:
            return i if closing and re.match(r"\s*(end\b|[)}\]])", lines[i]) and _indent(lines[i]) == depth else end
        end = i
    return end


def code_only(lines: list[str]) -> tuple[list[str], list[bool]]:
    """Each line without its strings and comments, and whether it begins in code: one pass with a stack of what is open (block comments, template literals, and code inside these). Quotes that don't close on their line are ordinary letters."""
    out, begins, stack = [], [], []  # a number counts the braces of code inside a template
    for line in lines:
        begins.append(not stack or isinstance(stack[-1], int))
        code, i = [], 0
        while i < len(line):
            c, two, top = line[i], line[i : i + 2], stack[-1] if stack else 0
            if top == "comment":
                i, stack = (i + 2, stack[:-1]) if two == "*/" else (i + 1, stack)
            elif top == "template":
                if c == "`":
                    stack.pop()
                elif two == "${":
                    stack.append(1)
                i += 2 if c == "\\" or two == "${" else 1
            elif two == "//":
                break
            elif two == "/*" or c == "`":
                stack.append("comment" if two == "/*" else "template")
                i += len(two) if two == "/*" else 1
            elif c in "'\"" and (m := QUOTED[c].match(line, i)):
                i = m.end()
            else:
                if stack and c in "{}":
                    stack[-1] += 1 if c == "{" else -1
                    if not stack[-1]:
                        stack.pop()
                        c = " "
                code.append(c)
                i += 1
        out.append("".join(code))
    return out, begins


QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\])*{q}") for q in "'\""}


def _end_by_braces(code: list[str], start: int) -> int:
    depth, seen = 0, False
    for i in range(start, len(code)):
        for c in code[i]:
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
        if seen and depth <= 0:
            return i
        if not seen and (code[i].rstrip().endswith(";") or i - start > 8):
            return i if code[i].rstrip().endswith(";") else start
    return len(code) - 1


def _end_of_statement(code: list[str], start: int) -> int:
    """Where brackets are closed and nothing asks for more."""
    depth = 0
    for i in range(start, len(code)):
        depth += sum(c in "([{" for c in code[i]) - sum(c in ")]}" for c in code[i])
        goes_on = re.search(r"[=+\-*/&|?:,.]\s*$", code[i]) or (i + 1 < len(code) and re.match(r"\s*[.?:&|+]", code[i + 1]))
        if depth <= 0 and not goes_on:
            return i
    return len(code) - 1


def _named(kind: str, m: re.Match, line: str) -> tuple[str, str]:
    """Name and kind of a match: tests are call and label, members what they are assigned to, without what exports them."""
    if kind == "test":
        label = re.compile(r"\s*(['\"`])((?:\\.|(?!\1).)*)\1").match(line, m.end())
        return (f'{m[1].split(".")[0]} "{label[2][:60]}"' if label and label[2] else m[1]), kind
    if kind == "member":
        return re.sub(r"^module\.exports\.?|^exports\.", "", m[1]) or "module.exports", "class" if "class" in line[m.start(1) + len(m[1]) : m.end()] else "function"
    return m[1], kind


def signature_boundaries(lines: list[str], language: str) -> list[Definition]:
    """Definitions by their signature lines. Their end follows from indentation (Python, Ruby) or braces; a decorator or comment right above belongs to them."""
    family = "indent" if language == "Python" else "ruby" if language == "Ruby" else "brace"
    out: list[Definition] = []
    open_: list[Definition] = []
    code, begins = code_only(lines) if family == "brace" else (lines, [True] * len(lines))
    for i, line in enumerate(lines):
        if not begins[i]:
            continue
        while open_ and open_[-1].end < i:
            open_.pop()
        for pattern, kind in COMPILED[family]:
            m = pattern.match(line)
            if not m:
                continue
            if kind == "method" and family == "brace" and not (open_ and open_[-1].kind in ("class", "interface", "impl", "struct", "trait")) and language in ("TypeScript", "JavaScript"):
                continue
            if kind == "variable" and (any(d.kind in ("function", "method", "test") for d in open_) or language not in ("TypeScript", "JavaScript")):
                continue  # locals have no name of their own
            name, what = (m[2], CLASSLIKE[m[1]]) if kind is None else _named(kind, m, line)
            if len(name) > 80:
                break
            end = _end_of_statement(code, i) if what == "variable" else _end_by_braces(code, i) if family == "brace" else _end_by_indent(lines, i, family == "ruby")
            start = i
            while start > 0 and re.match(r"\s*(@|#\[|//|/\*|\*|#(?!include))", lines[start - 1]) and _indent(lines[start - 1]) == _indent(line) and not any(d.start <= start - 1 <= d.end and d is not open_[-1] for d in out[-1:] if open_):
                start -= 1
            if what == "function" and open_ and open_[-1].kind == "class":
                what = "method"
            d = Definition(max(start, out[-1].end + 1 if out and out[-1].end < i and out[-1].end >= start else start), end, name, what, len(open_))
            out.append(d)
            open_.append(d)
            break
    return out


class Lines:
    """Sizes of line ranges, each line counted with its newline."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.at = [0]
        for line in self.lines:
            self.at.append(self.at[-1] + len(line) + 1)

    def size(self, a: int, b: int) -> int:
        return self.at[b + 1] - self.at[a]


def line_windows(lines: Lines, start: int, end: int, symbols: list[str], kind: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[Span]:
    """Windows that grow up to max_chars and max_lines; the next shares `overlap` lines, and begins a line later at least."""
    out, s = [], start
    while s <= end:
        e = s
        while e < end and lines.size(s, e + 1) <= max_chars and e + 1 - s < max_lines:
            e += 1
        out.append(Span(s, e, list(symbols), kind))
        if e >= end:
            return out
        s = max(e - overlap + 1, s + 1)
    return out


def heading_sections(lines: Lines) -> list[Span]:
    """Sections from heading to heading outside code fences; short ones join the one before, long ones become windows."""
    marks, fenced = [], False
    for i, line in enumerate(lines.lines):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        if not fenced and (m := re.match(r"#{1,6}\s+(.+)", line)):
            marks.append((i, m[1].strip()[:80]))
    if not marks or marks[0][0] > 0:
        marks.insert(0, (0, ""))
    out: list[Span] = []
    for (a, name), b in zip(marks, [m[0] - 1 for m in marks[1:]] + [len(lines.lines) - 1], strict=True):
        if out and lines.size(out[-1].start, b) <= 2 * MIN_CHARS:
            out[-1].end = b
            continue
        symbols = [name] if name else []
        out += line_windows(lines, a, b, symbols, "section") if lines.size(a, b) > MAX_CHARS else [Span(a, b, symbols, "section")]
    return out


def _qualified(d: Definition, above: list[str]) -> str:
    return " › ".join([*above[-1:], d.name]) if d.kind == "test" else ".".join([*above, d.name])


#: A line that only ends a definition.
CLOSES = re.compile(r"\s*([\])}]+[;,]?|end)\s*$")
#: What a piece may grow to, in whole chunks, to keep its definition's first and last lines.
EDGE = 1.3


def _with_edges(lines: Lines, pieces: list[Span], start: int, end: int, name: str) -> list[Span]:
    """The pieces of a definition with its signature before the first and its closing line after the last; where a piece would grow too much they are pieces of their own."""
    if not pieces:
        return pieces
    first, last = pieces[0], pieces[-1]
    before, after = (start, first.start - 1), (last.end + 1, end)
    fits = lines.size(start, first.end) <= EDGE * MAX_CHARS
    if fits:
        first.start = start
    out = pieces if fits or before[0] > before[1] else [Span(*before, [name], "block"), *pieces]
    if lines.size(last.start, end) <= EDGE * MAX_CHARS:
        last.end = end
    elif after[0] <= after[1]:
        out = [*out, Span(*after, [name], "block")]
    return out


def definition_spans(lines: Lines, defs: list[Definition], start: int, end: int, above: list[str], depth: int = 0) -> list[Span]:
    """Spans of lines start..end: definitions at this depth, and what lies between them. Small neighbours join, large definitions are split along theirs."""
    own = [d for d in defs if d.depth == depth and start <= d.start and d.end <= end]
    items: list[tuple[int, int, Definition | None]] = []
    at = start
    for d in own:
        if d.start > at:
            items.append((at, d.start - 1, None))
        if d.end >= at:
            items.append((max(at, d.start), d.end, d))
            at = d.end + 1
    if at <= end:
        items.append((at, end, None))
    out: list[Span] = []
    group: Span | None = None
    big = False
    for a, b, d in items:
        if d is None and not any(x.strip() for x in lines.lines[a : b + 1]):
            continue
        size, name = lines.size(a, b), _qualified(d, above) if d else None
        if size > MAX_CHARS:
            if group:
                out.append(group)
                group = None
            inner = [x for x in defs if d and x.depth == depth + 1 and d.start < x.start and x.end <= d.end]
            if d and inner:
                closing = b - 1 if CLOSES.match(lines.lines[b]) else b
                subs = definition_spans(lines, defs, a + 1, closing, [*above, d.name], depth + 1)
                subs = _with_edges(lines, subs, a, b, name)
            else:
                subs = line_windows(lines, a, b, [name] if name else above[-1:], d.kind if d else "block")
            for s in subs:
                s.symbols = s.symbols or ([name] if name else [])
                s.kind = d.kind if d and s.kind == "block" else s.kind
            out += subs
            continue
        if group and lines.size(group.start, b) <= MAX_CHARS and (lines.size(group.start, group.end) < MIN_CHARS or (size < MIN_CHARS and not big)):
            group.end = b
            if name:
                group.symbols.append(name)
                group.kind = d.kind if group.kind in ("block", "imports") else group.kind
            big = big or (d is not None and size >= MIN_CHARS)
            continue
        if group:
            out.append(group)
        first = next((x for x in lines.lines[a : b + 1] if x.strip()), "")
        group = Span(a, b, [name] if name else [], d.kind if d else "imports" if IMPORTS.match(first) else "block")
        big = d is not None and size >= MIN_CHARS
    return out + ([group] if group else [])


def fold_slivers(spans: list[Span], lines: Lines) -> list[Span]:
    """A sliver joins the span before it (or is joined by the next) if both together stay small enough."""
    out: list[Span] = []
    for s in spans:
        p = out[-1] if out else None
        if p and s.start <= p.end + 2 and min(lines.size(p.start, p.end), lines.size(s.start, s.end)) < MIN_CHARS / 2 and lines.size(p.start, max(p.end, s.end)) <= MAX_CHARS:
            p.end = max(p.end, s.end)
            p.symbols += s.symbols
            p.kind = s.kind if p.kind in ("block", "imports") else p.kind
        else:
            out.append(Span(s.start, s.end, list(s.symbols), s.kind))
    return out


def finalize(spans: list[Span], lines: Lines, most: int | None = None) -> list[tuple[int, int, str | None, str, str]]:
    """(start line, end line, symbol, kind, content) of all chunks, or of the first `most`: blank edges trimmed, nearly empty ones dropped."""
    out = []
    for s in fold_slivers(spans, lines):
        a, b = s.start, s.end
        while a < b and not lines.lines[a].strip():
            a += 1
        while b > a and not lines.lines[b].strip():
            b -= 1
        content = "\n".join(lines.lines[a : b + 1])
        if len(content.strip()) < 25:
            continue
        names = list(dict.fromkeys(s.symbols))
        more = f" +{len(names) - 3}" if len(names) > 3 else ""
        out.append((a + 1, b + 1, (", ".join(names[:3]) + more)[:160] or None, s.kind, content))
        if len(out) == most:
            break
    return out


def chunk_text(text: str, language: str, strategy: str, provider: BoundaryProvider = signature_boundaries, most: int | None = None) -> list[tuple[int, int, str | None, str, str]]:
    text = re.sub(r"\r\n?", "\n", text)
    lines = Lines(text)
    last = len(lines.lines) - 1
    if strategy == "markdown":
        return finalize(heading_sections(lines), lines, most)
    if len(text) <= MAX_CHARS:
        return finalize([Span(0, last, [], "file")], lines, most)
    if strategy == "ast":
        defs = provider(lines.lines, language)
        if defs:
            return finalize(definition_spans(lines, defs, 0, last, []), lines, most)
    return finalize(line_windows(lines, 0, last, [], "block"), lines, most)


CHUNKS = "repo_id string, path string, language string, start_line int, end_line int, symbol string, kind string, content string"


def chunk_files(files: DataFrame, provider: BoundaryProvider = signature_boundaries, most: int | None = None) -> DataFrame:
    """(id, repo_id, path, language, start_line, end_line, symbol, kind, content) of admitted files (repo_id, path, language, strategy, content): whole files, or the first `most` chunks of each (MAX_CHUNKS is the usual limit). The id follows from repo, path and lines, so that runs agree. Markdown, short files and files without a grammar are cut by column expressions; only long files with a grammar go to Python, for their definitions."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        for pdf in batches:
            rows = [(r.repo_id, r.path, r.language, *c) for r in pdf.itertuples() if r.content for c in chunk_text(r.content, r.language, r.strategy, provider, most)]
            yield pd.DataFrame(rows, columns=names)

    files = files.select(F.col("repo_id").cast("string"), "path", "language", "strategy", "content")
    defines = (F.col("strategy") == "ast") & (F.char_length(F.regexp_replace("content", "\r\n?", "\n")) > MAX_CHARS)
    plain = plain_chunks(files.where(~F.coalesce(defines, F.lit(False))), MAX_CHARS, MIN_CHARS, MAX_LINES, OVERLAP, most)
    out = files.where(defines).mapInPandas(cut, CHUNKS).unionByName(plain)
    return out.select(F.xxhash64("repo_id", "path", "start_line", "end_line").alias("id"), "*")


def line_table(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, text, at): lines from 0 with the offset of their first character."""
    rows = files.select("repo_id", "path", F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("ls"))
    flat = rows.select("repo_id", "path", F.posexplode("ls").alias("line", "text"))
    w = Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return flat.select("repo_id", "path", "line", "text", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long").alias("at"))


def heading_table(files: DataFrame) -> DataFrame:
    """(repo_id, path, section, start_line, lines, heading): heading sections before any merging, by running counts of fences and headings."""
    lines = line_table(files)
    w = Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.sum(F.when(F.col("text").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)).over(w) % 2
    lines = lines.withColumn("fenced", fence)
    is_head = (F.col("fenced") == 0) & F.col("text").rlike(r"^#{1,6}\s+.+")
    lines = lines.withColumn("section", F.sum(F.when(is_head, 1).otherwise(0)).over(w))
    heading = F.left(F.trim(F.regexp_extract("text", r"^#{1,6}\s+(.+)", 1)), F.lit(80))
    return lines.groupBy("repo_id", "path", "section").agg(F.min("line").alias("start_line"), F.count("*").alias("lines"), F.nullif(F.min_by(heading, "line"), F.lit("")).alias("heading"))
