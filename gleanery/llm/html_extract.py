"""Main text of web pages: structure says what a block is, suffix arrays over the pages of a host say what repeats.

Each page becomes blocks of visible text. The pages of a host meet in groups; the token streams of a group's distinct
pages are concatenated and their suffixes sorted in full by prefix doubling. Neighbours in that order with 8 or more
tokens in common are strings that repeat; of each, the pages with different content are counted, and the counts of a
host's groups are added up. What then repeats on enough of the host's pages is boilerplate: blocks that it covers go,
blocks of unique text stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PAGES, TOKENS = 200, 8
TAG_NAME, CLOSE, QUOTE = re.compile(r"(/?)([a-zA-Z][^\s/>]*)"), {'"': '"', "'": "'"}, re.compile(r"[>\"']")
#: Elements whose content is no markup; its end tag alone ends it.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
DROPPED = {"aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "input", "menu", "nav", "noscript", "object", "select", "svg", "template", "video", "audio", "map"}
#: What the start of an element ends, if that is what is open.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of class names and ids that mark what is no article text, those of reader comments, and parts that may stand beside them.
MARKS = set("ad ads advert advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs consent contentinfo cookie cookies cookiebar footer gdpr menu menubar modal nav navbar navigation navi newsletter notice overlay pager pagination paywall popup promo promotion promoted recommended related search share sharing sidebar sidenav skip social sponsor sponsored subscribe subscription tagcloud tags toolbar widget widgets".split())
HEADERS = {"header", "masthead", "topbar"}
COMMENTS = set("comment comments commentlist disqus replies respond responses".split())
BESIDE = set("site page main left right top bottom list box bar area section block item items link links primary secondary global sticky fixed floating mobile desktop container wrap wrapper outer inner row col column panel button buttons icon icons form signup sign up text message heading title reader user the your sub mini js post posts entry article articles story stories thread count id".split())
ROLES = {"banner": 1, "navigation": 1, "contentinfo": 1, "search": 1, "complementary": 1, "dialog": 1, "alertdialog": 1, "menu": 1, "menubar": 1, "toolbar": 1, "form": 1}
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([a-zA-Z-]+)""")
HUGE_REF = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{8,});?")
ARTICLE, NEUTRAL = 1, 0
#: What structure and attributes say of an element: nothing, never article text, no article text unless it holds most of the page, site header, reader comments.
NOTHING, HARD, WEAK, HEADER, COMMENT = range(5)


@lru_cache(4096)
def _named(value: str) -> int:
    """What a class or id says. Each of its names counts as a whole: all parts of it must be known, so that `has-comments` or `content-sidebar-wrap` mark nothing."""
    kind = NOTHING
    for name in value.split():
        parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-")
        parts = {p for p in parts if p and not p.isdigit() and len(p) > 1}
        if not parts or not parts <= MARKS | HEADERS | COMMENTS | BESIDE:
            continue
        if parts & COMMENTS:
            return COMMENT
        if parts & MARKS:
            kind = WEAK
        elif parts & HEADERS and not parts & {"post", "entry", "article", "story", "section"}:
            kind = kind or HEADER
    return kind


def _marked(attrs: str) -> int:
    """What the attributes of an element say."""
    kind = NOTHING
    if "=" not in attrs and "hidden" not in attrs.lower():
        return kind
    for key, value, bare in ATTR.findall(attrs):
        key, value = (key or bare).lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return HARD
        if key in ("class", "id") and len(value) < 1000:
            kind = max(kind, _named(value))
        elif key == "role" and value.lower() in ROLES:
            kind = max(kind, WEAK)
    return kind


def _references(text: str) -> str:
    return unescape(HUGE_REF.sub("�", text)) if "&" in text else text


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, ""), in one pass: an unclosed quote or tag never makes later ones be scanned again."""
    at, n, quotes, unclosed = 0, len(html), True, set()
    last = html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", lt):
            end = html.find("]]>", lt + 9)
            yield "text", html[lt + 9 : n if end < 0 else end].replace("&", "&amp;"), ""
            at = n if end < 0 else end + 3
            continue
        if lt > last:  # nothing from here on can be a tag
            cut = html.find("<!--", lt)
            yield "text", html[lt : n if cut < 0 else cut], ""
            return
        if html[lt + 1 : lt + 2] in ("!", "?"):
            at = html.find(">", lt) + 1
            continue
        m = TAG_NAME.match(html, lt + 1)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        pos, end = m.end(), -1
        while quotes:
            q = QUOTE.search(html, pos)
            if q and q[0] == ">":
                end = q.start()
                break
            pos = html.find(CLOSE[q[0]], q.end()) + 1 if q else 0
            if not pos:  # the quoting is broken from here on
                quotes = False
        if end < 0:
            end = html.find(">", m.end())
        name, attrs = m[2].lower(), html[m.end() : end]
        at = end + 1
        if m[1]:
            yield "end", name, ""
        elif name not in RAW:
            yield "start", name, attrs
        elif name not in unclosed:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            if close:
                at = close.start()
            elif name in ("script", "style"):
                return
            else:
                unclosed.add(name)


def blocks(html: str) -> list[tuple[int, int, str]]:
    """The blocks of visible text that structure doesn't rule out: (whether inside an article or main element, characters inside links, text). If any block is inside an article, the others are left out."""
    parent, kind, is_article, closed, size = [0], [NOTHING], [False], [True], [0]
    stack, open_, names = [0], defaultdict(list), [""]  # open elements, and by name their places in the stack
    events: list[tuple[int, str | None, bool]] = []
    links = False

    def pop(k: int) -> None:
        while len(stack) > k:
            open_[names[stack.pop()]].pop()

    for what, name, attrs in tokens(html):
        if what == "text":
            events.append((stack[-1], name, links))
            size[stack[-1]] += len(name)
            continue
        if name in BLOCKS:
            events.append((0, None, False))
        if name == "a":
            links = what == "start"
        if what == "end":
            if open_[name]:
                closed[stack[open_[name][-1]]] = True
                pop(open_[name][-1])
            continue
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        if name == "body":
            pop(1)
        if name in BLOCKS and names[stack[-1]] == "p":
            pop(len(stack) - 1)
        while names[stack[-1]] in ENDS.get(name, ()):
            pop(len(stack) - 1)
        mark = NOTHING if name in ("html", "body", "main") else HARD if name in DROPPED else _marked(attrs)
        if name == "header" and mark == NOTHING:
            mark = HEADER
        if mark or name in BLOCKS:
            open_[name].append(len(stack))
            parent.append(stack[-1])
            stack.append(len(names))
            names.append(name)
            kind.append(mark)
            is_article.append(name in ("article", "main") and mark not in (HARD, COMMENT))
            closed.append(False)
            size.append(0)
    # sizes and articles of whole elements: children come after their parents. What is never article text counts for no one else.
    holds, n = list(is_article), len(names)
    for e in range(n - 1, 0, -1):
        hard = kind[e] == HARD and (closed[e] or not holds[e])
        if not hard:
            size[parent[e]] += size[e]
        if holds[e] and not hard and kind[e] != COMMENT:
            holds[parent[e]] = True
    total = size[0]
    gone, inside = [False] * n, [False] * n
    for e in range(1, n):
        up, k = parent[e], kind[e]
        most = 2 * size[e] > total
        drop = (
            (k == HARD and (closed[e] or not holds[e])) or (k == WEAK and not holds[e] and not (most and not inside[up])) or (k == COMMENT and size[e] < total)
            or (k == HEADER and not inside[up] and not holds[e] and not most)
        )
        gone[e] = gone[up] or drop
        inside[e] = not gone[e] and (inside[up] or is_article[e])
    out: list[tuple[int, int, str]] = []
    text, linked, article = [], 0, NEUTRAL
    for e, piece, link in [*events, (0, None, False)]:
        if piece is None:
            if text and (t := " ".join("".join(text).split())):
                out.append((article, linked, t))
            text, linked, article = [], 0, NEUTRAL
        elif not gone[e]:
            piece = _references(piece)
            text.append(piece)
            linked += len(piece) if link else 0
            article = ARTICLE if inside[e] else article
    return [b for b in out if b[0] == ARTICLE] or out


def pack_blocks(found: list[tuple[int, int, str]]) -> bytes:
    return "\n".join(f"{k}\t{n}\t{t}" for k, n, t in found).encode("utf-8", "surrogatepass")


def unpack_blocks(data: bytes) -> list[tuple[int, int, str]]:
    rows = (x.split("\t", 2) for x in data.decode("utf-8", "surrogatepass").split("\n")) if data else ()
    return [(int(k), int(n), t) for k, n, t in rows]


def longest(found: list[tuple[int, int, str]]) -> int:
    """Which block is a page's content, if one is: the longest that is not mostly links."""
    return max(range(len(found)), key=lambda i: (2 * found[i][1] <= len(found[i][2]), len(found[i][2])), default=-1)


def content_key(found: list[tuple[int, int, str]]) -> int:
    """Pages with equal keys have the same content, and what they share says nothing of boilerplate."""
    return xxhash.xxh3_64_intdigest(found[longest(found)][2].encode("utf-8", "surrogatepass")) if found else 0


def stream(pages: list[list[tuple[int, int, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token hashes of all pages, each block's tokens after a mark (0); each token's block, counted over all pages, and its page."""
    texts = [t for p in pages for _, _, t in p]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    words, row, _ = C.words_of(np.frombuffer(b"".join(raw), np.uint8), at, lower=False)
    page_of = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    block = np.concatenate([np.arange(len(texts)), row])
    order = np.argsort(block, kind="stable")
    return np.concatenate([np.zeros(len(texts), np.uint64), words])[order], block[order], page_of[block[order]] if len(texts) else block


def strings(tokens_: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of TOKENS tokens that begin at each place, and whether such a string is within its page."""
    n = len(tokens_)
    h = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n >= TOKENS:
        m = n - TOKENS + 1
        for j in range(TOKENS):
            h[:m] = C.mix(h[:m] * C.U64(0x9E3779B97F4A7C15) + tokens_[j : j + m])
        ok[:m] = page[:m] == page[TOKENS - 1 :]
    return h, ok


def suffix_array(tokens_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of tokens_ in full order by prefix doubling, and of each the length that it has in common with the one before. Only suffixes that still tie are sorted again; the ranks of each doubling give the common lengths."""
    n = len(tokens_)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens_, return_inverse=True)[1].astype(np.int32)
    order = np.argsort(rank, kind="stable")
    start = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0)).astype(np.int32)  # a group's rank is its first place
    levels, step = [rank.copy()], 1
    while step < n:
        size = np.bincount(rank, minlength=n)
        act = np.flatnonzero(size[rank] > 1)
        if not len(act):
            break
        ahead = np.where(act + step < n, rank[np.minimum(act + step, n - 1)], -1)
        by = np.lexsort((ahead, rank[act]))
        act, ahead, own = act[by], ahead[by], rank[act][by]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        place = own + np.arange(len(act)) - np.maximum.accumulate(np.where(first, np.arange(len(act)), 0))
        order[place] = act
        new = first.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        rank[act] = place[np.maximum.accumulate(np.where(new, np.arange(len(act)), 0))]
        levels.append(rank.copy())
        step *= 2
    common = np.zeros(n, np.int64)
    x, y = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(x, y) + (1 << k) <= n
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        x, y = x + (same << k), y + (same << k)
    common[1:] = x - order[:-1]
    return order, common


def repeats(pages: list[list[tuple[int, int, str]]], contents: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of TOKENS tokens that stand on pages of two contents and more: their hashes and on how many contents."""
    tokens_, _, page = stream(pages)
    if not len(tokens_):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    content = np.unique(np.array(contents, np.uint64), return_inverse=True)[1][page]
    ends = np.flatnonzero(np.concatenate([page[1:] != page[:-1], [True]]))
    # after each page a token unlike any other, so that no string crosses pages
    parted = np.insert(np.unique(tokens_, return_inverse=True)[1] + len(pages), ends + 1, np.arange(len(ends)))
    was = np.insert(np.arange(len(tokens_)), ends + 1, -1)
    order, common = suffix_array(parted)
    cls = np.cumsum(common < TOKENS)  # neighbours with that much in common are one repeated string
    real = was[order] >= 0
    order, cls = order[real], cls[real]
    pair = np.unique(cls * (int(content.max()) + 1) + content[was[order]])
    count = np.bincount(pair // (int(content.max()) + 1), minlength=int(cls.max()) + 1)
    head = np.unique(cls, return_index=True)[1]
    hashes, ok = strings(tokens_, page)
    at = was[order[head]]
    some = (count[cls[head]] > 1) & ok[at]
    return hashes[at[some]], count[cls[head]][some]


def kept(pages: list[list[tuple[int, int, str]]], hashes: np.ndarray, counts: np.ndarray, total: int) -> list[str]:
    """The texts of some pages of a host. hashes (sorted) and counts: its repeated strings; total: its different contents.

    A token is covered by a string that stands on at least `several` contents, or on most. In an article only what most
    contents share goes, and only from pages of which it is the smaller part. Elsewhere, blocks that are half covered or
    mostly links go; but a page nearly all covered is a copy of others and loses only what most contents share. The
    longest block always stays."""
    tokens_, block, page = stream(pages)
    flat = [b for p in pages for b in p]
    several, common = max(3, -(-total // 10)), max(10, -(-total // 2))
    h, ok = strings(tokens_, page)
    at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
    found = np.where(ok & (hashes[at] == h), counts[at], 0) if len(hashes) else np.zeros(len(h), np.int64)
    most = found.copy()
    for k in range(1, min(TOKENS, len(h))):  # a token is covered by the strings that begin up to TOKENS - 1 before it
        most[k:] = np.maximum(most[k:], found[:-k])
    word = tokens_ != 0
    size = np.bincount(block, weights=word, minlength=len(flat))
    some, much = (np.bincount(block, weights=word & (most >= k), minlength=len(flat)) for k in (several, common))
    out, i = [], 0
    for p in pages:
        j = i + len(p)
        plain = [k for k in range(i, j) if flat[k][0] == ARTICLE or 2 * flat[k][1] <= len(flat[k][2])]
        all_ = max(size[plain].sum(), 1)
        copy_ = some[plain].sum() > 0.8 * all_
        notices = much[plain].sum() <= 0.5 * all_
        stays = i + longest(p)
        keep = []
        for k in plain:
            if flat[k][0] == ARTICLE:
                gone = notices and much[k] >= 0.9 * size[k]
            else:
                gone = much[k] >= 0.5 * size[k] if copy_ else some[k] >= 0.5 * size[k]
            if not gone or k == stays:
                keep.append(flat[k][2])
        out.append("\n".join(keep))
        i = j
    return out


def _decoded(column: pa.Array) -> list[str]:
    return [(h or b"").decode(errors="replace") for h in column.cast(pa.binary()).to_pylist()]


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host, its different pages: (h, deal, content, blocks), dealt by content. A task sends equal pages once."""
    press, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = []
            for h, n, html in zip(part.column("h").to_pylist(), part.column("n").to_pylist(), _decoded(part.column("html")), strict=True):
                if found := blocks(html):
                    packed = pack_blocks(found)
                    if (key := (h, xxhash.xxh3_128_digest(packed))) not in seen:
                        seen.add(key)
                        content = content_key(found)
                        rows.append((h, content % n, content - (1 << 63), press.compress(packed)))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["h", "deal", "content", "blocks"])


def _pages(table: pa.Table) -> tuple[list[list[tuple[int, int, str]]], list[int]]:
    """The different pages of a group and their contents."""
    unpress, once = zstandard.ZstdDecompressor(), {}
    for content, packed in zip(table.column("content").to_pylist(), table.column("blocks").to_pylist(), strict=True):
        raw = unpress.decompress(packed)
        once.setdefault(xxhash.xxh3_128_digest(raw), (content + (1 << 63), raw))
    order = sorted(once)
    return [unpack_blocks(once[k][1]) for k in order], [once[k][0] for k in order]


def _counts(h: int, strings_: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"h": pa.array(np.full(len(n), h), pa.int64()), "string": pa.array(strings_.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})


def _repeats(table: pa.Table) -> pa.Table:
    """Rows (h, string, n) of a group, and one with a null string and the number of its contents."""
    pages, contents = _pages(table)
    h = table.column("h")[0].as_py()
    head = pa.table({"h": pa.array([h], pa.int64()), "string": pa.array([None], pa.int64()), "n": pa.array([len(set(contents))], pa.int64())})
    return pa.concat_tables([head, _counts(h, *repeats(pages, contents))])


def _recounted(table: pa.Table, asked: pa.Table) -> pa.Table:
    """On how many contents of a group the strings stand that its host asks for."""
    none = np.zeros(0, np.int64)
    if not table.num_rows or not asked.num_rows:
        return _counts(0, none, none)
    pages, contents = _pages(table)
    tokens_, _, page = stream(pages)
    content = np.unique(np.array(contents, np.uint64), return_inverse=True)[1][page]
    hashes, ok = strings(tokens_, page)
    want = np.unique(asked.column("string").to_numpy().view(np.uint64))
    at = np.minimum(np.searchsorted(want, hashes), len(want) - 1)
    hit = ok & (want[at] == hashes)
    width = int(content.max(initial=0)) + 1
    found, n = np.unique(np.unique(at[hit] * width + content[hit]) // width, return_counts=True)
    return _counts(table.column("h")[0].as_py(), want[found], n)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            made = [press.compress(pack_blocks(blocks(html))) for html in _decoded(part.column("html"))]
            yield pa.record_batch([part.column(c) for c in ("h", "deal", "page_id", "url")] + [pa.array(made, pa.binary())], ["h", "deal", "page_id", "url", "blocks"])


def _texts(pages: pa.Table, shared: pa.Table) -> pa.Table:
    if not pages.num_rows:
        return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())})
    unpress = zstandard.ZstdDecompressor()
    strings_, n = shared.column("string").to_numpy().view(np.uint64), shared.column("n").to_numpy()
    order = np.argsort(strings_, kind="stable")
    total = int(shared.column("total")[0].as_py()) if shared.num_rows else 1
    texts = kept([unpack_blocks(unpress.decompress(b)) for b in pages.column("blocks").to_pylist()], strings_[order], n[order], total)
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks joined by newlines, empty if none), n_chars.

    Dropped by structure: scripts, styles, hidden elements, menus, headers, footers, sidebars, notices, adverts, forms
    and comments, by element or by whole names in class, id and role; an element marked so only by a name stays if it
    holds the article or most of the page's text. A page with an article or main element gives only that; of one
    without, blocks that are mostly links go too. Then boilerplate goes, as kept() says: strings of 8 tokens and more
    that repeat on at least 3 pages of different content and a tenth of the host's (in articles: 10 and half of them).
    Pages count as different if their longest blocks differ, so copies of a page never make each other boilerplate.

    A host's pages are dealt into groups of about `group`, by content for counting and by id for the result; counts
    are added up over a host's groups, so that all its pages are judged alike and the size of groups doesn't matter (a
    string on more contents than the host has groups stands twice in one of them). Null html is empty; null urls are one
    host; repeated rows each get the same text; other columns don't matter. Very long pages take linear time.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = C.spread(rows.withColumn("h", F.xxhash64(host)))
    sizes = C.materialize(rows.groupBy("h").agg(F.ceil(F.count("*") / group).alias("n")))
    dealt = rows.join(C.small(sizes), "h")
    contents = dealt.select("h", "n", "html").mapInArrow(C.mapped(_contents), "h long, deal long, content long, blocks binary")
    counted = contents.groupBy("h", "deal").applyInArrow(C.grouped(_repeats), "h long, string long, n long")
    sums = C.materialize(counted.groupBy("h", "string").agg(F.sum("n").alias("n"), F.count("*").alias("seen")))
    totals = sums.where("string is null").select("h", F.col("n").alias("total")).join(sizes.withColumnRenamed("n", "groups"), "h")
    enough = F.greatest(F.lit(3), F.ceil(F.col("total") / 10))
    found = sums.where("string is not null").join(totals, "h")
    everywhere = lambda df: df.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("deal"), "string", "n", "total")
    if sizes.where("n > 1").take(1):
        # a group says nothing of strings that only one of its contents has; where that could matter, they are counted again
        most, common = F.col("n") + F.col("groups") - F.col("seen"), F.greatest(F.lit(10), F.ceil(F.col("total") / 2))
        open_ = ((F.col("n") < enough) & (most >= enough)) | ((F.col("n") < common) & (most >= common))
        asked = C.materialize(found.where(open_))
        if asked.take(1):
            again = contents.groupBy("h", "deal").cogroup(everywhere(asked).groupBy("h", "deal")).applyInArrow(C.cogrouped(_recounted), "h long, string long, n long")
            again = C.materialize(again.groupBy("h", "string").agg(F.sum("n").alias("n"))).join(totals, "h")
            found = found.where(~open_).drop("seen").unionByName(again)
    shared = everywhere(found.where(F.col("n") >= enough))
    parsed = dealt.select("h", F.pmod(F.xxhash64("page_id", "url"), F.col("n")).alias("deal"), "page_id", "url", "html").mapInArrow(C.mapped(_parsed), "h long, deal long, page_id long, url string, blocks binary")
    # a group without pages has no rows; one without shared strings has pages only
    return parsed.groupBy("h", "deal").cogroup(shared.groupBy("h", "deal")).applyInArrow(C.cogrouped(_texts), "page_id long, url string, text string, n_chars long")
