"""Exact substring deduplication by hash-compared suffix sorting.

Every string of `length` bytes holds a minimizer (the k-gram of least hash), so equal strings meet under an equal
k-gram, at an equal offset. Three passes, all dealt out by Spark:

1. Each task cuts its texts into runs of window starts that share a minimizer. Of runs with equal bytes only the first
   goes on: in the task by hash and then byte for byte, between tasks by k-gram bucket and 128 bits of hashes. What
   remains under a k-gram are contexts that differ.
2. Only those fetch their bytes. Each bucket sorts the suffixes (and reversed prefixes) at the k-gram: a mergesort
   whose comparisons find the common extension by binary search over prefix polynomial hashes; the order and all
   common lengths are then verified on the bytes, and re-sorted by bytes should a hash have collided. A window is
   the pair (left part, right part), and its class follows from the two sorted orders.
3. Covered intervals meet their texts again and are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
RUN = {"key": "<u4", "c1": "<u8", "c2": "<u4", "doc_lo": "<u4", "doc_hi": "<i4", "row": "<i8", "s_lo": "<u2", "s_hi": "<u2", "n": "u1", "p": "u1"}
MARK = {"doc": "<i8", "row": "<i8", "s": "<u4", "n": "<u4", "p": "u1", "kind": "u1"}
ITEM = {"key": "<u8", "doc": "<i8", "row": "<i8", "s": "<u4", "n": "u1", "p": "u1"}
COVERED, ASKED, HOT = 0, 1, 2
#: A k-gram with more differing contexts than this is split by the strings that neighbouring windows share.
MANY, SUB = 64, 8
#: Longer texts are cut into runs piece by piece.
PIECE = 1 << 20


def prime(n: int) -> int:
    """The least prime of at least n, so that ids in steps still spread over that many buckets."""
    n = max(n, 3) | 1
    while any(n % k == 0 for k in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def runs(data: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The runs of window starts of all rows: row, s (start in data), n (windows), p (offset of the k-gram from s), key, c1, c2 (hashes of k-gram and context)."""
    k = max(8, length // 4)
    w, n = length - k + 1, len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return {"row": z, "s": z, "n": z, "p": z, "key": z.view(np.uint64), "c1": z.view(np.uint64), "c2": z.view(np.uint64)}
    h = C.POLY.prefixes(data)
    i = np.arange(n - k + 1)
    grams = C.mix(C.POLY.of(h, i, i + k))
    least = (grams >> U64(28) << U64(28)) | i.astype(np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: -(w - span)], least[w - span :])
    where = (least & U64((1 << 28) - 1)).astype(np.int64)
    del least, i
    starts = np.flatnonzero(np.repeat(at[1:], np.diff(at))[: n - length + 1] - np.arange(n - length + 1) >= length)
    where = where[starts]
    new = np.flatnonzero((np.diff(where) != 0) | (np.diff(starts) != 1)) + 1
    a, b = np.concatenate([[0], new]), np.concatenate([new, [len(starts)]]) - 1
    if not len(starts):
        a = b = np.zeros(0, np.int64)
    lo, hi, p = starts[a], starts[b], where[a]
    size = (hi + length - lo).astype(np.uint64)
    h2 = C.POLY2.prefixes(data)
    return {"row": np.searchsorted(at, lo, "right") - 1, "s": lo, "n": hi - lo + 1, "p": p - lo, "key": grams[p], "c1": C.mix(C.POLY.of(h, lo, hi + length) + size), "c2": C.mix(C.POLY2.of(h2, lo, hi + length) + size)}


def later(keys: list[np.ndarray], doc: np.ndarray, row: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items with equal keys: (first in its class, stands later than the first, which the first is). Items at one (doc, row, s) are the same and neither is later."""
    order = np.lexsort((s, row, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    for k in keys:
        new[1:] &= k[order][1:] == k[order][:-1]
    new[1:] = ~new[1:]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return first, (doc[head] != doc) | (row[head] != row) | (s[head] != s), head


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] are equal."""
    out, ends = np.ones(len(a), bool), np.concatenate([[0], np.cumsum(size)])
    for i, j in C.slices(ends):
        n = size[i:j]
        differ = data[_ranges(a[i:j], n)] != data[_ranges(b[i:j], n)]
        out[i:j] = np.add.reduceat(differ, ends[i:j] - ends[i]) == 0
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `row`: 0, but for ids with several texts a hash of the text, so that each of these is a document of its own. Only ids and hashes are shuffled to find them."""
    h = F.xxhash64("text")
    several = C.materialize(rows.groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("b")).where("a != b").select("doc_id", F.lit(True).alias("several")))
    zero = F.lit(0).cast("long")
    if not several.take(1):
        return rows.withColumn("row", zero)
    return rows.join(C.small(several), "doc_id", "left").withColumn("row", F.when(F.col("several"), h).otherwise(zero)).drop("several")


def _marks(out_of: int, base: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    cols = {k: columns[k].astype(t) for k, t in MARK.items()}
    yield from C.bucketed(base + (cols["doc"] ^ cols["row"]) % out_of, cols)


def rows_of(texts: pa.Table, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the texts' and the marks' (doc_id, row), equal where those are."""
    n = texts.num_rows
    pair = np.empty(n + len(m["doc"]), [("doc", "<i8"), ("row", "<i8")])
    pair["doc"], pair["row"] = (np.concatenate([texts.column(t).to_numpy() if n else np.zeros(0, np.int64), m[c]]) for t, c in (("doc_id", "doc"), ("row", "row")))
    which = np.unique(pair, return_inverse=True)[1]
    return which[:n], which[n:]


def _cut_pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[dict[str, np.ndarray]]:
    """runs() of all rows, slice by slice; s is the start in data. A long row is cut where only runs end."""
    for i, j in C.slices(at, PIECE):
        for lo in range(int(at[i]), int(at[j]), PIECE) if j == i + 1 else [int(at[i])]:
            hi = min(lo + PIECE + length - 1, int(at[j])) if j == i + 1 else int(at[j])
            r = runs(data[lo:hi], at[i : j + 1] - lo if j > i + 1 else np.array([0, hi - lo]), length)
            yield r | {"row": r["row"] + i, "s": r["s"] + lo}


def _cut(batches: Iterator[pa.RecordBatch], length: int, parts: int, many: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column("text"))
        ids, numbers = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
        got = []
        for r in _cut_pieces(data, at, length):
            k = r["row"]
            got.append({"doc": ids[k], "row": numbers[k], "from": r["s"], "s": r["s"] - at[k]} | {c: r[c] for c in ("n", "p", "key", "c1", "c2")})
        if not got:
            continue
        r = {k: np.concatenate([x[k] for x in got]) for k in got[0]}
        order = np.argsort(r["c1"], kind="stable")
        same = r["c1"][order][1:] == r["c1"][order][:-1]
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        t = np.flatnonzero(twice)
        first, after, head = later([r[c][t] for c in ("key", "c1", "c2")], r["doc"][t], r["row"][t], r["s"][t])
        after = np.flatnonzero(after)
        gone, of = t[after], t[head[after]]
        equal = same_bytes(data, r["from"][gone], r["from"][of], r["n"][gone] - 1 + length)
        r["c2"][gone[~equal]] ^= U64(1)  # a hash collided: the second pass will have the bytes of both
        first[after[~equal]] = True
        gone = gone[equal]
        yield from _marks(parts, parts, doc=r["doc"][gone], row=r["row"][gone], s=r["s"][gone], n=r["n"][gone], p=r["p"][gone], kind=np.zeros(len(gone)))
        keep = np.ones(len(twice), bool)
        keep[t[~first]] = False
        r = {k: v[keep] for k, v in r.items()}
        # k-grams with very many contexts in this task skip the first pass, but for a few rows that tell the bucket
        order = np.argsort(r["key"], kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(r["key"][order]) != 0])) if len(order) else np.zeros(0, np.int64)
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        over = nth >= many
        yield from _marks(parts, parts, doc=r["doc"][over], row=r["row"][over], s=r["s"][over], n=r["n"][over], p=r["p"][over], kind=np.full(int(over.sum()), HOT))
        r = {k: v[~over] for k, v in r.items()}
        yield from C.bucketed((r["key"] % U64(parts)).astype(np.int64), {"key": (r["key"] >> U64(32)).astype("<u4"), "c1": r["c1"], "c2": r["c2"].astype("<u4"), "doc_lo": (r["doc"] & 0xFFFFFFFF).astype("<u4"), "doc_hi": (r["doc"] >> 32).astype("<i4"), "row": r["row"], "s_lo": (r["s"] & 0xFFFF).astype("<u2"), "s_hi": (r["s"] >> 16).astype("<u2"), "n": r["n"].astype("u1"), "p": r["p"].astype("u1")})


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))


def _classes(table: pa.Table, parts: int, many: int) -> pa.Table:
    """First pass, one bucket: equal contexts after the first are covered; k-grams whose contexts differ ask for their bytes."""
    bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
    if bucket >= parts:  # on the way to the texts already
        m = C.unpack(blobs, MARK)
        return _table([C.frames([(bucket - parts, m)])])
    r = C.unpack(blobs, RUN)
    order = np.argsort(r["key"], kind="stable")
    same = r["key"][order][1:] == r["key"][order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    r = {k: v[twice] for k, v in r.items()}
    doc, s = (r["doc_hi"].astype(np.int64) << 32) | r["doc_lo"].astype(np.int64), (r["s_hi"].astype(np.int64) << 16) | r["s_lo"].astype(np.int64)
    first, after, _ = later([r["key"], r["c1"], r["c2"]], doc, r["row"], s)
    key, f = r["key"], np.flatnonzero(first)
    _, inverse, count = np.unique(key[f], return_inverse=True, return_counts=True)
    count = count[inverse] if len(f) else np.zeros(0, np.int64)
    ask = f[count > 1]
    kind = np.where(count[count > 1] >= many, HOT, ASKED)  # a bucket sees that many of a k-gram if any task had more
    i = np.concatenate([np.flatnonzero(after), ask])
    kinds = np.concatenate([np.zeros(int(after.sum()), np.int64), kind])
    return _table(_marks(parts, 0, doc=doc[i], row=r["row"][i], s=s[i], n=r["n"][i], p=r["p"][i], kind=kinds))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices of start[i] .. start[i] + size[i] - 1, one range after the other."""
    total = np.concatenate([[0], np.cumsum(size)])
    return np.arange(total[-1]) - np.repeat(total[:-1] - start, size)


def _fetch(texts: pa.Table, marks: pa.Table, length: int, parts: int) -> pa.Table:
    """The bytes of the contexts that asked for them, dealt out by k-gram (or by what neighbouring windows share); covered runs go on."""
    m = C.unpack(marks.column("blob").to_pylist(), MARK)
    m = {k: v.astype(np.int64) for k, v in m.items()}
    done = m["kind"] == COVERED
    out = list(_marks(parts, parts, **{k: v[done] for k, v in m.items()}))
    m = {k: v[~done] for k, v in m.items()}
    if len(m["doc"]) and texts.num_rows:
        data, at = C.binary(texts.column("text"))
        ids, asked = rows_of(texts, m)
        order = np.argsort(ids, kind="stable")
        m["from"] = at[order[np.searchsorted(ids[order], asked)]] + m["s"]
        hot = np.flatnonzero(m["kind"] == HOT)
        cold = {k: v[m["kind"] != HOT] for k, v in m.items()}
        k = max(8, length // 4)
        sub = _aligned({c: v[hot] for c, v in m.items()})
        for x, is_hot in ((cold, False), (sub, True)):
            if not len(x["doc"]):
                continue
            lo = int(x["from"].min())
            seen = data[lo : int((x["from"] + x["n"] + length).max())]
            a = x["from"] - lo
            h = C.POLY.prefixes(seen)
            if is_hot:
                x["p"] = x["p"] - x["q"] * SUB  # to where the string begins that all windows of such a piece share
                core = a + x["p"]
                key = C.mix(C.POLY.of(h, core, core + length - SUB + 1) + x["q"].astype(np.uint64))
                size = x["n"] - 1 + length
                c1 = C.mix(C.POLY.of(h, a, a + size) + size.astype(np.uint64))
                first, after, head = later([key, c1], x["doc"], x["row"], x["s"])
                gone = np.flatnonzero(after)
                equal = same_bytes(seen, a[gone], a[head[gone]], size[gone])
                first[gone[~equal]] = True  # a hash collided: the second pass compares the bytes
                gone = gone[equal]
                out += _marks(parts, parts, **{c: x[c][gone] for c in MARK})
                x, key, a = {c: v[first] for c, v in x.items()}, key[first], a[first]
            else:
                key = C.mix(C.POLY.of(h, a + x["p"], a + x["p"] + k))
            size = x["n"] - 1 + length
            bucket = (key % U64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            for g in np.split(order, cut) if len(order) else []:
                blob = C.pack({c: (key if c == "key" else x[c])[g].astype(t) for c, t in ITEM.items()})
                out.append(pa.record_batch([pa.array([int(bucket[g[0]])], pa.int32()), pa.array([blob + seen[_ranges(a[g], size[g])].tobytes()], pa.binary())], ["bucket", "blob"]))
    return _table(out)


def _aligned(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs cut where the distance of the window start to the k-gram passes a multiple of SUB; q: which such piece."""
    last, first = x["p"] // SUB, (x["p"] - x["n"] + 1) // SUB
    pieces = last - first + 1
    q = np.repeat(last, pieces) - _ranges(np.zeros(len(last), np.int64), pieces)
    y = {c: np.repeat(v, pieces) for c, v in x.items()}
    near, far = np.maximum(q * SUB, y["p"] - y["n"] + 1), np.minimum(q * SUB + SUB - 1, y["p"])
    move = y["p"] - far
    return y | {"s": y["s"] + move, "from": y["from"] + move, "n": far - near + 1, "p": far, "q": q}


class Suffixes:
    """Strings buffer[start:start + size] (reversed by the caller where needed), compared by prefix polynomial hashes."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.buffer, self.start, self.size, self.hashes = buffer, start, size, C.POLY.prefixes(buffer)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings x[i] and y[i]: binary search for the longest prefixes of equal hash."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        a, b = self.start[x], self.start[y]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = C.POLY.of(self.hashes, a, a + mid) == C.POLY.of(self.hashes, b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        over_x, over_y = n >= self.size[x], n >= self.size[y]
        last = len(self.buffer) - 1
        bytes_less = self.buffer[np.minimum(self.start[x] + n, last)] < self.buffer[np.minimum(self.start[y] + n, last)]
        return np.where(over_x | over_y, over_x & ~over_y, bytes_less)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the strings within each group (groups are runs of equal values): bottom-up mergesort, all merges of a width at once; an element's place in the other half is found by binary search."""
        n = len(group)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, n))
        base, total = np.repeat(begin, sizes), np.repeat(sizes, sizes)
        place, width = np.arange(n) - base, 1
        while width < sizes.max(initial=0):
            act = np.flatnonzero(total > width)
            run = place[act] // width
            other = np.minimum((run ^ 1) * width, total[act])
            count = np.minimum(width, total[act] - other)
            right = (run & 1).astype(bool)
            lo, hi = np.zeros(len(act), np.int64), count.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) >> 1
                me, it = order[act[open_]], order[base[act[open_]] + other[open_] + mid]
                # the right half goes after equal elements of the left half
                before = np.where(right[open_], ~self.less(me, it), self.less(it, me))
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            merged = order.copy()
            merged[base[act] + (run & ~1) * width + place[act] % width + lo] = order[act]
            order, width = merged, width * 2
        return order

    def ordered(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and, for each place in it, the common length with the place before (-1 at a group's start), both verified on the bytes."""
        order = self.sort(group)
        width = int(self.size.max(initial=1))
        col = np.arange(width)
        last = max(len(self.buffer) - 1, 0)

        def verified(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lcp, good = np.full(len(order), -1), np.ones(len(order), bool)
            for i in range(1, len(order), 20_000):
                x, y = order[i - 1 : i - 1 + 20_000][: len(order) - i], order[i : i + 20_000]
                a = np.where(col < self.size[x][:, None], self.buffer[np.minimum(self.start[x][:, None] + col, last)].astype(np.int16), -1)
                b = np.where(col < self.size[y][:, None], self.buffer[np.minimum(self.start[y][:, None] + col, last)].astype(np.int16), -1)
                differ = a != b
                at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
                rows, cell = np.arange(len(x)), np.minimum(at, width - 1)
                inside = group[x] == group[y]
                lcp[i : i + len(x)] = np.where(inside, np.minimum(at, np.minimum(self.size[x], self.size[y])), -1)
                good[i : i + len(x)] = ~inside | (at == width) | (a[rows, cell] < b[rows, cell])
            return lcp, good

        lcp, good = verified(order)
        if not good.all():  # a hash collided: sort by the bytes themselves
            text = [self.buffer[a : a + n].tobytes() for a, n in zip(self.start, self.size, strict=True)]
            order = np.array(sorted(range(len(text)), key=lambda i: (group[i], text[i])))
            lcp, _ = verified(order)
        return order, lcp


def _repeats(table: pa.Table, length: int, parts: int) -> pa.Table:
    """Second pass, one bucket: every window that stands earlier too, by the sorted suffixes and reversed prefixes at the k-grams."""
    bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
    if bucket >= parts:
        return _table([C.frames([(bucket - parts, C.unpack(blobs, MARK))])])
    width = sum(np.dtype(t).itemsize for t in ITEM.values())
    x = C.unpack(blobs, ITEM)
    text = np.concatenate([np.frombuffer(b, np.uint8)[8 + width * int(np.frombuffer(b, np.int64, 1)[0]) :] for b in blobs])
    size = x["n"].astype(np.int64) - 1 + length
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    order = np.lexsort((x["s"].astype(np.int64) + x["p"], x["row"], x["doc"], x["key"]))
    key, doc, row, s, n, p = (x[c][order].astype(np.int64 if c != "key" else np.uint64) for c in ("key", "doc", "row", "s", "n", "p"))
    begin, size = begin[order], size[order]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ranks = []
    for suffixes in (Suffixes(text, begin + p, size - p), Suffixes(text[::-1], len(text) - begin - p, p)):
        o, lcp = suffixes.ordered(group)
        back = np.empty(len(o), np.int64)
        back[o] = np.arange(len(o))
        ranks.append((lcp, back))
    out = []
    for left in range(int(p.max(initial=0)) + 1):
        own = np.flatnonzero((p >= left) & (left >= p - n + 1))
        if len(own) < 2:
            continue
        (lcp, back), (lcp2, back2) = ranks
        right_class, left_class = np.cumsum(lcp < length - left)[back[own]], np.cumsum(lcp2 < left)[back2[own]]
        cls = right_class * (len(key) + 1) + left_class
        by = np.argsort(cls, kind="stable")  # within a class the earliest text stays first
        new = np.concatenate([[True], cls[by][1:] != cls[by][:-1]])
        head = own[by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]]
        me = own[by]
        start = s + p - left
        hit = (doc[head] != doc[me]) | (row[head] != row[me]) | (start[head] != start[me])
        out.append((doc[me[hit]], row[me[hit]], start[me[hit]]))
    if not out:
        return _table([])
    doc, row, start = (np.concatenate([o[i] for o in out]) for i in range(3))
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (np.diff(start) > 1)])) if len(doc) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(doc)) - 1
    n = start[end] - start[new] + 1 if len(doc) else start
    return _table(_marks(parts, 0, doc=doc[new], row=row[new], s=start[new], n=n, p=np.zeros(len(new)), kind=np.zeros(len(new))))


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > top[:-1]])
    return start[new], top[np.concatenate([new[1:], [True]])]


def _cleaned(texts: pa.Table, marks: pa.Table, length: int, finish: Callable[[bytes, list[tuple[int, int]]], tuple], schema: pa.Schema) -> pa.Table:
    m = C.unpack(marks.column("blob").to_pylist(), MARK)
    ids, of = rows_of(texts, m)
    order = np.argsort(of, kind="stable")
    of, s, e = of[order], m["s"][order].astype(np.int64), (m["s"].astype(np.int64) + m["n"] - 1 + length)[order]
    data, at = C.binary(texts.column("text")) if texts.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    lo, hi = np.searchsorted(of, ids), np.searchsorted(of, ids, "right")
    rows = []
    for i in range(texts.num_rows):
        a, b = merge(s[lo[i] : hi[i]], e[lo[i] : hi[i]])
        rows.append(finish(data[at[i] : at[i + 1]].tobytes(), list(zip(a.tolist(), b.tolist(), strict=True))))
    return pa.table([texts.column("doc_id").cast(pa.int64()) if texts.num_rows else pa.array([], pa.int64()), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _full(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    return len(text), sum(b - a for a, b in spans), len(spans), [a for a, _ in spans], [b for _, b in spans], remove_spans(text, spans)


def _digest(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    return len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(remove_spans(text, spans)).hexdigest()


FULL = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def exact_substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, digests: bool = False, part_mb: int = 4, many: int = MANY) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts earlier (smaller doc_id, or the same document, earlier).

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans, starts and ends of the removed runs, kept (the
    remaining bytes); with digests, kept_sha256 in place of the last three. Overlaps count, strings are judged on the
    input, matches never cross documents. Null text is empty. Rows of one doc_id and text are one document and don't
    count against each other; rows of one doc_id with different texts are documents of their own, in the order of a hash
    of their texts. A null doc_id counts as the smallest id there is and comes back as null. Very long texts are cut up
    piece by piece; other columns don't matter. length must be from 32 to 255.
    """
    if not 32 <= length <= 255:
        raise ValueError("length must be from 32 to 255")
    none = -(1 << 63) + 1
    rows = numbered(C.text_rows(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(none))))
    parts = prime(C.parts_for(rows, "text", part_mb))
    finish, schema = (_digest, DIGEST) if digests else (_full, FULL)
    texts = rows.select(F.pmod(F.col("doc_id").bitwiseXOR(F.col("row")), F.lit(parts)).cast("int").alias("bucket"), "doc_id", "row", "text")
    by = lambda df: df.groupBy("bucket")
    marks = by(rows.mapInArrow(C.mapped(_cut, length, parts, many), C.BLOBS)).applyInArrow(C.grouped(_classes, parts, many), C.BLOBS)
    asked = by(texts).cogroup(by(marks)).applyInArrow(C.cogrouped(_fetch, length, parts), C.BLOBS)
    spans = by(asked).applyInArrow(C.grouped(_repeats, length, parts), C.BLOBS)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "starts array<long>, ends array<long>, kept binary")
    out = by(texts).cogroup(by(spans)).applyInArrow(C.cogrouped(_cleaned, length, finish, schema), ddl)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
