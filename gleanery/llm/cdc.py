"""Substring deduplication by content-defined chunking: cuts where a gear rolling hash has its top bits clear, chunks compared by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .suffix import DIGEST, FULL, MARK, _digest, _full, _table, later, merge, numbered, prime, rows_of

ROW = {"c1": "<u8", "c2": "<u4", "doc_lo": "<u4", "doc_hi": "<i4", "row": "<i8", "s_lo": "<u2", "s_hi": "<u2", "n": "<u2"}
GEAR = np.append(np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32), np.uint32(0))


def gear(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = 2 * h + G[byte] modulo 2**32, begun at 0 in each row: the sum of the last 32 table values, shifted, built by doubling."""
    n, lengths = len(at) - 1, np.diff(at)
    where = np.arange(int(at[-1] - at[0])) + np.repeat(np.arange(1, n + 1) * 32, lengths)
    padded = np.full(int(at[-1] - at[0]) + 32 * (n + 1), 256, np.uint16)
    padded[where] = data[at[0] : at[-1]]
    h, span = GEAR[padded], 1
    while span < 32:
        more = h[:-span] << np.uint32(span)
        h[span:] += more
        span *= 2
    return h[where]


def chunks(data: np.ndarray, at: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all rows. A cut needs `bits` clear bits and at least `least` bytes since the last; longer chunks than `most` are cut there. Cuts never split a UTF-8 character (unless `most` bytes are none)."""
    base = int(at[0])
    inside = (data[base : at[-1]] & 0xC0) == 0x80
    ends = np.flatnonzero(gear(data, at) >> np.uint32(32 - bits) == 0) + 1
    ends = ends[(ends < len(inside)) & ~inside[np.minimum(ends, len(inside) - 1)]] if len(inside) else ends
    starts_out, ends_out, k, cand = [], [], 0, ends.tolist()
    for a, b in zip((at[:-1] - base).tolist(), (at[1:] - base).tolist(), strict=True):
        while k < len(cand) and cand[k] <= a:
            k += 1
        while a < b:
            while k < len(cand) and cand[k] < a + least:
                k += 1
            e = cand[k] if k < len(cand) and cand[k] < b else b
            if e - a > most:
                e = a + most
                while e > a + most - 4 and inside[e]:
                    e -= 1
            starts_out.append(a)
            ends_out.append(e)
            a = e
    return np.array(starts_out, np.int64) + base, np.array(ends_out, np.int64) + base


def _cut(batches: Iterator[pa.RecordBatch], parts: int, bits: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column("text"))
        ids, rows = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
        for lo, hi in C.slices(at, 12 << 20):
            yield from _bucketed_chunks(data, at[lo : hi + 1], ids[lo:hi], rows[lo:hi], parts, bits, least, most)


def _bucketed_chunks(data: np.ndarray, at: np.ndarray, ids: np.ndarray, rows: np.ndarray, parts: int, bits: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """The chunks of some rows by digest; of those that are equal here only the first goes on, the others are marked at once."""
    got = []
    for i, j in C.slices(at):
        s, e = chunks(data, at[i : j + 1], bits, least, most)
        view, digest, lo = memoryview(data[at[i] : at[j]]), xxhash.xxh3_128_digest, int(at[i])
        d = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip((s - lo).tolist(), (e - lo).tolist(), strict=True)]), "<u8").reshape(-1, 2)
        row = np.searchsorted(at, s, "right") - 1
        got.append((d[:, 0], d[:, 1].astype("<u4"), ids[row], rows[row], s - at[row], e - s))
    c1, c2, doc, row, s, n = (np.concatenate([x[k] for x in got]) for k in range(6))
    order = np.argsort(c1, kind="stable")
    same = c1[order][1:] == c1[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    t = np.flatnonzero(twice)
    first, after, _ = later([c1[t], c2[t]], doc[t], row[t], s[t])
    gone = t[after]
    yield from _marks(parts, parts, doc[gone], row[gone], s[gone], n[gone])
    keep = np.ones(len(twice), bool)
    keep[t[~first]] = False
    c1, c2, doc, row, s, n = (x[keep] for x in (c1, c2, doc, row, s, n))
    yield from C.bucketed((c1 % np.uint64(parts)).astype(np.int64), {"c1": c1, "c2": c2, "doc_lo": (doc & 0xFFFFFFFF).astype("<u4"), "doc_hi": (doc >> 32).astype("<i4"), "row": row, "s_lo": (s & 0xFFFF).astype("<u2"), "s_hi": (s >> 16).astype("<u2"), "n": n.astype("<u2")})


def _marks(parts: int, base: int, doc: np.ndarray, row: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    zero = np.zeros(len(doc), np.uint8)
    yield from C.bucketed(base + (doc ^ row) % parts, {k: v.astype(t) for (k, t), v in zip(MARK.items(), (doc, row, s, n, zero, zero), strict=True)})


def _seen(table: pa.Table, parts: int) -> pa.Table:
    bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
    if bucket >= parts:
        return _table([C.frames([(bucket - parts, C.unpack(blobs, MARK))])])
    r = C.unpack(blobs, ROW)
    doc, s = (r["doc_hi"].astype(np.int64) << 32) | r["doc_lo"].astype(np.int64), (r["s_hi"].astype(np.int64) << 16) | r["s_lo"].astype(np.int64)
    _, after, _ = later([r["c1"], r["c2"]], doc, r["row"], s)
    return _table(_marks(parts, 0, doc[after], r["row"][after], s[after], r["n"][after]))


def _cleaned(texts: pa.Table, marks: pa.Table, least_run: int, digests: bool, carry: bool) -> pa.Table:
    schema, finish = (DIGEST, _digest) if digests else (FULL, _full)
    m = C.unpack(marks.column("blob").to_pylist(), MARK)
    which, of = rows_of(texts, m)
    order = np.lexsort((m["s"], of))
    of, s, e = of[order], m["s"][order].astype(np.int64), (m["s"].astype(np.int64) + m["n"])[order]
    data, at = C.binary(texts.column("text")) if texts.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    ids = texts.column("doc_id").to_numpy() if texts.num_rows else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(of, which), np.searchsorted(of, which, "right")
    rows = []
    for i in range(texts.num_rows):
        a, b = merge(s[lo[i] : hi[i]], e[lo[i] : hi[i]])
        long = b - a >= least_run
        rows.append(finish(data[at[i] : at[i + 1]].tobytes(), list(zip(a[long].tolist(), b[long].tolist(), strict=True))))
    out = pa.table([pa.array(ids, pa.int64()), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)
    return out.append_column("rest", texts.column("rest")) if carry else out


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, least: int = 8, most: int = 512, least_run: int = 96, digests: bool = False, part_mb: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes runs of at least least_run bytes made of chunks whose digest also stands earlier (smaller doc_id, or the same document, earlier).

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans, starts and ends of the removed runs, kept (the
    remaining bytes, whole UTF-8 characters); with digests, kept_sha256 in place of the last three. Chunks have about
    2**bits + least bytes, so a repeated passage loses all but its ends, of about that size each; least_run leaves
    short common phrases and lines alone. Each task keeps one of each digest before the shuffle, so a chunk that
    a third of all documents share costs one row a task. Null text is empty. Rows of one doc_id and text don't count
    against each other, rows of one doc_id with different texts are documents of their own; a null doc_id counts as the smallest id and comes back as null. carry: columns of docs that come along
    in a struct `rest`, so that no join is needed to put them back.
    """
    none = -(1 << 63) + 1
    rest = [F.struct(*carry).alias("rest")] if carry else []
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *rest)
    rows = numbered(rows)
    parts = prime(C.parts_for(rows, "text", part_mb))
    texts = rows.withColumn("bucket", F.pmod(F.col("doc_id").bitwiseXOR(F.col("row")), F.lit(parts)).cast("int"))
    by = lambda df: df.groupBy("bucket")
    marks = by(rows.select("doc_id", "row", "text").mapInArrow(C.mapped(_cut, parts, bits, least, most), C.BLOBS)).applyInArrow(C.grouped(_seen, parts), C.BLOBS)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "starts array<long>, ends array<long>, kept binary")
    ddl += f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""
    out = by(texts).cogroup(by(marks)).applyInArrow(C.cogrouped(_cleaned, least_run, digests, bool(carry)), ddl)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
