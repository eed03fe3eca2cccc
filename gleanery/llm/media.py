"""PNG images in binary columns: written and read through zlib chunks with checksum tests, unfiltered with numpy, hashed by their low cosine frequencies."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


class BadImage(ValueError):
    """The bytes are no PNG of the supported kind, or are damaged."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A grey 8-bit PNG of samples (height, width). One filter (none, left or up) for all lines, that of the least sum of differences."""
    h, w = samples.shape
    left, up = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    rows = [samples, left, up]
    kind = int(np.argmin([np.minimum(x, 0 - x).sum(dtype=np.int64) for x in rows]))
    lines = np.empty((h, w + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, rows[kind]
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; lengths and checksums are tested."""
    if png[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(png):
            raise BadImage("cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if at + 12 + n > len(png) or struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise BadImage(f"bad chunk {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def _paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered lines (height, 1 + bytes); step: bytes of a pixel. Lines that lean on the left only are summed at once, runs that lean on the line above are summed downwards; the two kinds that need both go pixel by pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise BadImage("unknown filter")
    for k in range(step):
        sub = kinds == 1
        out[sub, k::step] = np.add.accumulate(out[sub, k::step], axis=1, dtype=np.uint8)
    if not (kinds > 1).any():
        return out
    cut = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kinds)], strict=True):
        if kinds[a] == 2:
            lo = max(a - 1, 0)
            out[lo:b] = np.add.accumulate(out[lo:b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            for y in range(a, b):
                row, above = out[y].tolist(), out[y - 1].tolist() if y else [0] * out.shape[1]
                for x in range(len(row)):
                    left, corner = (row[x - step], above[x - step]) if x >= step else (0, 0)
                    row[x] = (row[x] + ((left + above[x]) // 2 if kinds[y] == 3 else _paeth(left, above[x], corner))) & 255
                out[y] = row
    return out


def read_png(png: bytes, most: int = 1 << 31) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit PNG without interlacing or palette. most: bytes that an image may unpack to."""
    head, data = None, []
    for kind, body in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind[0] & 0x20 == 0 and kind != b"IEND":
            raise BadImage(f"unsupported chunk {kind!r}")
    if head is None or head[2] != 8 or head[3] not in (0, 2, 4, 6) or head[4:] != (0, 0, 0):
        raise BadImage("unsupported image type")
    w, h, step = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    size = h * (1 + w * step)
    if size > most:
        raise BadImage("too large")
    try:
        raw = zlib.decompressobj()
        lines = raw.decompress(b"".join(data), size + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(lines) != size or not raw.eof:
        raise BadImage("wrong amount of data")
    return unfilter(np.frombuffer(lines, np.uint8).reshape(h, 1 + w * step), step).reshape(h, w, step)


SIZE, KEEP, LINES = 32, 8, 1024


def _cover(n: int, a: int, b: int) -> np.ndarray:
    """(SIZE, b - a): how much of samples a .. b - 1, of n, goes to each of SIZE cells of equal width, by area."""
    edge = np.arange(SIZE + 1) * n / SIZE
    lo, hi = edge[:-1, None], edge[1:, None]
    return np.clip(np.minimum(hi, np.arange(a + 1, b + 1)) - np.maximum(lo, np.arange(a, b)), 0, None) * SIZE / n


def _cosines() -> np.ndarray:
    k, x = np.arange(KEEP)[:, None], np.arange(SIZE)
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIZE))


@lru_cache(LINES)
def _low(n: int) -> np.ndarray:
    """(KEEP, n): shrinks or stretches n samples to SIZE by area and gives the lowest KEEP cosine frequencies."""
    return _cosines() @ _cover(n, 0, n)


def _along(samples: np.ndarray) -> np.ndarray:
    """The lowest cosine frequencies of each column. Tall images are taken a thousand lines at a time and not kept in the cache."""
    n = len(samples)
    if n <= LINES:
        return _low(n) @ samples.astype(np.float64)
    cells = np.zeros((SIZE, samples.shape[1]))
    for a in range(0, n, LINES):
        part = samples[a : a + LINES]
        cells += _cover(n, a, a + len(part)) @ part.astype(np.float64)
    return _cosines() @ cells


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which of the 8 x 8 lowest cosine coefficients (all but the mean) exceed their median."""
    grey = samples.mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0]
    f = _along(_along(grey).T).T.ravel()
    bits = f > np.median(f[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _written(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            made = [write_png(np.frombuffer(t.ljust(max(1, -(-len(t) // WIDTH)) * WIDTH, b"\0"), np.uint8).reshape(-1, WIDTH), level) for t in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])


def text_to_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes of each whole text, padded with zero bytes to a positive multiple of 64, as a grey PNG 64 samples wide. Null text is empty and becomes one line of zeros; a null doc_id stays null; every row is an image, however long its text; other columns don't matter."""
    return C.text_rows(docs, id_col, text_col).mapInArrow(C.mapped(_written, level), "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] if digests else ["width", "height", "samples", "feature", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] if digests else [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part, rows = batch.slice(start, 256), []
            for png in part.column("media").to_pylist():
                try:
                    x = read_png(png or b"")
                    raw, feature, error = x.tobytes(), cosine_hash(x), None
                except BadImage as e:
                    x, raw, feature, error = None, None, None, str(e)
                if digests:
                    rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature) if raw is not None else (None,) * 6)
                else:
                    rows.append((x.shape[1], x.shape[0], raw, feature, None) if raw is not None else (None, None, None, None, error))
            rest = [part.column(i) for i, c in enumerate(part.schema.names) if c != "media"]
            yield pa.record_batch([*rest, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*(c for c in part.schema.names if c != "media"), *names])


def read_media(images: DataFrame, digests: bool = False) -> DataFrame:
    """Reads the PNG bytes of column media: width, height, samples, feature (hash of low cosine frequencies) and error (why an image can't be read; the rest is null then); with digests, lengths and digests of samples and file instead. Other columns than media stay and must not have those names."""
    own = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" if digests else "width int, height int, samples binary, feature string, error string"
    rest = ", ".join(f"`{c}` {t}" for c, t in images.dtypes if c != "media")
    return images.mapInArrow(C.mapped(_read, digests), f"{rest}, {own}" if rest else own)
