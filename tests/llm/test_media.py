import hashlib
import struct
import zlib

import numpy as np
import pytest
from tests_llm_corpus import prose

from gleanery.llm.media import SIGNATURE, BadImage, _chunk, _paeth, cosine_hash, read_media, read_png, text_to_png, write_png


def filtered(x, kinds, step):
    h, w = x.shape
    out = np.zeros((h, w + 1), np.uint8)
    for y in range(h):
        out[y, 0] = kinds[y]
        for i in range(w):
            a = int(x[y, i - step]) if i >= step else 0
            b = int(x[y - 1, i]) if y else 0
            c = int(x[y - 1, i - step]) if y and i >= step else 0
            out[y, i + 1] = (int(x[y, i]) - [0, a, b, (a + b) // 2, _paeth(a, b, c)][kinds[y]]) % 256
    return out


def png(lines, w, h, colour):
    data = zlib.compress(lines.tobytes())
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + _chunk(b"tEXt", b"a\0b") + _chunk(b"IDAT", data[:9]) + _chunk(b"IDAT", data[9:]) + _chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,step", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters(colour, step):
    rng = np.random.default_rng(colour)
    x = rng.integers(0, 256, (40, 7 * step), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40)
    assert (read_png(png(filtered(x, kinds, step), 7, 40, colour)).reshape(40, -1) == x).all()


def test_writer_round_trip_and_damage():
    for x in (np.zeros((1, 64), np.uint8), np.arange(64 * 9, dtype=np.uint8).reshape(9, 64), np.tile(np.arange(64, dtype=np.uint8), (50, 1))):
        p = write_png(x)
        assert (read_png(p)[:, :, 0] == x).all()
        for bad in (p[:-1], p[:40] + bytes([p[40] ^ 1]) + p[41:], b"", p[8:], p[:8] + p[8:33] * 0):
            with pytest.raises(BadImage):
                read_png(bad)
    huge = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"")) + _chunk(b"IEND", b"")
    with pytest.raises(BadImage):
        read_png(huge)


def test_hash_is_stable_under_small_changes():
    a = np.kron(np.random.default_rng(0).integers(20, 230, (8, 8)), np.ones((8, 8))).astype(np.uint8)[:, :, None]  # has all low frequencies
    b = np.clip(a.astype(int) + np.random.default_rng(1).integers(-4, 5, a.shape), 0, 255).astype(np.uint8)
    bits = lambda s: np.unpackbits(np.frombuffer(bytes.fromhex(cosine_hash(s)), np.uint8))
    c = np.random.default_rng(2).integers(0, 256, a.shape).astype(np.uint8)
    assert (bits(a) != bits(b)).sum() < 12 < (bits(a) != bits(c)).sum()


def test_table(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, prose(1, 4000)), (5, "x" * 64), (6, "x" * 65), (None, "a"), (7, "héllo")]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, width int")
    out = {r.doc_id: r for r in read_media(text_to_png(df), digests=True).collect()}
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (64 if not b else 0))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert out[1].feature == out[7].feature and out[1].media_sha256 == out[7].media_sha256
    assert text_to_png(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, b"no image"), (2, None)], "id long, media binary")
    assert all(r.error and r.samples is None for r in read_media(broken).collect())
