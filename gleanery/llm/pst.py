"""Language-model scoring with a probabilistic suffix tree over bytes, beside a unigram base over words.

Texts are dealt into blocks by a hash. Each block sends its different words and its different (context, next byte) to buckets by a
hash of the whole key, with their counts in training texts, so that no common word or ending makes a bucket large.
There the blocks' counts are added up; the different grams, now once each, go on to buckets by the context's last two
bytes, where a context meets all its suffixes of two bytes and more. A context is retained if it was seen often enough
(a fixed count, so that the tree grows with the corpus) and its next-byte distribution diverges from that of its suffix
by more than a likelihood test allows; the suffixes of what is retained stay too. The longest retained suffix is the
state, its smoothed distribution gives the probability. These go back to the blocks that asked, in the order of asking;
only the counts of pairs of bytes (256 x 256 at most) go to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
DEPTH = 5
#: A context seen once says nothing of what follows it; for all others the likelihood test decides.
LEAST = 2
BLOCK_MB = 8
#: The end of a text among words; no word has this digest.
END = np.frombuffer(b"end of the text.", "<u8")
#: Places that are sorted at once, so that a gram and its place fit into 64 bits.
CHUNK = 1 << 16
#: For bytes.translate, which is far faster than indexing: A-Z lower-cased, and 1 for bytes of words.
LOWERED, INSIDE = C.LOWER.tobytes(), (~C.SPACE).tobytes()
PLANES = {f"b{k}": "u1" for k in range(DEPTH + 1)}
GRAM = PLANES | {"n": "<i8"}
ANSWER = PLANES | {"logp": "<f4"}
WORD = {"w0": "<u8", "w1": "<u8", "n": "<u4"}
NODE = {"level": "u1", "key": "<u8", "n": "<i8"}
ASKED = "bucket int, block int, blob binary"
ANSWERED = "block int, bucket int, blob binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


@dataclass
class Canonical:
    """Rows as DEPTH zero bytes, their lower-cased words with one space between, and a newline as end: x. real: which bytes of x are not those zeros; sizes: how many each row has. Of all words in order: their bytes (letters), how many each has, and how many words each row has."""

    x: np.ndarray
    real: np.ndarray
    sizes: np.ndarray
    letters: np.ndarray
    lengths: np.ndarray
    words: np.ndarray


def canonical(data: np.ndarray, at: np.ndarray) -> Canonical:
    """Of rows data[at[i]:at[i+1]]."""
    n = len(at) - 1
    stop = at[1:] - at[0] + np.arange(n)  # the space after each row
    text = np.full(int(at[-1] - at[0]) + n, 0x20, np.uint8)
    own = np.ones(len(text), bool)
    own[stop] = False
    text[own] = data[at[0] : at[-1]]
    raw = text.tobytes()
    text = np.frombuffer(raw.translate(LOWERED), np.uint8).copy()
    inside = np.zeros(len(text) + 1, bool)
    inside[1:] = np.frombuffer(raw.translate(INSIDE), bool)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end, inside = edge[::2], edge[1::2], inside[1:]
    letters, lengths = text[inside], end - start
    first = np.concatenate([[0], np.searchsorted(start, stop)])
    words = np.diff(first)
    bare = words == 0
    inside[end] = True  # the byte after each word stays too
    text[end] = 0x20
    text[end[first[1:][~bare] - 1]] = 0x0A
    inside[stop[bare]] = True
    text[stop[bare]] = 0x0A
    sizes = np.maximum(np.diff(np.concatenate([[0], np.cumsum(lengths)])[first]) + words, 1)
    top = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    real = np.ones(int(sizes.sum()) + DEPTH * n, bool)
    real[(top[:, None] + np.arange(DEPTH)).ravel()] = False
    x = np.zeros(len(real), np.uint8)
    x[real] = text[inside]
    return Canonical(x, real, sizes, letters, lengths, words)


def _last(c: Canonical, kind: str) -> np.ndarray:
    """The bytes up to every place, as a number of that big-endian kind."""
    width = np.dtype(kind).itemsize
    padded = np.concatenate([np.zeros(width - 1, np.uint8), c.x])
    return np.ndarray(len(c.x), kind, padded, strides=(1,))[c.real]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of the sorted x, and which of those each is."""
    at = _starts(x)
    return x[at], np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    at = _starts(k)
    return k[at], (np.add.reduceat(n, at) if len(at) else n)


def held_out(ids: list[int | None], folds: int) -> list[bool | None]:
    return [None if i is None else zlib.crc32(str(i).encode()) % folds == 0 for i in ids]


def _grams(c: Canonical) -> np.ndarray:
    """(context of DEPTH bytes, next byte) of every place, as one number."""
    return _last(c, ">u8").astype(np.uint64) & U64((1 << 8 * (DEPTH + 1)) - 1)


def _planes(key: np.ndarray) -> dict[str, np.ndarray]:
    """Keys as one column for each of their bytes, which compress well when sorted."""
    return {c: (key >> U64(8 * k)).astype(np.uint8) for k, c in enumerate(PLANES)}


def _keys(m: dict[str, np.ndarray]) -> np.ndarray:
    key = np.zeros(len(m["b0"]), np.uint64)
    for k, c in enumerate(PLANES):
        key |= m[c].astype(np.uint64) << U64(8 * k)
    return key


def _dealt(key: np.ndarray, parts: int) -> np.ndarray:
    return (C.mix(key) % U64(parts)).astype(np.int64)


def _in_buckets(bucket: np.ndarray) -> list[np.ndarray]:
    """The places of each bucket's items, in order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max()))), kind="stable")  # by radix if they are small
    return np.split(order, _starts(bucket[order])[1:])


def _learned(texts: pa.Table, folds: int) -> np.ndarray:
    return np.array([h is False for h in held_out(texts.column("doc_id").to_pylist(), folds)], bool)


def told_apart(letters: list[np.ndarray], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of the different words of a block, sorted, END too, and which of those are END and all words in order. Each different word is digested once."""
    ends = np.concatenate([np.zeros(1, np.int64), *lengths]).cumsum()
    kind, offsets = (pa.binary(), ends.astype(np.int32)) if ends[-1] < 1 << 31 else (pa.large_binary(), ends)
    data = np.concatenate([np.zeros(0, np.uint8), *letters])
    words = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    digests = np.frombuffer(END.tobytes() + b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_numpy(zero_copy_only=False))), "<u8").reshape(-1, 2)
    order = np.argsort(digests[:, 0])
    if (np.diff(digests[order, 0]) == 0).any():
        order = np.lexsort((digests[:, 1], digests[:, 0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return digests[order], np.concatenate([rank[:1], rank[1:][words.indices.to_numpy()]])


def block_words(texts: pa.Table, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """The different words of a block by their digests, sorted, END too, and how often each stands in training texts."""
    data, at = C.binary(texts.column("text"))
    learned = _learned(texts, folds)
    letters, lengths, own = [], [], [np.zeros(1, bool)]
    for i, j in C.slices(at):
        c = canonical(data, at[i : j + 1])
        letters.append(c.letters)
        lengths.append(c.lengths)
        own.append(np.repeat(learned[i:j], c.words))
    words, which = told_apart(letters, lengths)
    n = np.bincount(which[np.concatenate(own)], minlength=len(words))
    n[which[0]] = learned.sum()
    return words, n


def block_grams(texts: pa.Table, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """The different (context, next byte) of a block, sorted, and how often each stands in training texts."""
    data, at = C.binary(texts.column("text"))
    learned, keys, counts = _learned(texts, folds), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in C.slices(at):
        c = canonical(data, at[i : j + 1])
        key = _grams(c) << U64(1) | np.repeat(~learned[i:j], c.sizes)
        key.sort()
        own = 1 - (key & U64(1)).astype(np.int64)
        key >>= U64(1)
        cut = _starts(key)
        keys.append(key[cut])
        counts.append(np.add.reduceat(own, cut) if len(cut) else own)
        if len(keys) > 8:
            k, n = _summed(keys, counts)
            keys, counts = [k], [n]
    return _summed(keys, counts)


def placed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams with their places, sorted chunk by chunk: (different ones of each chunk, how often each, places in that order)."""
    n = len(key)
    rows = -(-n // CHUNK)
    packed = np.full(rows * CHUNK, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = key << U64(16)
    packed = packed.reshape(rows, CHUNK)
    packed |= np.arange(CHUNK, dtype=np.uint64)
    packed.sort(axis=1)
    place = (packed & U64(CHUNK - 1)).astype(np.int32) + (np.arange(rows, dtype=np.int32) * CHUNK)[:, None]
    place, packed = place.ravel()[:n], packed.ravel()[:n] >> U64(16)  # what fills the last chunk comes last
    new = np.ones(n, bool)
    new[1:] = packed[1:] != packed[:-1]
    new[::CHUNK] = True
    cut = np.flatnonzero(new)
    return packed[cut], np.diff(np.append(cut, n)), place


def _asked(texts: pa.Table, parts: int, folds: int, grams: bool) -> pa.Table:
    """What a block asks of each bucket."""
    block = texts.column("block")[0].as_py()
    if grams:
        key, n = block_grams(texts, folds)
        groups = _in_buckets(bucket := _dealt(key, parts))
        blobs = [C.pack(_planes(key[g]) | {"n": n[g]}) for g in groups]
    else:
        words, n = block_words(texts, folds)
        groups = _in_buckets(bucket := _dealt(words[:, 0], parts))
        blobs = [C.pack({"w0": words[g, 0], "w1": words[g, 1], "n": n[g].astype("<u4")}) for g in groups]
    return pa.table([pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), pa.array([block] * len(groups), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])


def _weighed(table: pa.Table) -> pa.Table:
    """One bucket of words: to each block their counts in all training texts, in the order of asking. Also how many tokens and kinds of words training has here."""
    parts = [C.unpack([b], WORD) for b in table.column("blob").to_pylist()]
    w0, w1, n = (np.concatenate([p[c] for p in parts]) for c in WORD)
    order = np.lexsort((w1, w0))
    new = np.ones(len(order), bool)
    new[1:] = (w0[order][1:] != w0[order][:-1]) | (w1[order][1:] != w1[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    total = np.bincount(which, n).astype(np.int64)
    ends = np.cumsum([len(p["n"]) for p in parts])
    blobs = [x.tobytes() for x in np.split(total[which].astype("<i8"), ends[:-1])]
    first = [1] + [0] * (len(parts) - 1)
    return pa.table([table.column("block"), table.column("bucket"), pa.array(blobs, pa.binary()), pa.array([f * int(total.sum()) for f in first], pa.int64()), pa.array([f * int((total > 0).sum()) for f in first], pa.int64())], names=["block", "bucket", "blob", "tokens", "kinds"])


def _once(table: pa.Table, parts: int) -> pa.Table:
    """One bucket of grams: each once, with its count in all training texts, to the bucket of its context's last two bytes."""
    m = C.unpack(table.column("blob").to_pylist(), GRAM)
    key, n = _summed([_keys(m)], [m["n"]])
    groups = _in_buckets(bucket := _dealt(key >> U64(8) & U64(0xFFFF), parts))
    return pa.table([pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), pa.array([C.pack(_planes(key[g]) | {"n": n[g]}) for g in groups], pa.binary())], names=["bucket", "blob"])


def _pairs(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[pa.RecordBatch]:
    """How often each pair of bytes stands in a task's training texts."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        batch = batch.filter(pa.array(_learned(batch, folds)))
        data, at = C.binary(batch.column("text"))
        for i, j in C.slices(at):
            total += np.bincount(_last(canonical(data, at[i : j + 1]), ">u2"), minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], ["pair", "n"])


def diverges(counts: np.ndarray, parent: np.ndarray, of: np.ndarray, least: float) -> np.ndarray:
    """Which contexts are seen often enough and differ from their suffix. of: each gram's context; counts and parent: its count and its share after the suffix. Twice the gain in log likelihood is about chi-squared with one degree of freedom for each next byte; the bound is that of the Bayesian information criterion."""
    total, kinds = np.bincount(of, counts), np.bincount(of)
    gain = np.bincount(of, counts * np.log(counts / total[of] / parent))
    return (total >= least) & (gain > 0.5 * kinds * np.log(np.maximum(total, 1)))


@dataclass
class Roots:
    """What all buckets need of the tree: the pairs' counts, which contexts of one byte are retained, and p[context of one byte, next byte], smoothed."""

    pairs: np.ndarray
    keep: np.ndarray
    p: np.ndarray


def roots(pair: np.ndarray, n: np.ndarray, least: float) -> Roots:
    c = np.zeros(1 << 16)
    c[pair] = n
    c = c.reshape(256, 256)
    root = (c.sum(axis=0) + 0.5) / (c.sum() + 128.0)
    some = np.argwhere(c > 0)
    keep = np.zeros(256, bool)
    if len(some):
        ctx, of = np.unique(some[:, 0], return_inverse=True)
        keep[ctx] = diverges(c[some[:, 0], some[:, 1]], c.sum(axis=0)[some[:, 1]] / c.sum(), of, least)
    kinds, total = (c > 0).sum(axis=1, keepdims=True), c.sum(axis=1, keepdims=True)
    return Roots(c, keep, np.where(keep[:, None], (c + kinds * root) / np.maximum(total + kinds, 1), root))


def _level(key: np.ndarray, n: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (context of `level` bytes, next byte)."""
    return _summed([key & U64((1 << 8 * (level + 1)) - 1)], [n])


def retained(key: np.ndarray, n: np.ndarray, top: Roots, least: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(level, grams, counts) of the retained contexts of two bytes and more, from all counted grams of some buckets. A context whose last byte alone is no state is none either."""
    some = n > 0
    levels = {k: _level(key[some], n[some], k) for k in range(2, DEPTH + 1)}
    keep: dict[int, np.ndarray] = {}
    for k in range(DEPTH, 1, -1):
        grams, c = levels[k]
        ctx, of = _runs(grams >> U64(8))
        suffix = grams & U64((1 << 8 * k) - 1)
        if k > 2:
            up, cu = levels[k - 1]
            up_ctx, up_of = _runs(up >> U64(8))
            parent = cu[np.searchsorted(up, suffix)] / np.bincount(up_of, cu)[np.searchsorted(up_ctx, suffix >> U64(8))] if len(up) else np.zeros(0)
        else:
            last, next_ = (suffix >> U64(8)).astype(np.int64), (suffix & U64(255)).astype(np.int64)
            parent = top.pairs[last, next_] / np.maximum(top.pairs.sum(axis=1)[last], 1)
        ok = diverges(c, parent, of, least) if len(ctx) else np.zeros(0, bool)
        if k < DEPTH:
            ok |= np.isin(ctx, keep[k + 1] & U64((1 << 8 * k) - 1))
        ok &= top.keep[(ctx & U64(255)).astype(np.int64)]
        keep[k] = ctx[ok]
    out = []
    for k in range(2, DEPTH + 1):
        grams, c = levels[k]
        sel = np.isin(grams >> U64(8), keep[k])
        out.append((k, grams[sel], c[sel]))
    return out


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def log10_of(key: np.ndarray, top: Roots, levels: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each gram: the longest retained suffix is the state. Each state's distribution is smoothed with that of its suffix, by as much weight as it has kinds of next bytes (Witten and Bell)."""
    p, live = top.p[(key >> U64(8) & U64(255)).astype(np.int64), (key & U64(255)).astype(np.int64)], np.arange(len(key))
    for k, grams, n in levels:
        ctx = grams >> U64(8)
        at = _starts(ctx)
        ctx = ctx[at]
        total, kinds = np.add.reduceat(n, at) if len(at) else n, np.diff(np.append(at, len(grams)))
        at, ok = _found(ctx, key[live] >> U64(8) & U64((1 << 8 * k) - 1))
        live, at = live[ok], at[ok]
        gram, seen = _found(grams, key[live] & U64((1 << 8 * (k + 1)) - 1))
        count = np.zeros(len(live))
        count[seen] = n[gram[seen]]
        p[live] = (count + kinds[at] * p[live]) / (total[at] + kinds[at])
    return np.log10(p)


def _answered(table: pa.Table, parts: int, top: Roots, least: float) -> pa.Table:
    """One bucket of contexts: every gram's log10 probability, to the bucket of the whole gram."""
    m = C.unpack(table.column("blob").to_pylist(), GRAM)
    key, n = _summed([_keys(m)], [m["n"]])
    logp = log10_of(key, top, retained(key, n, top, least)).astype("<f4")
    groups = _in_buckets(bucket := _dealt(key, parts))
    return pa.table([pa.array([int(bucket[g[0]]) for g in groups], pa.int32()), pa.array([C.pack(_planes(key[g]) | {"logp": logp[g]}) for g in groups], pa.binary())], names=["bucket", "blob"])


def _looked_up(asks: pa.Table, answers: pa.Table) -> pa.Table:
    """One bucket of grams: to each block the log10 probabilities, in the order of asking."""
    m = C.unpack(answers.column("blob").to_pylist(), ANSWER)
    key = _keys(m)
    order = np.argsort(key)
    key, logp = key[order], m["logp"][order]
    blobs = [logp[np.searchsorted(key, _keys(C.unpack([b], GRAM)))].astype("<f4").tobytes() for b in asks.column("blob").to_pylist()]
    return pa.table([asks.column("block"), asks.column("bucket"), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"])


def _told(answers: pa.Table, lo: int, hi: int, groups: list[np.ndarray], bucket: np.ndarray, kind: str) -> np.ndarray:
    """The answers of buckets lo .. hi - 1, where they were asked."""
    out = np.zeros(sum(map(len, groups)), kind)
    blobs = {b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True) if lo <= b < hi}
    for g in groups:
        out[g] = np.frombuffer(blobs[lo + int(bucket[g[0]])], kind)
    return out


def _totals(texts: pa.Table, answers: pa.Table, parts: int, folds: int) -> pa.Table:
    """One block: its texts with what words (buckets from 0) and grams (buckets from `parts`) answered, and the size of training (bucket -1)."""
    if not texts.num_rows:
        return pa.table([[]] * 7, schema=SCHEMA)
    size, kinds = map(int, answers.column("blob").filter(pa.array(answers.column("bucket").to_numpy() == -1))[0].as_py().split())
    n = len(texts)
    data, at = C.binary(texts.column("text"))
    # of each slice its words, and its different grams and where they stand; the answers come once for all slices
    letters, lengths, words, sizes, grams = [], [], [], [], []
    for i, j in C.slices(at):
        c = canonical(data, at[i : j + 1])
        for to, own in ((letters, c.letters), (lengths, c.lengths), (words, c.words), (sizes, c.sizes), (grams, placed(_grams(c)))):
            to.append(own)
    key = np.sort(np.concatenate([g[0] for g in grams]))
    key = key[_starts(key)]
    bucket = _dealt(key, parts)
    logp = _told(answers, parts, 2 * parts, _in_buckets(bucket), bucket, "<f4").astype(np.float64)
    scores = []
    for long, (some, times, place) in zip(sizes, grams, strict=True):
        p = np.empty(len(place))
        p[place] = np.repeat(logp[np.searchsorted(key, some)], times)
        scores.append(np.add.reduceat(p, np.cumsum(long) - long))
    del grams
    digests, which = told_apart(letters, lengths)
    bucket = _dealt(digests[:, 0], parts)
    train = _told(answers, 0, parts, _in_buckets(bucket), bucket, "<i8")
    log, seen, end, which = np.log10(train + 0.1), train > 0, which[0], which[1:]
    words = np.concatenate(words)
    row, tokens = np.repeat(np.arange(n), words), words + 1
    base = log[end] + np.bincount(row, log[which], n)
    known = int(seen[end]) + np.bincount(row[seen[which]], minlength=n)
    ids = texts.column("doc_id").to_pylist()
    base -= tokens * np.log10(size + 0.1 * (kinds + 1))
    return pa.table([ids, held_out(ids, folds), tokens, known, np.full(n, size), base, np.concatenate(scores)], schema=SCHEMA)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, least: int = LEAST, block_mb: int = BLOCK_MB) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, lower-cased A-Z, and one end per text; words are told apart by 128 bits of their digests.
    base_score: the unigram log10 probability with training counts, smoothed by 0.1 for each kind of token and one unseen
    kind. score: the tree's log10 probability of the words with one space between them and the end. Null text is empty
    (its only token is the end). Rows of one doc_id are scored, and learned from, each; a null doc_id is not learned from
    and its held_out is null. Contexts seen fewer than `least` times are not retained. A very long text is a block of its
    own or makes its block that long. Other columns don't matter.
    """
    rows = C.text_rows(docs, id_col, text_col)
    parts = C.parts_for(rows, "text", block_mb)
    texts = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("block"), "doc_id", "text").groupBy("block")
    pairs = rows.mapInArrow(C.mapped(_pairs, folds), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    top = roots(np.array([r.pair for r in pairs], np.int64), np.array([r.n for r in pairs], np.int64), least)
    # texts, words and grams are shuffled once each; Spark reuses these exchanges below
    words = texts.applyInArrow(C.grouped(_asked, parts, folds, False), ASKED).groupBy("bucket")
    weighed = words.applyInArrow(C.grouped(_weighed), ANSWERED + ", tokens long, kinds long")
    sizes = weighed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v"))
    sizes = sizes.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("block"), F.lit(-1).alias("bucket"), F.encode(F.concat_ws(" ", "n", "v"), "utf-8").alias("blob"))
    grams = texts.applyInArrow(C.grouped(_asked, parts, folds, True), ASKED).groupBy("bucket")
    answers = grams.applyInArrow(C.grouped(_once, parts), C.BLOBS).groupBy("bucket").applyInArrow(C.grouped(_answered, parts, top, least), C.BLOBS)
    looked = grams.cogroup(answers.groupBy("bucket")).applyInArrow(C.cogrouped(_looked_up), ANSWERED).withColumn("bucket", F.col("bucket") + parts)
    told = weighed.select("block", "bucket", "blob").union(looked).union(sizes)
    return texts.cogroup(told.groupBy("block")).applyInArrow(C.cogrouped(_totals, parts, folds), SCORED)
