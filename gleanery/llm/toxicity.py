"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text, and the lengths of short windows under each."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words in a window; bytes that stand for a word, the digest of it.
WORDS, CODE = 16, 16
#: Most bytes of a dictionary.
SIZE = 8192
#: ASCII letters and digits (lower-cased) and all other bytes stay, ASCII punctuation and white space become spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(PLAIN).split()


def windows(text: str) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i : i + WORDS]) + b" " for i in range(0, len(w), WORDS)]


def coded(window: bytes) -> bytes:
    """A window as the compressors see it: each word by the 16 bytes of its digest, so that whole words match or nothing does, however long they are and in whatever script."""
    return b"".join([xxhash.xxh3_128_digest(w) for w in window.split()])


def dictionary(own: list[list[bytes]], own_words: Counter, other_words: Counter, n_other: int, share: float, ratio: float) -> bytes:
    """zstandard dictionary of one class, trained on the windows of its texts. In each window the words that tell the classes apart stay: those in `share` of the class's texts (3 at least) that are in `ratio` times as large a share of them as of the other class's. Trained on whole windows, dictionaries spend their bytes on words that both classes have. Too few windows for the library's trainer are a dictionary as they are."""
    n = len(own)
    keys = {w for w, k in own_words.items() if k >= max(3, share * n) and (k + 0.5) / n >= ratio * (other_words[w] + 0.5) / max(n_other, 1)}
    samples = [x for ws in own for i in range(0, len(ws), WORDS) if (x := coded(b" ".join(w for w in ws[i : i + WORDS] if w in keys)))]
    try:
        return zstandard.train_dictionary(SIZE, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples)))[:SIZE].rjust(CODE, b"\0")


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    params = zstandard.ZstdCompressionParameters.from_level(1, write_content_size=False, write_dict_id=False, strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=20, hash_log=17, chain_log=17, search_log=6, target_length=1)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


@dataclass
class Model:
    """Two dictionaries and a logistic calibration of what the toxic one saves: the most in a window, in all windows, and on average."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float, float]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.toxic)

    def score(self, saved: tuple[float, float, float]) -> float:
        z = sum(w * x for w, x in zip(self.weights, (*saved, 1.0), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def saved(text: str, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Bytes that the toxic dictionary saves against the ordinary one: the most in a window, the log of the sum over windows where it saves any, and the mean of all."""
    most = total = net = 0
    ws = windows(text)
    for w in map(coded, ws):
        d = len(ordinary.compress(w)) - len(toxic.compress(w))
        net += d
        if d > 0:
            most, total = max(most, d), total + d
    return float(most), float(np.log1p(total)), net / max(1, len(ws))


def fit(texts: list[str], labels: list[int], prior: float, share: float = 0.01, ratio: float = 10.0) -> Model:
    """Calibration on a third of the texts, with dictionaries from the others; then dictionaries from all. prior: the share of toxic texts among all labelled ones."""
    y = np.array(labels)
    lists = [words(t) for t in texts]

    def dictionaries(some: np.ndarray) -> tuple[bytes, bytes]:
        counts = [Counter(), Counter()]
        for k in np.flatnonzero(some):
            counts[y[k]].update(set(lists[k]))
        own = [[lists[k] for k in np.flatnonzero(some & (y == c))] for c in (0, 1)]
        return dictionary(own[1], counts[1], counts[0], len(own[0]), share, ratio), dictionary(own[0], counts[0], counts[1], len(own[1]), share, ratio)

    part = np.zeros(len(y), bool)
    for c in (0, 1):  # two of three of each class
        part[np.flatnonzero(y == c)[np.arange((y == c).sum()) % 3 != 2]] = True
    if not (y == 0).any() or not (y == 1).any():  # one class only: nothing to tell apart
        return Model(b"\0" * CODE, b"\0" * CODE, (0.0, 0.0, 0.0, 3.0 if len(y) and y.mean() > 0.5 else -3.0))
    both = Model(*dictionaries(part), (0.0,) * 4).compressors()
    rest = np.flatnonzero(~part) if len(set(y[~part])) == 2 else np.arange(len(y))
    x = np.array([(*saved(texts[k], *both), 1.0) for k in rest])
    t = y[rest]
    weight = np.where(t == 1, prior / max(t.mean(), 1e-9), (1 - prior) / max(1 - t.mean(), 1e-9))
    w = np.zeros(4)
    for _ in range(40):  # Newton steps of a logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 0.01 * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4), grad)
    # the threshold: the cut of 0.5 goes where it errs least
    z = x @ w
    cuts = np.unique(np.concatenate([[z.min() - 1], (np.unique(z)[1:] + np.unique(z)[:-1]) / 2, [z.max() + 1]]))
    errors = [(weight * ((z >= c) != t)).sum() for c in cuts]
    w[3] -= cuts[int(np.argmin(errors))]
    return Model(*dictionaries(np.ones(len(y), bool)), tuple(float(v) for v in w))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500, folds: int = 5, sample_mb: int = 32) -> Model:
    """A model from at most `sample` labelled texts of each class and `sample_mb` MB of both, whole texts in the order of a hash of the id; rows whose crc32(doc_id as text) mod `folds` is 0 are held out. Only texts and labels are read. An id with several labels is toxic if one of them says so, one with several texts counts with the least."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    ids = known.where("y = 1").orderBy(order).limit(sample).union(known.where("y = 0").orderBy(order).limit(sample))
    some = C.materialize(C.text_rows(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")))
    taken, left = [], sample_mb << 20
    for r in some.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            taken, left = [*taken, r.doc_id], left - r.n
    got = some.where(F.col("doc_id").isin(taken)).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([r.text for r in got], [r.y for r in got], counts.get(1, 0) / max(1, sum(counts.values())))


def _scored(batches: Iterator[pa.RecordBatch], model: Model, folds: int) -> Iterator[pa.RecordBatch]:
    both = model.compressors()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            score = [model.score(saved((t or b"").decode(errors="replace"), *both)) for t in part.column("text").cast(pa.binary()).to_pylist()]
            held = [None if i is None else zlib.crc32(str(i).encode()) % folds == 0 for i in part.column("doc_id").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5).

    The whole text is scored in windows of 16 words, however long it is; equal texts get equal scores. Texts without words save nothing and get the lowest score; null
    text is empty; a null doc_id has a null held_out; rows of one doc_id are scored each; other columns don't matter. The model is two
    dictionaries of at most 8 KB and four numbers.
    """
    return C.text_rows(docs, id_col, text_col).mapInArrow(C.mapped(_scored, model, folds), "doc_id long, held_out boolean, score double, predicted int")
