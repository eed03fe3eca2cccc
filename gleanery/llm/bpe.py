"""Byte-level BPE encoding and decoding of a text column with a given vocabulary file (never trained, never copied here)."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C

#: Splits text before the merges; fixed by this family of vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 40
#: Words of more bytes than this are merged with a heap, as repeated scans take quadratic time.
SHORT = 128
#: What a known word takes up besides its letters and ids, about.
WORD_BYTES = 220


def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary. `known` keeps the words met so far, but no long ones; it is emptied when it has taken up `most` bytes."""

    def __init__(self, path: str, most: int = 32 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, table = spec["model"], byte_chars()
        self.pieces = {i: bytes(table[c] for c in piece) for piece, i in model["vocab"].items()}
        by_bytes = {b: i for i, b in self.pieces.items()}
        self.single = [by_bytes[bytes([b])] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[model["vocab"][a] << 20 | model["vocab"][b]] = rank
            self.merged.append(model["vocab"][a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])) or spec.get("normalizer"):
            raise ValueError("only plain added tokens and no normalizer are supported")
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(SPLIT).findall
        self.most, self.held, self.known, self.back = most, 0, {}, {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one short word. ids[i] is the part between two boundaries, rank[i] that of the pair (i, i + 1); the least rank goes first, the leftmost of equals."""
        if len(word) > SHORT:
            return self._merge_long(word)
        get, ids = self.ranks.get, [self.single[b] for b in word]
        rank = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while rank and (least := min(rank)) != NONE:
            i = rank.index(least)
            ids[i] = self.merged[least]
            del ids[i + 1], rank[i]
            if i:
                rank[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(rank):
                rank[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same ids, with a heap of pairs over a linked list of parts."""
        get, ids, n = self.ranks.get, [self.single[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := get(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := get(ids[before[i]] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (x, before[i]))
        return [i for i in ids if i >= 0]

    def _one(self, word: str) -> tuple[str, str]:
        raw = word.encode()
        ids = self.merge(raw)
        back = self.decode_bytes(ids)
        return ",".join(map(str, ids)), word if back == raw else back.decode(errors="replace")

    def _known(self, words: list[str]) -> list[str]:
        """The ids of each word. Words that decode to something else are noted in `back`."""
        get, out = self.known.get, []
        for w in words:
            ids = get(w)
            if ids is None:
                ids, back = self._one(w)
                if len(w) <= SHORT:
                    self.held += WORD_BYTES + 2 * len(w) + len(ids)
                    if self.held > self.most:
                        self.known.clear()
                        self.back.clear()
                        self.held = 0
                    self.known[w] = ids
                    if back is not w:
                        self.back[w] = back
            out.append(ids)
        return out

    def encoded(self, text: str) -> tuple[list[str], list[str]]:
        """The ids of the text's words, each word's as decimal text joined by commas, and what those ids decode to."""
        ids, back = [], []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                ids.append(str(self.special[part]))
                back.append(part)
            elif part:
                words = self.words(part)
                ids += self._known(words)
                # nothing decodes to anything else, but for vocabularies that lack bytes
                back.append("".join(self.back.get(w, w) for w in words) if self.back else part)
        return ids, back

    def encode(self, text: str) -> list[int]:
        return [int(i) for word in self.encoded(text)[0] for i in word.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker; workers serve many tasks."""
    return Tokenizer(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode(errors="replace") for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _encode(batches: Iterator[pa.RecordBatch], path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            n, ids, back = [], [], []
            for text in _texts(part):
                words, decoded = t.encoded(text)
                joined = ",".join(words)
                n.append(joined.count(",") + 1 if joined else 0)
                decoded = "".join(decoded)
                ids.append(hashlib.sha256(joined.encode()).hexdigest() if digests else [int(x) for x in joined.split(",")] if joined else [])
                back.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            kind, names = (pa.string(), ["ids_sha256", "decoded_sha256"]) if digests else (pa.list_(pa.int32()), ["ids", "decoded"])
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(back, pa.string())], ["doc_id", "n_tokens", *names])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (array of int), decoded; with digests, ids_sha256 of the decimal
    ids joined by commas and decoded_sha256. path: a tokenizers JSON file of a byte-level BPE, readable on each
    executor. Added tokens in the text are recognised, no others are added. Null text is empty (no tokens); bytes that
    are no UTF-8 are replaced by U+FFFD first. Every row is encoded by itself, so any skew of ids or sources is harmless.
    """
    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return C.text_rows(docs, id_col, text_col).mapInArrow(C.mapped(_encode, path, digests), ddl)
