"""Fill-in-middle transformation: texts cut at two token ends and rearranged by scattering their bytes.

Every byte of a part of the text moves by the same shift, so a difference array holds the shift's changes at the cuts;
its running sum is the place of each byte in the output, and one scatter builds a batch. Restoring finds the markers
in the output, turns them into the same kind of differences, and gathers the bytes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Stand before prefix, suffix and middle. Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
WIDTH = 3
#: Codes of the forms inside tasks.
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
#: Bytes whose shifts are held at once.
BLOCK = 1 << 20


def token_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a token ends with a byte of data[at[0]:at[-1]]: after each word, and at the end of a row that ends in white space."""
    space = C.SPACE[data[at[0] : at[-1]]]
    last = np.zeros(len(space), bool)
    last[at[1:][np.diff(at) > 0] - at[0] - 1] = True
    ends = last.copy()
    ends[:-1] |= ~space[:-1] & space[1:]
    return ends


def places(flags: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Where the ranks[i]-th (from 0) of the set flags stands; places are listed a block at a time."""
    counts = np.add.reduceat(flags, np.arange(0, len(flags), BLOCK), dtype=np.int64) if len(flags) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    out, block = np.zeros(len(ranks), np.int64), np.searchsorted(upto, ranks, "right") - 1
    for b in np.unique(block):
        mine = block == b
        out[mine] = b * BLOCK + np.flatnonzero(flags[b * BLOCK : (b + 1) * BLOCK])[ranks[mine] - upto[b]]
    return out


def counted(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between neighbouring bounds."""
    return np.array([np.count_nonzero(flags[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)


def mark_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all markers in data, and which of MARKS they are."""
    mark = [np.frombuffer(m.encode(), np.uint8) for m in MARKS]
    maybe = np.flatnonzero((data[: max(0, len(data) - 2)] == mark[0][0]) & (data[2:] == mark[0][2]))
    letters = data[maybe + 1]
    kind = np.full(len(maybe), -1)
    for k, m in enumerate(mark):
        kind[letters == m[1]] = k
    return maybe[kind >= 0], kind[kind >= 0]


def shifts(starts: np.ndarray, moves: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The running sum, over bytes lo to hi, of a difference array that changes the shift to moves[i] at starts[i] (ascending)."""
    first = int(np.searchsorted(starts, lo, "right")) - 1
    diff = np.zeros(hi - lo, np.int64)
    if hi > lo:
        diff[0] = moves[first] if first >= 0 else 0
        a, b = first + 1, int(np.searchsorted(starts, hi))
        np.add.at(diff, starts[a:b] - lo, moves[a:b] - np.where(np.arange(a, b) > 0, moves[np.arange(a, b) - 1], 0))
    return np.cumsum(diff, out=diff)


def scatter(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, out: np.ndarray) -> None:
    """out[i + shift of i] = data[i], a block at a time."""
    for lo in range(0, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        out[np.arange(lo, hi) + shifts(starts, moves, lo, hi)] = data[lo:hi]


def gather(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """The inverse: out[i] = data[i + shift of i]."""
    out = np.empty(size, np.uint8)
    for lo in range(0, size, BLOCK):
        hi = min(lo + BLOCK, size)
        out[lo:hi] = data[np.arange(lo, hi) + shifts(starts, moves, lo, hi)]
    return out


def _changes(starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and shifts of all parts that have bytes, in order of start."""
    starts, moves = starts.ravel()[sizes.ravel() > 0], moves.ravel()[sizes.ravel() > 0]
    order = np.argsort(starts, kind="stable")
    return starts[order], moves[order]


def transformed(data: np.ndarray, at: np.ndarray, draws: np.ndarray, fim_percent: int, spm_percent: int) -> dict[str, np.ndarray]:
    """Of rows data[at[i]:at[i+1]] with draws (rows, 4): n, form, prefix and middle in code points, the output's bytes and its offsets."""
    data, at = data[at[0] : at[-1]], at - at[0]
    rows = len(at) - 1
    ends = token_ends(data, at)
    n = counted(ends, at)
    before = np.concatenate([[0], np.cumsum(n)])[:-1]
    held, _ = mark_places(data)
    row = np.searchsorted(at, held, "right") - 1
    marked = np.zeros(rows, bool)
    marked[row[held + WIDTH <= at[row + 1]]] = True
    plain = (n == 0) | marked | (draws[:, 2] % 100 >= fim_percent)
    form = np.where(plain, PLAIN, np.where(draws[:, 3] % 100 < spm_percent, SPM, PSM))
    units = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    cut = np.repeat(at[:-1, None], 2, axis=1)
    some = (units > 0) & ~plain[:, None]
    cut[some] = places(ends, (before[:, None] + units - 1)[some]) + 1
    cut[plain] = at[1:][plain, None]
    start = np.column_stack([at[:-1], cut])
    size = np.diff(np.column_stack([start, at[1:]]), axis=1)  # of prefix, middle and suffix; a plain text is all prefix
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) + 3 * WIDTH * ~plain)])
    place = np.repeat(out_at[:-1, None], 3, axis=1)
    p, m, s = size.T
    for code, offsets in ((PSM, (0 * p, p + s + 2 * WIDTH, p + WIDTH)), (SPM, (s + WIDTH, s + p + 2 * WIDTH, 0 * p))):
        mine = form == code
        place[mine] += np.column_stack(offsets)[mine] + WIDTH
    out = np.empty(int(out_at[-1]), np.uint8)
    scatter(data, *_changes(start, size, place - start), out)
    for k, column in enumerate((0, 2, 1)):  # prefix, suffix, middle: their markers stand right before them
        where = place[~plain, column] - WIDTH
        out[where[:, None] + np.arange(WIDTH)] = np.frombuffer(MARKS[k].encode(), np.uint8)
    points = (data & 0xC0) != 0x80
    chars = counted(points, start[:, [0, 1, 1, 2]].ravel())[[4 * i + j for i in range(rows) for j in (0, 2)]].reshape(rows, 2) if rows else np.zeros((0, 2), np.int64)
    return {"n": n, "form": form, "prefix": chars[:, 0], "middle": chars[:, 1], "data": out, "at": out_at}


def restored(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts behind outputs data[at[i]:at[i+1]] and their forms: bytes and offsets. A cut text holds no markers but those put in."""
    data, at = data[at[0] : at[-1]], at - at[0]
    rows, cut = len(at) - 1, form != PLAIN
    where, kind = mark_places(data)
    row = np.searchsorted(at, where, "right") - 1
    inside = (where + WIDTH <= at[row + 1]) & cut[row]
    where, kind, row = where[inside], kind[inside], row[inside]
    if (np.bincount(row * 3 + kind, minlength=rows * 3).reshape(rows, 3)[cut] != 1).any():
        raise ValueError("an output does not hold each marker once")
    found = np.zeros((rows, 3), np.int64)
    found[row, kind] = where
    out_at = np.concatenate([[0], np.cumsum(np.diff(at) - 3 * WIDTH * cut)])
    p, s, m = found.T
    # where prefix, middle and suffix start in the output, and their bytes; a plain text is all prefix
    start = np.column_stack([p, m, s]) + WIDTH
    end = np.column_stack([np.where(form == PSM, s, m), at[1:], np.where(form == PSM, m, p)])
    start[~cut], end[~cut] = at[:-1][~cut, None], np.column_stack([at[1:], at[:-1], at[:-1]])[~cut]
    size = end - start
    place = out_at[:-1, None] + np.cumsum(size, axis=1) - size
    return gather(data, *_changes(place, size, start - place), int(out_at[-1])), out_at


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def _cut(batches: Iterator[pa.RecordBatch], fim_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column("text"))
        draws = np.column_stack([batch.column(c).to_numpy() for c in ("h1", "h2", "h3", "h4")]) if batch.num_rows else np.zeros((0, 4), np.int64)
        for i, j in C.slices(at, 4 << 20):
            r = transformed(data, at[i : j + 1], draws[i:j], fim_percent, spm_percent)
            plain = r["form"] == PLAIN
            yield pa.record_batch(
                [batch.column("doc_id").slice(i, j - i), pa.array(r["n"]), pa.array(FORMS).take(pa.array(r["form"])), pa.array(r["prefix"], mask=plain), pa.array(r["middle"], mask=plain), _strings(r["data"], r["at"]).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def _back(batches: Iterator[pa.RecordBatch], output: str, form: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column(output))
        codes = np.array([FORMS.index(f) for f in batch.column(form).to_pylist()], np.int64)
        others = [k for k, name in enumerate(batch.schema.names) if name != "restored"]
        for i, j in C.slices(at, 4 << 20):
            text = _strings(*restored(data, at[i : j + 1], codes[i:j])).cast(pa.string())
            yield pa.record_batch([*(batch.column(k).slice(i, j - i) for k in others), text], [*(batch.schema.names[k] for k in others), "restored"])


def draw(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the digest of `seed:doc_id`; a null id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n (tokens: words with the white space before them, and white space at the end), form, prefix_chars, middle_chars (code points, null if plain), output.

    Cuts, form and order are drawn from the document's id, so they are the same in every run. fim_percent of the texts are
    cut, spm_percent of these have the suffix first. A text that is empty (null counts as empty) or already holds a marker
    stays plain. Rows of one id are cut alike, each by its own length. Texts of any length are whole rows; tasks hold a
    long text, its output and a megabyte of shifts. Other columns of docs don't matter; an empty table comes back empty.
    """
    rows = C.text_rows(docs, id_col, text_col).select("doc_id", "text", *draw(seed, F.col("doc_id")))
    return rows.mapInArrow(C.mapped(_cut, fim_percent, spm_percent), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_middle(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """outputs with `restored` (replacing a column of that name): the text that an output and its form stand for. An output that lacks a marker or has one twice is an error."""
    kept = outputs.select(*(c for c in outputs.columns if c != "restored"))
    ddl = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", restored string"
    return kept.mapInArrow(C.mapped(_back, output, form), ddl)


def digests(outputs: DataFrame) -> DataFrame:
    """Outputs and restored texts as lower-case hex digests of their UTF-8 bytes."""
    both = restore_middle(outputs)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
