"""Exact n-gram Jaccard join of whole texts: a size-aware heavy-light join.

Two sets link when 100 * common >= percent * (size of the union). Small sets are enumerated: of sizes a and b at least
o(a, b) elements are common, so linked sets have a subset of that fixed size in common, and every such subset is a key.
Large sets scan inverted lists: ordered by hash, a set's first n - ceil(n * percent / 100) + 1 elements hold one that
is common. The size from which sets count as large is the one that makes subsets plus scanned list entries fewest. A
list of very many sets says little of any two of them (a passage that half of the texts hold makes such lists), so sets
that share an entry are told apart by parts: linked sets differ in at most d elements, so of d + 1 parts (elements dealt
out by hash) one is the same in both. Sets without a part that another has as well need no lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .minhash import _sets, shingle_sets
from .verify import components

U64 = np.uint64
#: Sizes that may be enumerated.
SMALL = 64
#: Subsets and parts that are held at once.
AT_ONCE = 1 << 18


def needed(a: int, b: int, percent: int) -> int:
    """Elements that sets of sizes a and b have in common at least if they link."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int) -> list[int]:
    """Sizes with which a set of size n can link without being equal."""
    some = range(-(-percent * n // 100), 100 * n // percent + 1)
    return [m for m in some if (o := needed(n, m, percent)) <= min(n, m) and not (m == n and o == n)]


def subsets(n: int, percent: int) -> int:
    """Keys of an enumerated set of size n."""
    return sum(comb(n, needed(n, m, percent)) for m in partners(n, percent))


def boundary(stats: list[tuple[int, int, int]], percent: int) -> int:
    """The size from which sets are large. stats: (size, sets, entries of their lists that are scanned) below SMALL; the least sum of subsets and scanned entries decides, then the smaller size."""
    sizes = sorted(stats)
    costs = {0: sum(scan for _, _, scan in sizes)}
    enumerated = 0
    for n, sets, scan in sizes:
        enumerated += sets * subsets(n, percent)
        costs[n + 1] = enumerated + sum(s for m, _, s in sizes if m > n)
    return min(costs, key=lambda x: (costs[x], x))


def levels(most: int, percent: int) -> list[int]:
    """Bounds of size levels, from 1 on, so that linked sets are on one level or on neighbouring ones."""
    out = [1]
    while len(out) < 3 or out[-3] <= most:
        out.append(100 * out[-1] // percent + 1)
    return out


def part_keys(x: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the parts of each set of mixed hashes x[at[i]:at[i+1]] on its own level, with their offsets, and the same on the level below. Linked sets of one level agree in a key of their own level, of neighbouring levels in one that is the upper set's level below."""
    size = np.diff(at)
    bounds = np.array(levels(int(size.max(initial=1)), percent))
    level = np.repeat(np.searchsorted(bounds, size, "right") - 1, 2)
    level[1::2] -= 1
    parts = ((100 - percent) * 2 * (bounds[level + 2] - 1) // (100 + percent) + 1) * (np.repeat(size > 0, 2) & (level >= 0))
    upto = np.concatenate([[0], np.cumsum(parts)])
    sums = np.zeros(int(upto[-1]), np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    dealt = C.mix(x + U64(0xD1B54A32D192ED03)) >> U64(20)
    for k in (0, 1):
        of = parts[2 * row + k].astype(np.uint64)
        some = of > 0
        np.add.at(sums, upto[2 * row[some] + k] + (dealt[some] % of[some]).astype(np.int64), x[some])
    number = np.arange(upto[-1]) - np.repeat(upto[:-1], parts)
    keys = C.mix(sums + C.mix(np.repeat(level, parts).astype(np.uint64) << U64(32) | number.astype(np.uint64)))
    own = np.repeat(np.arange(len(parts)) % 2 == 0, parts)
    return keys[own], np.concatenate([[0], np.cumsum(parts[::2])]), keys[~own], np.concatenate([[0], np.cumsum(parts[1::2])])


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _remixed(sets: np.ndarray) -> np.ndarray:
    """Hashes whose sums say nothing about those of the lists' order."""
    return C.mix(sets * U64(0x9FB21C651E98DF25))


def _sized(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Size, 128-bit key and part keys of each text's set."""
    for batch in batches:
        data, at = C.binary(batch.column("text"))
        for i, j in C.slices(at, 1 << 20):
            sets, bounds = shingle_sets(data, at[i : j + 1], words)
            keys = []
            for x in (sets, C.mix(sets * U64(0xC2B2AE3D27D4EB4F))):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
                keys.append(pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)))
            keys_, at_, below, below_at = part_keys(_remixed(sets), bounds, percent)
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds), pa.int64()), *keys, _lists(keys_, at_), _lists(below, below_at)], ["doc_id", "n_shingles", "k1", "k2", "parts", "below"])


@lru_cache(256)
def _left_out(n: int, k: int) -> np.ndarray:
    """All choices of k of n places."""
    return np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def _read_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets' hashes one after the other, their offsets and owners."""
    data, at = C.binary(batch.column("sh"))
    return np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint64), (at - at[0]) // 8, batch.column("rep").to_numpy()


def _posted(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(el, rep, n): the entries of each set in the inverted lists, the first of its hashes in order."""
    for batch in batches:
        sets, at, reps = _read_sets(batch)
        for i, j in C.slices(at, AT_ONCE):
            n, some = np.diff(at[i : j + 1]), sets[at[i] : at[j]]
            first = n - -(-percent * n // 100) + 1
            listed = np.arange(len(some)) - np.repeat(at[i:j] - at[i], n) < np.repeat(first, n)
            yield pa.record_batch([pa.array(some[listed].view(np.int64)), pa.array(np.repeat(reps[i:j], first), pa.int64()), pa.array(np.repeat(n, first), pa.int64())], ["el", "rep", "n"])


def _enumerated(batches: Iterator[pa.RecordBatch], percent: int, below: int) -> Iterator[pa.RecordBatch]:
    """(b, rep): a key for each subset that a linked set of some size must have too. A subset's hash is the sum of its elements'."""
    for batch in batches:
        elems, at, reps = _read_sets(batch)
        elems, sizes = _remixed(elems), np.diff(at)
        for n in np.unique(sizes[sizes < below]).tolist():
            rows = np.flatnonzero(sizes == n)
            for m in partners(n, percent):
                out, tag = _left_out(n, n - needed(n, m, percent)), C.mix(np.array([min(n, m) << 32 | max(n, m)], np.uint64))
                step = max(1, AT_ONCE // max(out.size, n))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    x = elems[at[some][:, None] + np.arange(n)]
                    keys = C.mix(x.sum(axis=1, dtype=np.uint64)[:, None] - x[:, out].sum(axis=2, dtype=np.uint64) + tag)
                    yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(reps[some], len(out)), pa.int64())], ["b", "rep"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of the text's set of `words`-word shingles), component_id (smallest doc_id reachable over links, itself included).

    The join is exact: any two linked sets meet under a common subset, in an inverted list, or under a common part, and
    pairs that meet are decided on their full sets. Equal sets are one class first, so copies cost one row. Only classes
    that share a list entry and a part have their sets written; no pair ever becomes a row. A text with fewer
    words has its whole sequence as one shingle; null texts and texts without words are empty, linked with nothing, and
    are their own component. Rows of one doc_id share a component; if their texts differ, links of one of them count. A
    null doc_id is linked with nothing and has a null component_id. Texts of any length are whole rows; other columns
    don't matter; an empty table comes back empty.
    """
    rows = C.text_rows(docs, id_col, text_col)
    sized = C.materialize(rows.mapInArrow(C.mapped(_sized, words, percent), "doc_id long, n_shingles long, k1 long, k2 long, parts array<long>, below array<long>"))
    key = ["k1", "k2", "n_shingles"]
    classes = C.materialize(sized.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep")))
    large_enough = classes.where(100 * F.col("n_shingles") >= percent * (F.col("n_shingles") + 1)).select(F.col("rep").alias("doc_id"))
    labels = _joined(rows, sized.join(C.small(large_enough), "doc_id", "left_semi"), words, percent)
    named = classes if labels is None else classes.join(labels, "rep", "left")
    named = named.select(*key, F.coalesce("comp", "rep").alias("comp") if labels is not None else F.col("rep").alias("comp"))
    out = sized.drop("parts", "below").join(named, key, "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"))


def _joined(rows: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame | None:
    """(rep, comp) over the links of the sets that stand for their class."""
    on = lambda c, own: reps.select(F.col("doc_id").alias("rep"), F.explode(c).alias("b"), F.lit(own).alias("own"))
    parts = on("parts", 1).union(on("below", 0))
    # sets of the upper level only meet on a level of their own
    twice = C.materialize(parts.groupBy("b").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 and own = 1").select("b"))
    parts = C.materialize(parts.select("rep", "b").join(C.small(twice), "b"))
    alive = C.materialize(parts.select("rep").distinct())
    sets = rows.join(C.small(alive.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi").mapInArrow(C.mapped(_sets, words), "rep long, sh binary")
    sets = C.materialize(sets.groupBy("rep").agg(F.min("sh").alias("sh")).withColumn("n", F.octet_length("sh").cast("long") / 8))

    entries = sets.select("rep", "sh").mapInArrow(C.mapped(_posted, percent), "el long, rep long, n long")
    shared = entries.groupBy("el").agg(F.count("*").alias("c"), F.max("n").alias("most")).where("c > 1")
    met = C.materialize(entries.join(shared, "el"))
    stats = sets.where(F.col("n") < SMALL).groupBy(F.col("n").cast("long").alias("n")).agg(F.count("*").alias("sets"))
    stats = stats.join(met.where(F.col("n") < SMALL).groupBy("n").agg(F.sum("c").alias("scanned")), "n", "left")
    large = boundary([(r.n, r.sets, r.scanned or 0) for r in stats.collect()], percent)  # one row a size below SMALL

    small = sets.where(F.col("n") < large).select("rep", "sh").mapInArrow(C.mapped(_enumerated, percent, large), "b long, rep long")
    listed = C.materialize(met.where(F.col("most") >= large).select("rep").distinct())
    return components(small.union(parts.join(C.small(listed), "rep", "left_semi").select("b", "rep")), sets, percent)
