"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected

U64 = np.uint64
SLOTS, ROWS = 64, 4
#: Members, and shingles, of a block whose sets are compared with each other in one task.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, one row after the other; len + 1 offsets. Rows with fewer words have their whole sequence as one shingle, rows without any have none."""
    h, row, bounds = C.words_of(data, at)
    counts, n = np.diff(bounds), len(at) - 1
    last = np.repeat(bounds[1:], counts)
    full = np.arange(len(h)) + words <= last
    sh = np.zeros(len(h), np.uint64)
    for j in range(words):
        sh[: len(h) - j] = sh[: len(h) - j] * U64(0x9E3779B97F4A7C15) + h[j:]
    keep_row, keep = row[full], C.mix(sh[full])
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            have = j < counts[few]
            whole[have] = whole[have] * U64(0x9E3779B97F4A7C15) + h[bounds[few[have]] + j]
        keep_row, keep = np.concatenate([keep_row, few]), np.concatenate([keep, C.mix(whole + counts[few].astype(np.uint64))])
    order = np.lexsort((keep, keep_row))
    keep_row, keep = keep_row[order], keep[order]
    if len(keep):
        first = np.concatenate([[True], (keep[1:] != keep[:-1]) | (keep_row[1:] != keep_row[:-1])])
        keep_row, keep = keep_row[first], keep[first]
    return keep, np.searchsorted(keep_row, np.arange(n + 1))


def super_minhash(sets: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows, slots). Each element draws a random permutation of the slots step by step; in step j its next slot gets j + r, r in [0, 1), where that is less. A row stops once every slot is filled, as later steps can only offer more. Slots of empty rows stay at the largest value."""
    n = len(bounds) - 1
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    counts = np.diff(bounds)
    elems, row = sets, np.repeat(np.arange(n), counts)
    perm = None
    for j in range(slots):
        r = C.mix(elems + U64(0x9E3779B97F4A7C15) * U64(j + 1))
        k = j + ((r >> U64(40)) % U64(slots - j)).astype(np.int64)
        value = (U64(j) << U64(32)) | (r & U64(0xFFFFFFFF))
        if perm is None:
            slot = k
        else:
            i = np.arange(len(elems))
            slot = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
            perm[i, j] = slot
        np.minimum.at(out, row * slots + slot, value)
        left = (out.reshape(n, slots).max(axis=1) == np.iinfo(np.uint64).max)[row]
        if not left.any():
            break
        if perm is None:
            perm = np.tile(np.arange(slots, dtype=np.uint8), (int(left.sum()), 1))
            i = np.arange(len(perm))
            perm[i, k[left]], perm[:, 0] = 0, k[left]
        else:
            perm = perm[left]
        elems, row = elems[left], row[left]
    return out.reshape(n, slots)


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column("text"))
        for i, j in C.slices(at, 1 << 20):
            sets, bounds = shingle_sets(data, at[i : j + 1], words)
            n = j - i
            sig = super_minhash(sets, bounds)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets)])
            sums2 = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(sets * U64(0xC2B2AE3D27D4EB4F)))])
            low = (sig & U64(0xFFFFFFFF)).astype("<u4")  # with the step, this is what has to agree; the step adds little
            yield pa.record_batch(
                [batch.column("doc_id").slice(i, n), pa.array(np.diff(bounds), pa.int64()), pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)), pa.array((sums2[bounds[1:]] - sums2[bounds[:-1]]).view(np.int64)), pa.array([x.tobytes() for x in low], pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "sig"],
            )


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, a 128-bit key of the set (k1, k2), the signature."""
    return docs.mapInArrow(C.mapped(_signed, words), "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column("sig"))
        n = batch.num_rows
        sig = data[at[0] : at[-1]].view("<u4").astype(np.uint64).reshape(n, SLOTS // ROWS, ROWS)
        key = np.zeros((n, SLOTS // ROWS), np.uint64) + np.arange(SLOTS // ROWS, dtype=np.uint64) * U64(0xA24BAED4963EE407)
        for j in range(ROWS):
            key = C.mix(key * U64(0x9E3779B97F4A7C15) + sig[:, :, j])
        yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), SLOTS // ROWS), pa.int64())], ["bkey", "rep"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.binary(batch.column("text"))
        for i, j in C.slices(at, 1 << 20):
            sets, bounds = shingle_sets(data, at[i : j + 1], words)
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["rep", "sh"])


def _common(elems: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the intersections of m sets, all at once: hashes held by one set only don't count, those held by a few add to their pairs, the others are columns of a 0/1 matrix that is multiplied with itself."""
    order = np.argsort(elems, kind="stable")
    elems, owner = elems[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], elems[1:] != elems[:-1]]))
    df = np.diff(np.append(start, len(elems)))
    out = np.zeros(m * m)
    for d in range(2, 9):
        at = start[df == d]
        for i in range(d):
            for j in range(i + 1, d):
                x, y = owner[at + i], owner[at + j]
                out += np.bincount(np.minimum(x, y) * m + np.maximum(x, y), minlength=m * m) if len(at) else 0
    out = out.reshape(m, m)
    out = out + out.T
    many = np.flatnonzero(df > 8)
    for k in range(0, len(many), 4096):
        part = many[k : k + 4096]
        x = np.zeros((m, len(part)), np.float32)
        size = df[part]
        run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start[part], size)
        x[owner[run], np.repeat(np.arange(len(part)), size)] = 1
        out += x @ x.T
    return out


def block_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Of a block of sets: for each the first one that it is connected with over pairs of the similarity. Every pair is decided on the full sets."""
    m, n = len(sets), np.array([len(x) for x in sets])
    both = _common(np.concatenate(sets), np.repeat(np.arange(m), n), m)
    near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    label = np.arange(m)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], m).min(axis=1))
        if (least == label).all():
            return label
        label = least[least]


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links of a bin of blocks (grp, ia, ib); each block is compared by itself."""
    ids = [table.column(c).to_numpy() for c in ("grp", "ia", "ib", "rep")]
    order = np.lexsort(ids[::-1])
    grp, ia, ib, rep = (x[order] for x in ids)
    data, at = C.binary(table.column("sh"))
    a, b = at[:-1][order], at[1:][order]
    same = np.ones(len(rep), bool)
    same[:1] = False
    for x in (grp, ia, ib):
        same[1:] &= x[1:] == x[:-1]
    starts = np.flatnonzero(~same)
    out = []
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)], strict=True):
        keep = [k for k in range(lo, hi) if k == lo or rep[k] != rep[k - 1]]
        if len(keep) > 1:
            label = block_links([data[a[k] : b[k]].view(np.uint64) for k in keep], percent)
            out += [(rep[keep[x]], rep[keep[i]]) for i, x in enumerate(label) if x != i]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _starred(table: pa.Table, percent: int) -> pa.Table:
    """Links of a bin of stars (grp, ia): every set is compared with that of the star's centre, whose id is grp."""
    grp, ia, rep = (table.column(c).to_numpy() for c in ("grp", "ia", "rep"))
    order = np.lexsort((rep, ia, grp))
    grp, ia, rep = (x[order] for x in (grp, ia, rep))
    data, at = C.binary(table.column("sh"))
    a, b = at[:-1][order], at[1:][order]
    starts = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (ia[1:] != ia[:-1])])) if len(grp) else grp
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)], strict=True):
        centre = next(k for k in range(lo, hi) if rep[k] == grp[k])
        core = data[a[centre] : b[centre]].view(np.uint64)
        others = [k for k in range(lo, hi) if rep[k] != grp[k]]
        if not others:
            continue
        sets = [data[a[k] : b[k]].view(np.uint64) for k in others]
        size = np.array([len(x) for x in sets])
        elems = np.concatenate(sets)
        found = np.minimum(np.searchsorted(core, elems), len(core) - 1)
        both = np.bincount(np.repeat(np.arange(len(sets)), size), core[found] == elems, len(sets))
        near = np.array(others)[100 * both >= percent * (size + len(core) - both)]
        out_a.append(np.full(len(near), grp[centre]))
        out_b.append(rep[near])
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _links(blocks: DataFrame, percent: int, compare=_linked) -> DataFrame:
    """blocks: (grp, ia, ib, rep, n, sh), dealt into bins of about half a million shingles."""
    blocks = C.materialize(blocks)
    bins = max(8, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // 500_000))
    bin_ = F.pmod(F.xxhash64("grp", "ia", "ib"), F.lit(bins)).alias("bin")
    return C.materialize(blocks.select(bin_, "grp", "ia", "ib", "rep", "sh").groupBy("bin").applyInArrow(C.grouped(compare, percent), "a long, b long"))


def _blocks_of(df: DataFrame, key: str) -> DataFrame:
    """(key, g, nb): members of each group and the blocks that they make."""
    sizes = df.groupBy(key).agg(F.count("*").alias("g"), F.sum("n").alias("gn"))
    return sizes.select(key, "g", F.ceil(F.greatest(F.col("g") / BLOCK, F.col("gn") / BLOCK_SHINGLES)).alias("nb"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links of Jaccard similarity >= percent / 100), kept (doc_id = component_id).

    Equal sets are one class first, so that any number of copies costs one row. Class representatives are banded (16
    bands of 4 slots: a link of similarity 0.8 is missed with a chance below 3e-4, one of 0.85 below 1e-5). Every member
    is compared with the smallest of its bucket-mates, on the full sets; union-find over the links gives components.
    Bucket-mates that are still apart put their components into one group, and within a group every pair of different
    components is decided on the full sets, in blocks of at most 512 members: in a larger group, whatever is not in its
    main component is compared, block by block, with all members. So no link is left out and yet no pair ever becomes a
    row. Texts without words are linked with nothing; rows of one doc_id are one document; a null doc_id gets a null
    component_id and is kept; other columns don't matter.
    """
    rows = C.text_rows(docs, id_col, text_col)
    sig = C.materialize(signatures(rows, words))
    key = ["k1", "k2", "n_shingles"]
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = C.materialize(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))
    members = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "sig").mapInArrow(C.mapped(_bands), "bkey long, rep long")
    firsts = members.groupBy("bkey").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size")
    mates = C.materialize(members.join(firsts, "bkey").where("rep != first").select("first", "rep").distinct())
    ids = C.materialize(mates.select("rep").union(mates.select("first")).distinct())
    texts = rows.join(C.small(ids.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(C.mapped(_sets, words), "rep long, sh binary").groupBy("rep").agg(F.first("sh").alias("sh"))
    sets = C.materialize(sets.withColumn("n", F.octet_length("sh") / 8))
    zero = F.lit(0).cast("long")
    # stars: each member and the smallest of its mates; a large star is dealt out with its centre in every part
    star = mates.groupBy("rep").agg(F.min("first").alias("grp"))
    sizes = _blocks_of(star.join(sets.select("rep", "n"), "rep"), "grp")
    points = star.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("rep"), "nb").alias("ia"), "rep")
    centres = sizes.select("grp", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("ia"), F.col("grp").alias("rep"))
    stars = points.union(centres).join(sets, "rep").select("grp", "ia", zero.alias("ib"), "rep", "n", "sh")
    labels = C.materialize(connected(_links(stars, percent, _starred)))
    # mates that are still apart
    side = lambda c: labels.select(F.col("rep").alias(c), F.col("comp").alias(f"{c}_comp"))
    apart = mates.join(side("rep"), "rep", "left").join(side("first"), "first", "left")
    apart = C.materialize(apart.select(F.coalesce("rep_comp", "rep").alias("a"), F.coalesce("first_comp", "first").alias("b")).where("a != b").distinct())
    if apart.take(1):
        groups = C.materialize(connected(apart).select(F.col("rep").alias("comp"), F.col("comp").alias("grp")))
        held = sets.select("rep", "n").join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(groups, "comp")
        held = C.materialize(held.join(_blocks_of(held, "grp"), "grp"))
        per = held.groupBy("grp", "comp", "nb", "g").agg(F.count("*").alias("c"))
        main = per.groupBy("grp").agg(F.max(F.struct("c", "comp")).alias("m"), F.first("g").alias("g"), F.first("nb").alias("nb"))
        main = main.select("grp", F.col("m.comp").alias("main"), F.ceil(F.col("nb") * (F.col("g") - F.col("m.c")) / F.col("g")).alias("nr"))
        at = held.join(main, "grp")
        whole = at.where("nb = 1").select("grp", zero.alias("ia"), zero.alias("ib"), "rep")
        large = at.where("nb > 1")
        all_ = large.select("grp", F.pmod(F.xxhash64("rep"), "nb").alias("ia"), F.explode(F.sequence(zero, F.col("nr") - 1)).alias("ib"), "rep")
        rest = large.where("comp != main").select("grp", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("ia"), F.pmod(F.xxhash64("rep"), "nr").alias("ib"), "rep")
        blocks = whole.union(all_).union(rest).join(sets, "rep").select("grp", "ia", "ib", "rep", "n", "sh")
        more = _links(blocks, percent)
        if more.take(1):
            labels = C.materialize(connected(more.union(labels.where("rep != comp").select(F.col("comp").alias("a"), F.col("rep").alias("b")))))
    named = classes.join(labels, "rep", "left").select(*key, F.coalesce("comp", "rep").alias("comp"))
    out = sig.drop("sig").join(named, key, "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
