"""Prefix trie of conversations, built by union-find over the common lengths of sorted neighbours.

Conversations are rows of turn digests, 16 bytes a turn, so byte order is turn order. They are sorted over the cluster by
ranges. A task has a run of that order: neighbours are joined in descending order of the turns that they share, every
merge makes a branching node (or adds a child to one of that depth), and what lies between a node and the one above it is
a chain. Only nodes on the paths of a run's first and last conversation can go on in another run. Those are handed on as
partial rows, contracted to one per node and run, and met by their prefix digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WIDTH = 16
#: First turns that a conversation takes from the head of its five, at most.
HEAD = 8
#: Bytes of sequences in a run, and of ids in one piece of a long list.
RUN, PIECE = 2 << 20, 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind: 0 a finished node, 1 a part of an open one, 2 ids that end at an open one. side: 0 on both paths, 1 on the first's, 2 on the last's.
PART = f"{NODE}, kind int, up binary, node binary, run long, side int, bytes long, first long, ids binary"
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(five, conv_id, turns): each conversation's turns in order, as structs of digest and UTF-8 bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    c = F.col("conv_id").cast("long")
    rows = conversations.where("conv_id is not null").select((c - c % 5).alias("five"), c.alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    # nulls come first in array_sort's order of structs
    return rows.groupBy("five", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def taken(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the head of its five."""
    return (F.crc32(conv_id.cast("string")) % (HEAD + 1)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes): per conversation the digests of its rebuilt turns, one after the other, and their texts' bytes."""
    own = C.materialize(turn_digests(conversations))
    heads = own.where("conv_id = five").select("five", F.slice("turns", 1, HEAD).alias("head"))
    h = taken(F.col("conv_id"))
    none = F.array().cast(own.schema["turns"].dataType)
    rest = F.when(F.size("turns") > h, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).otherwise(none)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), rest)
    whole = own.join(heads, "five", "left").select("conv_id", turns.alias("turns"))
    hex_ = F.concat_ws("", F.transform("turns", lambda t: F.hex(t["key"])))
    return whole.select("conv_id", F.unhex(hex_).alias("seq"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))


def shared_turns(seqs: list[bytes]) -> np.ndarray:
    """Turns that each sequence shares with the one before it."""
    out = np.zeros(len(seqs), np.int64)
    for i in range(1, len(seqs)):
        a, b = seqs[i - 1], seqs[i]
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out[i] = n // WIDTH
        else:
            x, y = (np.frombuffer(s, np.uint8, n) for s in (a, b))
            out[i] = int((x != y).argmax()) // WIDTH
    return out


class Forest:
    """The branching nodes and ends of one sorted run. Node k covers conversations lo[k] to hi[k] and shares depth[k] turns."""

    def __init__(self, turns: np.ndarray, shared: np.ndarray) -> None:
        n = len(turns)
        self.depth, self.lo, self.hi, self.up = [], [], [], []
        owner, top = list(range(n)), []  # union-find over conversations; each component's topmost node
        for i in range(n):
            top.append(self._node(int(turns[i]), i, i))

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        for i in (np.argsort(-shared[1:], kind="stable") + 1).tolist() if n else []:
            d, a, b = int(shared[i]), find(i - 1), find(i)
            x, y = top[a], top[b]
            owner[b] = a
            if self.depth[x] == d:  # it ends or branches here already
                if self.depth[y] == d:
                    self.up[y] = -2 - x  # the same node
                else:
                    self.up[y] = x
                self.hi[x] = self.hi[y]
            elif self.depth[y] == d:
                self.up[x], self.lo[y] = y, self.lo[x]
                top[a] = y
            else:
                top[a] = self._node(d, self.lo[x], self.hi[y])
                self.up[x] = self.up[y] = top[a]

    def _node(self, depth: int, lo: int, hi: int) -> int:
        self.depth.append(depth)
        self.lo.append(lo)
        self.hi.append(hi)
        self.up.append(-1)
        return len(self.depth) - 1

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """depth, lo, hi, up of the nodes that remain once those merged into one are one; up is -1 at the top."""
        depth, lo, hi, up = (np.array(x, np.int64) for x in (self.depth, self.lo, self.hi, self.up))
        real = np.arange(len(up))
        gone = up < -1
        while True:  # chains of merged nodes
            step = np.where(up[real] < -1, -2 - up[real], real)
            if (step == real).all():
                break
            real = step
        up = np.where(up >= 0, real[np.maximum(up, 0)], -1)
        number = np.cumsum(~gone) - 1
        return depth[~gone], lo[~gone], hi[~gone], np.where(up[~gone] >= 0, number[np.maximum(up[~gone], 0)], -1)


def _prefix_digests(seq: bytes, turns: int) -> list[bytes]:
    """Digests of the first 0, 1, ... turns."""
    h, out = hashlib.md5(), []
    out.append(h.digest())
    for d in range(turns):
        h.update(seq[d * WIDTH : (d + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


def _joined_ids(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _part(**columns) -> pa.Table:
    """Rows of PART; columns that aren't given are null."""
    size = len(next(iter(columns.values())))
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    made = {}
    for name, kind in (x.split() for x in PART.split(", ")):
        got = columns.get(name)
        made[name] = pa.nulls(size, kinds[kind]) if got is None else got.cast(kinds[kind]) if isinstance(got, pa.Array) else pa.array(got, kinds[kind])
    return pa.table(made)


def run_nodes(ids: np.ndarray, seqs: list[bytes], sizes: np.ndarray, run: int) -> pa.Table:
    """All nodes of one run as rows of PART. ids and seqs are sorted by sequence, then id; sizes: the bytes of all their turns, one after the other."""
    n = len(ids)
    turns = np.array([len(s) // WIDTH for s in seqs], np.int64)
    depth, lo, hi, up = Forest(turns, shared_turns(seqs)).compact()
    m, above = len(depth), np.maximum(up, 0)
    base = np.where(up >= 0, depth[above], -1)  # the chain of node k has depths base[k] + 1 to depth[k]; at the top it starts with the root
    count, least = hi - lo + 1, _least(ids, lo, hi)
    open_ = (lo == 0) | (hi == n - 1)  # and so is all above it
    kids, closed_kids = (np.bincount(up[x & (up >= 0)], minlength=m) for x in (np.ones(m, bool), ~open_))
    at = np.concatenate([[0], np.cumsum(depth - base)])
    k = np.repeat(np.arange(m), depth - base)
    d = np.arange(at[-1]) - at[k] + base[k] + 1
    start = np.concatenate([[0], np.cumsum(turns)])
    size = np.where(d > 0, np.append(sizes, 0)[start[lo[k]] + np.maximum(d, 1) - 1], 0)
    saves = (count[k] - 1) * size
    # leaves and savings of finished nodes with all below them; of open ones what hangs right under them and is finished
    leaves, saved = np.where(open_, 0, kids == 0), np.where(open_, 0, np.add.reduceat(saves, at[:-1]))
    for x in np.argsort(-depth, kind="stable").tolist():
        if up[x] >= 0 and not open_[x]:
            leaves[up[x]] += leaves[x]
            saved[up[x]] += saved[x]
    ends = turns[lo] == depth
    stop = _stops(turns, lo, hi, depth, ends)
    paths = {0: _prefix_digests(seqs[0], int(turns[0])), n - 1: _prefix_digests(seqs[-1], int(turns[-1]))}
    digest = lambda x, d: paths[0 if lo[x] == 0 else n - 1][d]
    bottom, top = np.arange(at[-1]) == at[k + 1] - 1, d == base[k] + 1

    done = np.flatnonzero(~open_[k])
    q = k[done]
    under = top[done] & open_[above[q]]  # the parent's least member may be in another run
    sha = [hashlib.sha256(_joined_ids(ids[lo[x] : stop[x]])).hexdigest() if ends[x] and not open_[x] else NO_IDS for x in range(m)]
    upto = np.cumsum(saves)
    below = saved[k] - (upto - saves - np.concatenate([[0], upto])[at[k]])  # saved from this depth down
    finished = _part(
        conv_id=least[q], depth=d[done], parent_conv_id=pa.array(np.where(top[done], least[above[q]], least[q]), mask=under), n_convs=count[q], n_children=np.where(bottom[done], kids[q], 1), n_leaves=leaves[q], saved_tokens=below[done],
        ends_sha256=pa.array([*sha, NO_IDS]).take(pa.array(np.where(bottom[done], q, m))), kind=np.zeros(len(done), np.int32), up=[digest(int(up[x]), int(depth[up[x]])) if u else None for x, u in zip(q.tolist(), under.tolist(), strict=True)],
    )
    wide = np.flatnonzero(open_[k])
    q, low = k[wide], bottom[wide]
    part = _part(
        conv_id=least[q], depth=d[wide], n_convs=count[q], n_children=np.where(low, closed_kids[q], 0), n_leaves=np.where(low, leaves[q], 0), saved_tokens=np.where(low, saved[q], 0), kind=np.ones(len(wide), np.int32),
        up=[digest(x, e - 1) if e else None for x, e in zip(q.tolist(), d[wide].tolist(), strict=True)], node=[digest(x, e) for x, e in zip(q.tolist(), d[wide].tolist(), strict=True)],
        run=np.full(len(wide), run), side=np.where((lo[q] == 0) & (hi[q] == n - 1), 0, np.where(lo[q] == 0, 1, 2)).astype(np.int32), bytes=size[wide],
    )
    pieces = [(x, a, min(a + PIECE // 8, int(stop[x]))) for x in np.flatnonzero(open_ & ends).tolist() for a in range(int(lo[x]), int(stop[x]), PIECE // 8)]
    listed = _part(depth=[int(depth[x]) for x, _, _ in pieces], kind=[2] * len(pieces), node=[digest(x, int(depth[x])) for x, _, _ in pieces], first=[int(ids[a]) for _, a, _ in pieces], ids=[_joined_ids(ids[a:b]) for _, a, b in pieces])
    return pa.concat_tables([finished, part, listed])


def _least(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ids[lo:hi + 1] for each range, from minima over powers of two."""
    table, span = [ids], 1
    while 2 * span <= len(ids):
        table.append(np.minimum(table[-1][:-span], table[-1][span:]))
        span *= 2
    level = np.log2(hi - lo + 1).astype(np.int64)
    out = np.empty(len(lo), np.int64)
    for q in np.unique(level).tolist():
        x = level == q
        out[x] = np.minimum(table[q][lo[x]], table[q][hi[x] + 1 - (1 << q)])
    return out


def _stops(turns: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the conversations that end at each node stop; they come first in its range."""
    change = np.append(np.flatnonzero(np.diff(turns)) + 1, len(turns))
    same = change[np.searchsorted(change, lo, "right")]  # all of one length and range are equal up to here
    return np.where(ends, np.minimum(same, hi + 1), lo)


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if got:
        table = pa.Table.from_batches(got)
        sizes = table.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        nodes = run_nodes(table.column("conv_id").to_numpy(), table.column("seq").to_pylist(), sizes, TaskContext.get().partitionId())
        yield from nodes.combine_chunks().to_batches(50_000)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends): one digest over all pieces of a node's ids, which come in order."""
    now, h = None, None
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node != now:
                if h is not None:
                    yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends"])
                now, h = node, hashlib.sha256(ids)
            else:
                h.update(b",")
                h.update(ids)
    if h is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over all rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation takes its first turns, up to eight, from the first of its five (ids that differ in the last step of
    five), as many as its id's checksum says, and goes on with its own after as many. Turns are in order of `turn`, nulls
    first; of turns with one number the one with the smaller digest is first, and repeated rows are turns of their own.
    Null role or text is empty. Rows without conv_id belong to no conversation. Without conversations there is no node,
    not even the root. Texts of any length leave the job as digests at once; a conversation's digests (24 bytes a turn)
    are one row, so are those of copies, each by itself. Other columns don't matter.
    """
    whole = C.materialize(rebuilt(conversations))
    runs = C.parts_for(whole, "seq", RUN >> 20)
    sorted_ = whole.repartitionByRange(runs, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = C.materialize(sorted_.mapInArrow(C.mapped(_noded), PART))
    names = [x.split()[0] for x in NODE.split(", ")]

    # nodes on the borders of runs: their parts meet by the digest of what they share
    some = parts.where("kind = 1")
    merged = some.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"), F.max("up").alias("up"), F.min("run").alias("owner"))
    kids = merged.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("open_kids"))
    nodes = C.materialize(merged.join(kids, "node", "left").withColumn("n_children", F.col("kids") + F.coalesce("open_kids", F.lit(0))).drop("kids", "open_kids"))
    few = lambda *c: C.small(nodes.select(*c), 200_000)
    # each run adds what it has under a node, and for the open nodes that it owns their own share
    mine = F.col("run") == F.col("owner")
    own = some.select("node", "run", "side", "depth", "bytes", "n_leaves", "saved_tokens").join(few("node", "owner", "n_convs", "n_children"), "node")
    leaves = F.col("n_leaves") + F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)
    saved = F.col("saved_tokens") + F.when(mine, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    own = own.select("node", "run", "side", "depth", leaves.alias("l"), saved.alias("s"))
    path = Window.partitionBy("run", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sides = own.where("side > 0").groupBy("run").agg(F.sum("l").alias("side_l"), F.sum("s").alias("side_s")).withColumn("side", F.lit(0))
    down = own.withColumns({"l": F.sum("l").over(path), "s": F.sum("s").over(path)}).join(sides, ["run", "side"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(F.col(f"side_{c}"), F.lit(0)))
    sums = down.groupBy("node").agg(total("l").alias("n_leaves"), total("s").alias("saved_tokens"))
    ends = parts.where("kind = 2").select("node", "first", "ids").repartition("node").sortWithinPartitions("node", "first").mapInArrow(C.mapped(_hashed), "node binary, ends string")
    parents = few(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    met = nodes.join(sums, "node").join(ends, "node", "left").join(parents, "up", "left")
    met = met.withColumns({"parent_conv_id": F.col("up_conv"), "ends_sha256": F.coalesce("ends", F.lit(NO_IDS))}).select(*names)

    finished = parts.where("kind = 0")
    known = finished.where("up is null").select(*names)
    hung = finished.where("up is not null").drop("parent_conv_id").join(parents, "up").withColumn("parent_conv_id", F.col("up_conv")).select(*names)
    return known.union(hung).union(met)
