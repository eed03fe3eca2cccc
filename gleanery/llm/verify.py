"""Components over exactly decided links of sets that meet in buckets, without a row for any pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected
from .minhash import _blocks_of, _links, _starred

#: Comparisons of members up to which buckets are compared in full at once; above, stars that join members come first.
AT_ONCE = 200_000
#: Blocks up to which all members of buckets that hang together are compared; each set travels once a block.
WIDE = 8


def different(buckets: DataFrame) -> DataFrame:
    """(b, rep) of buckets (b, rep) with at least two members, each once; of buckets with the same members one."""
    rows = buckets.distinct()
    keys = rows.groupBy("b").agg(F.count("*").alias("g"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("g > 1")
    kept = C.materialize(keys.groupBy("g", "x", "y").agg(F.min("b").alias("b")).select("b"))
    return rows.join(C.small(kept), "b")


def _with_component(df: DataFrame, labels: DataFrame | None, column: str = "rep", name: str = "comp") -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(column))
    return df.join(labels.select(F.col("rep").alias(column), F.col("comp").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _star(open_: DataFrame, sets: DataFrame, percent: int, labels: DataFrame | None, turn: int) -> DataFrame:
    """Links of every member with the pivot of one of its buckets. The first pivot is the smallest member, later ones are drawn by a hash."""
    order = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    at = _with_component(open_, labels)
    pivots = at.groupBy("b").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("pivot"), F.col("comp").alias("pivot_comp"))).alias("p")).select("b", "p.pivot", "p.pivot_comp")
    star = at.join(pivots, "b").where("comp != pivot_comp").groupBy("rep").agg(F.min("pivot").alias("grp"))
    star = C.materialize(star.join(sets.select("rep", "n"), "rep"))
    sizes = _blocks_of(star, "grp")
    zero = F.lit(0).cast("long")
    points = star.join(sizes, "grp").select("grp", F.pmod(F.xxhash64("rep"), "nb").alias("ia"), "rep")
    centres = sizes.select("grp", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("ia"), F.col("grp").alias("rep"))
    return _links(points.union(centres).join(sets, "rep").select("grp", "ia", zero.alias("ib"), "rep", "n", "sh"), percent, _starred)


def _apart(buckets: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, int]:
    """Of buckets whose members are in several components: (b, main, g, c), the largest component, members and its members; and how many comparisons are left."""
    per = _with_component(buckets, labels).groupBy("b", "comp").agg(F.count("*").alias("c"))
    left = per.groupBy("b").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("g"), F.count("*").alias("comps")).where("comps > 1")
    left = C.materialize(left.select("b", F.col("m.comp").alias("main"), "g", F.col("m.c").alias("c")))
    return left, int(left.agg(F.sum((F.col("g") - F.col("c")).cast("double") * F.col("g"))).first()[0] or 0)


def components(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(rep, comp) of what has a link; None without links. comp is the smallest rep reachable.

    buckets: (b, rep), in which any two sets that link must meet; sets: (rep, n, sh: sorted 8-byte hashes). Sets link with
    100 * common >= percent * (size of the union). Buckets that hang together and fit in a few blocks are compared there,
    so that their sets travel that often. While others hold much to compare, each member is compared with one pivot a round, as
    long as that takes a third of the comparisons away; then whatever is outside of a bucket's largest component is
    compared with all of the bucket, in blocks of at most 512 members. So every pair that meets is decided or already
    connected, and only links that join something leave a task.
    """
    buckets = C.materialize(different(buckets))
    close, few = _closures(buckets, sets)
    links = _links(_together(close, few, sets), percent)
    large = C.materialize(buckets.join(close, "rep").join(few.select("close"), "close", "left_anti").select("b", "rep"))
    left, work = _apart(large, None)
    labels, turn = None, 0
    while work > AT_ONCE:
        open_ = large.join(C.small(left.select("b")), "b", "left_semi")
        more = _star(open_, sets, percent, labels, turn)
        if more.take(1):
            links = links.union(more)
            labels = C.materialize(connected(links))
        before, turn = work, turn + 1
        left, work = _apart(large, labels)
        if 3 * work > 2 * before and turn > 1:
            break
    if work:
        links = links.union(_links(_blocks(large, left, labels, sets), percent))
    return C.materialize(connected(links)) if links.take(1) else None


def _closures(at: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, close): which buckets (b, rep) hang together, by their smallest member; and (close, nb) of those that fit in a few blocks."""
    firsts = at.groupBy("b").agg(F.min("rep").alias("first"))
    close = C.materialize(connected(at.join(firsts, "b").select(F.col("first").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("comp", "close"))
    return close, C.small(C.materialize(_blocks_of(close.join(sets.select("rep", "n"), "rep"), "close").where(F.col("nb") <= WIDE).select("close", "nb")))


def _together(close: DataFrame, few: DataFrame, sets: DataFrame) -> DataFrame:
    """All of them compared with each other, two blocks at a time."""
    mine, other = F.col("i"), F.col("j")
    at = close.join(few, "close").select("close", "rep", F.pmod(F.xxhash64("rep"), "nb").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"))
    # places below zero, as the same number may name a bucket's blocks
    return at.select(F.col("close").alias("grp"), (-1 - F.least(mine, other)).alias("ia"), F.greatest(mine, other).alias("ib"), "rep").join(sets, "rep").select("grp", "ia", "ib", "rep", "n", "sh")


def _blocks(buckets: DataFrame, left: DataFrame, labels: DataFrame | None, sets: DataFrame) -> DataFrame:
    """The blocks in which all that is left to compare meets. Unfinished buckets that hang together and fit in a few blocks are one; of others each is dealt into blocks by itself."""
    at = C.materialize(_with_component(buckets.join(C.small(left.select("b")), "b", "left_semi"), labels).join(sets.select("rep", "n"), "rep"))
    close, few = _closures(at, sets)
    zero = F.lit(0).cast("long")
    rest = at.join(close, "rep").join(few.select("close"), "close", "left_anti").select("b", "rep", "comp", "n")
    sized = _blocks_of(rest, "b").drop("g").join(left, "b").withColumn("nr", F.ceil(F.col("nb") * (F.col("g") - F.col("c")) / F.col("g"))).select("b", "main", "nb", "nr")
    rest = C.materialize(rest.join(C.small(C.materialize(sized), 200_000), "b"))
    alone = rest.where("nb = 1").select(F.col("b").alias("grp"), zero.alias("ia"), zero.alias("ib"), "rep")
    large = rest.where("nb > 1")
    all_ = large.select("b", F.pmod(F.xxhash64("rep"), "nb").alias("ia"), F.explode(F.sequence(zero, F.col("nr") - 1)).alias("ib"), "rep")
    others = large.where("comp != main").select("b", F.explode(F.sequence(zero, F.col("nb") - 1)).alias("ia"), F.pmod(F.xxhash64("rep"), "nr").alias("ib"), "rep")
    return _together(close, few, sets).union(alone.union(all_).union(others).join(sets, "rep").select("grp", "ia", "ib", "rep", "n", "sh"))
