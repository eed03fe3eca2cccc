"""Connected components of an edge table, by distributed union-find (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, shared_dir, small

#: Up to so many edges, each node's smallest neighbour is broadcast (two longs a node, two nodes an edge at most).
FEW = 500_000
#: Beyond, only those of nodes with more edges than this are, so that no task has all edges of one.
HUB = 1000


def _with_least(edges: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with m of u in low (u, m, n). Hubs are at most a thousandth of the edges; their count is checked."""
    if few:
        return edges.join(F.broadcast(low.select("u", "m")), "u")
    hubs = low.where(F.col("n") > HUB).select("u", F.col("m").alias("hub"))
    marked = edges.join(small(hubs), "u", "left")
    rest = marked.where("hub is null").drop("hub").join(low.where(F.col("n") <= HUB).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub").alias("m")).union(rest.select("u", "v", "m"))


def connected(links: DataFrame) -> DataFrame:
    """(rep, comp) for every node of links (a, b); comp is the smallest node reachable. Edges are rehung on the smallest neighbour until nothing changes (Kiveris and others, 2014: the number of rounds grows with the logarithm of the edges); each round is written to the shared folder, in place of the last, and no component ever meets in one task."""
    spark = links.sparkSession

    def written(df: DataFrame, few: bool = False) -> tuple[DataFrame, str, tuple]:
        path = shared_dir(spark)
        (df.coalesce(4) if few else df).write.parquet(path)  # few edges are 8 MB at most
        edges = spark.read.schema("u long, v long").parquet(path)
        return edges, path, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, path, state = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while state != before:
        before, few = state, state[0] <= FEW
        # large star: every larger neighbour of a node hangs on the node's smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: every smaller neighbour of a node, and the node, hang on its smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        old = path
        edges, path, state = written(_with_least(large, low, few).select(pairs.alias("e")).select("e.*").where("u != v").distinct(), few)
        delete(spark, old)
    roots = edges.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("comp")).union(roots)
