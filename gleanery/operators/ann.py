"""Approximate nearest neighbours: vectors in lists by their nearest centroid; a query reads the lists of the centroids nearest to it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize
from .retrieval import CANDIDATES, _nearest, matrix, nearest, ranked


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(vectors: DataFrame, lists: int, sample: int = 200_000, seed: int = 7) -> np.ndarray:
    """Unit centroids, fitted on at most `sample` vectors in the order of a hash of their id; every vector is indexed."""
    some = vectors.where("embedding is not null").orderBy(F.xxhash64("id")).limit(sample)
    model = KMeans(k=lists, seed=seed, maxIter=8).fit(some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    return _unit(np.array(model.clusterCenters()))


def _closest(batches, centers: np.ndarray, column: str, n: int):
    for batch in batches:
        lists = np.argsort(-(matrix(batch.column(column)).reshape(batch.num_rows, -1) @ centers.T), axis=1, kind="stable")[:, :n] if batch.num_rows else np.zeros((0, n), np.int64)
        yield pa.record_batch([*batch.columns, pa.array(list(lists), pa.list_(pa.int64()))], [*batch.schema.names, "lists"])


def in_lists(df: DataFrame, centers: np.ndarray, column: str, n: int) -> DataFrame:
    """df with the numbers of the n centroids nearest to a vector column, one row each."""
    kept = df.where(F.col(column).isNotNull())
    ddl = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", lists array<long>"
    return kept.mapInArrow(lambda it: _closest(it, centers, column, n), ddl).withColumn("list", F.explode("lists")).drop("lists")


def build_ivf(vectors: DataFrame, lists: int, sample: int = 200_000) -> tuple[DataFrame, np.ndarray]:
    """(vectors with their list, centroids). `write_ivf` stores them so that a probe reads its lists only."""
    centers = centroids(vectors, lists, sample)
    return in_lists(vectors, centers, "embedding", 1), centers


@dataclass(frozen=True)
class Ivf:
    """A stored cluster index: the table, partitioned by list, its centroids, and what its recall was fitted to."""

    table: DataFrame
    centers: np.ndarray
    #: Lists that a query reads, and how many vectors these have on average.
    probes: int
    candidates: int


def write_ivf(vectors: DataFrame, path: str, lists: int | None = None, n: int = CANDIDATES, target: float = 0.9, questions: int = 200, sample: int = 200_000) -> Ivf:
    """Stores vectors by the centroid nearest to them, below path, with the number of lists to read.

    Centroids are fitted on at most `sample` vectors, every vector is indexed. The number of probes is the least with which
    `questions` of the vectors, in the order of a hash of their id, find `target` of their exact n nearest; where vectors
    have no clusters that is most of the lists. lists: about half the square root of the vectors by default.
    """
    spark, kept = vectors.sparkSession, vectors.where("embedding is not null")
    lists = lists or max(4, int(kept.count() ** 0.5 / 2))
    index, centers = build_ivf(kept, lists, sample)
    index.repartition("list").sortWithinPartitions("list", *(c for c in ("repo_id",) if c in index.columns)).write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    table = spark.read.parquet(f"{path}/vectors")
    asked = kept.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(questions).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = nearest(table.select("id", "embedding"), asked, n).select("query_id", "id").join(table.select("id", "list"), "id").join(asked, "query_id").select("vector", "list").toArrow()  # questions * n rows
    ranks = np.argsort(np.argsort(-(matrix(hits.column("vector")) @ centers.T), axis=1, kind="stable"), axis=1) if hits.num_rows else np.zeros((0, lists), np.int64)
    needed = np.sort(ranks[np.arange(hits.num_rows), hits.column("list").to_numpy()])
    probes = int(needed[max(0, math.ceil(target * len(needed)) - 1)]) + 1 if len(needed) else lists
    sizes = [r["count"] for r in table.groupBy("list").count().collect()]  # a row a centroid
    meta = [(i, [float(x) for x in c], probes, int(sum(sizes) / lists * probes)) for i, c in enumerate(centers)]
    spark.createDataFrame(meta, "list long, center array<double>, probes int, candidates long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return read_ivf(spark, path)


def read_ivf(spark: SparkSession, path: str) -> Ivf:
    meta = spark.read.parquet(f"{path}/meta").orderBy("list").toArrow()
    return Ivf(spark.read.parquet(f"{path}/vectors"), matrix(meta.column("center")), meta.column("probes")[0].as_py(), meta.column("candidates")[0].as_py())


def _until(batches, centers: np.ndarray, counts: np.ndarray, need: int):
    """Of each query the lists in order of nearness, until they have `need` rows."""
    for batch in batches:
        order = np.argsort(-(matrix(batch.column("vector")).reshape(batch.num_rows, -1) @ centers.T), axis=1, kind="stable")
        held = np.cumsum(counts[order], axis=1)
        lists = [o[: int(np.searchsorted(h, need)) + 1] for o, h in zip(order, held, strict=True)]
        yield pa.record_batch([*batch.columns, pa.array([x[counts[x] > 0] for x in lists], pa.list_(pa.int64()))], [*batch.schema.names, "lists"])


def search_ivf(index: Ivf, queries: DataFrame, n: int = CANDIDATES, keep: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, semantic_rank) among the nearest lists of each query; exact within them. Only lists that some query asks for are read.

    keep: a filter on the vectors. Its rows are counted by list first (no vector is read for that), and each query reads
    lists, nearest first, until they have as many rows that pass as a search without a filter reads for its recall, so a
    filter that lets few rows through reads more lists, in the end all of them.
    """
    asked = queries.where("vector is not null").select("query_id", "vector")
    if keep is None:
        probed, table = in_lists(asked, index.centers, "vector", index.probes), index.table
    else:
        table, counts = index.table.where(keep), np.zeros(len(index.centers), np.int64)
        for r in table.groupBy("list").count().collect():  # a row a centroid
            counts[r["list"]] = r["count"]
        need, centers = max(n, index.candidates), index.centers
        ddl = ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", lists array<long>"
        probed = asked.mapInArrow(lambda it: _until(it, centers, counts, need), ddl).withColumn("list", F.explode("lists")).drop("lists")
    probed = materialize(probed, "probed")
    wanted = sorted(r["list"] for r in probed.select("list").distinct().collect())
    return _within_lists(table.where(F.col("list").isin(wanted)), probed, n)


def knn_ivf(index: DataFrame, centers: np.ndarray, queries: DataFrame, n: int = CANDIDATES, probes: int = 8) -> DataFrame:
    """The same on vectors with their lists as `build_ivf` returns them, with a given number of probes."""
    return _within_lists(index, in_lists(queries.select("query_id", "vector"), centers, "vector", probes), n)


def _within_lists(index: DataFrame, asked: DataFrame, n: int, part: int = 100_000) -> DataFrame:
    """The n best of each query (query_id, vector, list) among the vectors of its lists.

    Queries meet the vectors of a list block by block as one product; n of each query leave a list. A list of more than
    `part` vectors is several tasks.
    """
    sizes = F.broadcast(index.groupBy("list").agg(F.ceil(F.count("*") / part).alias("parts")))  # a row for each centroid
    zero = F.lit(0).cast("long")
    v = index.select("id", "embedding", "list").join(sizes, "list").select("list", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "embedding")
    q = asked.join(sizes, "list").select("list", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), "query_id", "vector")

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ids = b.column("query_id").to_numpy().astype(np.int64)
        return pa.Table.from_batches(_nearest(matrix(a.column("embedding")), a.column("id").to_numpy(), {}, matrix(b.column("vector")), ids, [(None, None)] * len(ids), n), schema)

    found = v.groupBy("list", "part").cogroup(q.groupBy("list", "part")).applyInArrow(near, "query_id long, id long, similarity double")
    return ranked(found, [F.desc("similarity"), F.asc("id")], n, "semantic_rank")
