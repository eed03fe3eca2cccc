"""Reading and writing the engine's tables as Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO_META = T.StructType([T.StructField("id", T.LongType()), T.StructField("owner", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("stars", T.LongType()), T.StructField("language", T.StringType()), T.StructField("private", T.BooleanType())])


#: Up to so many words go into the scan's filter.
MANY_WORDS = 2000
#: Folders of local applications that name none, as tests do.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir. Only a session without executors of its own may leave that unset, as tests do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: what several later steps read is computed once, and lost executors don't undo it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """What Spark's plan says of df's size: that of its files or local rows, an upper bound or no guess at all for what is computed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, mb: int = 4) -> DataFrame:
    """df dealt out to all cores if it has less than `mb` MB for each: a small file may be one task otherwise. Larger tables come in tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * (mb << 20) else df


def read_corpus(spark: SparkSession, sf_dir: str, table: str, id_col: str, text_col: str) -> DataFrame:
    """Text rows without an archive, as (repo_id, path, content)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(F.lit(table).alias("repo_id"), F.concat(F.lit(f"{table}/"), F.col(id_col).cast("string"), F.lit(".md")).alias("path"), F.col(text_col).alias("content"))


def read_repo_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPO_META).json(path)


def write_files(files: DataFrame, path: str) -> None:
    """One row per file from parallel arrays (repo_id, paths, languages, hashes), partitioned by repo bucket."""
    rows = files.select("repo_id", F.inline(F.arrays_zip(F.col("paths").alias("path"), F.col("languages").alias("language"), F.col("hashes").alias("content_hash"))))
    rows.withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def with_file_ids(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks with the file_id of their (repo_id, path) in files (id, repo_id, path); chunks of unknown files are left out, and of files that come twice the smallest id counts."""
    ids = files.groupBy("repo_id", "path").agg(F.min("id").alias("file_id"))
    return chunks.join(ids, ["repo_id", "path"])


def write_chunks(chunks: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """Chunks by repo bucket, with their file ids if files are given; an empty symbol is none."""
    chunks = chunks if files is None else with_file_ids(chunks, files)
    rows = chunks.withColumn("symbol", F.nullif(F.col("symbol"), F.lit("")))
    rows.withColumn("bucket", F.pmod(F.xxhash64("repo_id"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def bucket_count(rows: int, per_bucket: int = 2_000_000, least: int = 16) -> int:
    """A power of 2, so that about per_bucket rows are in a bucket."""
    return max(least, 1 << max(0, (rows // per_bucket) - 1).bit_length())


def write_terms(terms: DataFrame, path: str, buckets: int | None = None, by_repo: bool = False) -> None:
    """Postings by a hash of the term, sorted by it, so that a search reads the buckets of its words only and in them the row groups that hold these. by_repo: by a hash of repo and term, so that questions with repos of their own read these repos' postings only. The number of buckets follows from the counted postings."""
    if buckets is None:
        terms = materialize(terms, "postings")
        buckets = bucket_count(terms.count())
    key = ["repo_id", "term"] if by_repo else ["term"]
    rows = terms.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "repo_id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    terms.sparkSession.createDataFrame([(buckets, by_repo)], "buckets int, by_repo boolean").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}-meta")


def read_terms(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """Postings of some words (term, and in_repos if they are looked for in some repos; a question's few): only their buckets are listed, and words and repos reach the scan as filters."""
    meta, table = spark.read.parquet(f"{path.rstrip('/')}-meta").first(), spark.read.parquet(path)
    scope = F.col("in_repos") if "in_repos" in words.columns else F.lit(None).cast("array<string>")
    asked = words.select("term", F.explode_outer(scope).alias("repo_id")).distinct()
    wanted = asked.limit(MANY_WORDS + 1).collect()
    everywhere = any(r.repo_id is None for r in wanted)
    key = ["repo_id", "term"] if meta.by_repo else ["term"]
    if len(wanted) > MANY_WORDS:
        if meta.by_repo and asked.where("repo_id is null").take(1):
            return table
        return table.join(asked.select(F.pmod(F.xxhash64(*key), F.lit(meta.buckets)).alias("bucket")).distinct(), "bucket", "left_semi")
    table = table.where(F.col("term").isin(sorted({r.term for r in wanted})))
    if not everywhere:
        table = table.where(F.col("repo_id").isin(sorted({r.repo_id for r in wanted})))
    if meta.by_repo and everywhere:
        return table
    local = spark.createDataFrame([(r.term, r.repo_id) for r in wanted], "term string, repo_id string")
    at = [r.b for r in local.select(F.pmod(F.xxhash64(*key), F.lit(meta.buckets)).alias("b")).distinct().collect()]
    return table.where(F.col("bucket").isin(at))
