"""Which files are worth indexing, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

MAX_FILES, MAX_CHUNKS = 1500, 6000


def admit_files(files: DataFrame) -> DataFrame:
    """files (repo_id, path, content) with reason (null: keep), language, grammar, strategy, content_hash, size_bytes, line_count."""
    size = F.octet_length("content")
    reason = F.coalesce(P.skip_reason_path(F.col("path")), F.when(size > P.MAX_FILE_BYTES, "too-large"), P.skip_reason_content(F.col("content")))
    info = P.detect_language(F.col("path"))
    return files.select(*files.columns, reason.alias("reason"), info["language"].alias("language"), info["grammar"].alias("grammar"), info["strategy"].alias("strategy"), F.sha1(F.col("content").cast("binary")).alias("content_hash"), size.alias("size_bytes"), P.line_count(F.col("content")).alias("line_count"))


def admission_report(admitted: DataFrame) -> DataFrame:
    return admitted.groupBy("repo_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def apply_caps(files: DataFrame, chunk_count: str = "n_chunks", most_files: int = MAX_FILES, most_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Files in path order while the repo has fewer than most_files before it and fewer than most_chunks chunks; with truncated per repo."""
    w = Window.partitionBy("repo_id").orderBy("path")
    before = F.coalesce(F.sum(chunk_count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = files.withColumn("_ok", (F.row_number().over(w) <= most_files) & (before < most_chunks))
    return at.withColumn("truncated", ~F.min("_ok").over(Window.partitionBy("repo_id"))).where("_ok").drop("_ok")
