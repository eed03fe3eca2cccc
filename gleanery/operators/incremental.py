"""Incremental indexing: snapshots are compared by content hash, and only what changed is done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """new's columns and change: added, changed, unchanged or removed. Only added and changed rows have more than repo_id and path."""
    o = old.select("repo_id", "path", F.col("content_hash").alias("_was"))
    now = F.col("content_hash")
    change = F.when(F.col("_was").isNull(), "added").when(now.isNull(), "removed").when(F.col("_was") == now, "unchanged").otherwise("changed")
    both = o.join(new, ["repo_id", "path"], "full_outer").withColumn("change", change)
    kept = F.col("change").isin("added", "changed")
    return both.select(*(F.col(c) if c in ("repo_id", "path") else F.when(kept, F.col(c)).alias(c) for c in new.columns), "change")


def diff_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo_id, path, change): added, changed, unchanged or removed."""
    return diff_rows(old, new.select("repo_id", "path", "content_hash")).select("repo_id", "path", "change")


def stale_paths(diff: DataFrame) -> DataFrame:
    """Stored paths whose rows must go: removed ones and those that changed."""
    return diff.where(F.col("change").isin("removed", "changed")).select("repo_id", "path")


def apply_diff(stored: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows of unchanged paths, and fresh rows of added and changed ones. Both sides have (repo_id, path, …)."""
    kept = stored.join(stale_paths(diff), ["repo_id", "path"], "left_anti")
    done = diff.where(F.col("change").isin("added", "changed")).select("repo_id", "path")
    return kept.unionByName(fresh.join(done, ["repo_id", "path"], "left_semi"))


def change_summary(diff: DataFrame) -> DataFrame:
    """(repo_id, changed, removed, note): how many files were added or changed, and removed."""
    n = diff.groupBy("repo_id").agg(F.count_if(F.col("change").isin("added", "changed")).alias("changed"), F.count_if(F.col("change") == "removed").alias("removed"))
    return n.withColumn("note", F.format_string("%d changed, %d removed.", "changed", "removed"))


def pending_chunks(chunks: DataFrame, as_of: str, n: int = 12, lease_seconds: int = 120) -> DataFrame:
    """The next n chunks to embed: without a vector, and with no lease or one that ran out."""
    old = F.col("claimed_at").isNull() | (F.col("claimed_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lease_seconds} SECONDS"))
    return chunks.where(~F.col("embedded") & old).orderBy("id").limit(n)


def index_status(counts: DataFrame) -> DataFrame:
    """counts (repo_id, files, chunks, embedded) with status and message."""
    status = F.when(F.col("chunks") == 0, "error").when(F.col("embedded") < F.col("chunks"), "indexing").otherwise("ready")
    message = F.when(F.col("chunks") == 0, "Nothing to index").when(F.col("embedded") < F.col("chunks"), "Generating embeddings").otherwise("Index is up to date")
    return counts.withColumn("status", status).withColumn("message", message)


def status_message(counts: DataFrame, changes: DataFrame, most_files: int = 1500) -> DataFrame:
    """(repo_id, message): a note on truncation, the changes, and the stage."""
    df = index_status(counts).join(changes.select("repo_id", "note"), "repo_id", "left")
    cut = F.when(F.col("files") >= most_files, F.concat(F.lit("Large repo: indexed the first "), F.format_number("files", 0), F.lit(" files. "))).otherwise("")
    return df.select("repo_id", F.trim(F.concat(cut, F.coalesce(F.concat("note", F.lit(" ")), F.lit("")), F.col("message"))).alias("message"))


def up_to_date(repos: DataFrame, archives: DataFrame) -> DataFrame:
    """Repos with nothing to do: same commit, some chunks, all with vectors. archives: (id, commit_sha)."""
    a = archives.select("id", F.col("commit_sha").alias("new_sha"))
    return repos.join(a, "id").where((F.col("commit_sha") == F.col("new_sha")) & (F.col("total_chunks") > 0) & (F.col("embedded_chunks") >= F.col("total_chunks"))).drop("new_sha")


def replace_table(df: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that df has. df must not read from path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
