"""Structured Streaming twins of the continuous parts; each equals its batch operator once all input is in."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.store import Change, IndexStore, apply_snapshot
from ..sources.tables import materialize, shared_dir


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream. The last letter is a pattern, as a stream's path must be a folder or a pattern."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream; naive times become instants, so that watermarks work."""
    return table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_now(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Everything that is there by now, as a table: append writes files, complete replaces the table in each batch."""
    spark, out = stream.sparkSession, shared_dir(stream.sparkSession, name)
    checkpoint = shared_dir(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    q = writer.start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def search_counters_stream(log: DataFrame) -> DataFrame:
    """Searches and the last one per repo; events that come twice within the watermark count once."""
    once = log.withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy("repo_id").agg(F.count("*").alias("search_count"), F.max("ts").alias("last_searched_at"))


def _ordered(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values(["ts", "event_id"])


def progress_rate_stream(events: DataFrame, samples: int = 31) -> DataFrame:
    """Per event of (repo_id, ts, event_id, done): chunks per second over the last samples; the state is those samples."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = list(zip(*state.get, strict=True)) if state.exists else []
        rows = []
        for r in _ordered(pdfs).itertuples():
            old = [*old, (int(r.ts.timestamp()), int(r.done))][-samples:]
            seconds = old[-1][0] - old[0][0]
            rate = (old[-1][1] - old[0][1]) / seconds if len(old) >= 3 and seconds > 0 else 0.0
            rows.append((key[0], r.event_id, round(rate, 6) if rate > 0 else None))
        state.update(([t for t, _ in old], [d for _, d in old]))
        yield pd.DataFrame(rows, columns=["repo_id", "event_id", "per_second"])

    return events.groupBy("repo_id").applyInPandasWithState(step, "repo_id long, event_id long, per_second double", "ts array<long>, done array<long>", "append", GroupStateTimeout.NoTimeout)


def monotone_progress_stream(events: DataFrame) -> DataFrame:
    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        rows = []
        for r in _ordered(pdfs).itertuples():
            best = int(r.done) if best is None else max(best, int(r.done))
            rows.append((key[0], r.event_id, best))
        state.update((best,))
        yield pd.DataFrame(rows, columns=["repo_id", "event_id", "shown"])

    return events.groupBy("repo_id").applyInPandasWithState(step, "repo_id long, event_id long, shown long", "best long", "append", GroupStateTimeout.NoTimeout)


def throttle(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """(key, event_id, ts) of events at least the gap after the last kept one of their key; the state is one time per key."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for r in _ordered(pdfs).itertuples():
            at = r.ts.timestamp()
            if last is None or at - last >= gap_seconds:
                last = at
                rows.append((k[0], r.event_id, r.ts))
        state.update((last,))
        yield pd.DataFrame(rows, columns=[key, "event_id", "ts"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def expire(events: DataFrame, key: str, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(key, expired_at) for each time a key saw no event for ttl_seconds, once the watermark is past that."""

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            end = state.get[0] + ttl_seconds
            state.remove()
            yield pd.DataFrame([(k[0], end)], columns=[key, "at"])
            return
        last, rows = (state.get[0] if state.exists else None), []
        for r in _ordered(pdfs).itertuples():
            at = r.ts.timestamp()
            if last is not None and at - last > ttl_seconds:
                rows.append((k[0], last + ttl_seconds))
            last = at if last is None else max(last, at)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + ttl_seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "at"])

    marked = events.withWatermark("ts", delay)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} long, at double", "last double", "append", GroupStateTimeout.EventTimeTimeout).select(key, F.timestamp_seconds("at").alias("expired_at"))


#: Rows of one repo that a batch holds in memory before they go into the state.
MOST_FRESH = 10_000


def _whole(rows_type: StructType, wait_seconds: int) -> StatefulProcessor:
    """The processor of `whole_snapshots`. Its class is made here, so that it goes to the workers, of which one is the driver's, with its code."""
    most_fresh = MOST_FRESH

    class Whole(StatefulProcessor):
        """Gathers one repo's snapshot: rows by path until as many are there as its end mark says."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.paths = handle.getMapState("paths", "path string", StructType([f for f in rows_type.fields if f.name != "path"]))
            self.open = handle.getValueState("open", "snapshot long, expected long, seen long")

        def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            snapshot, expected, seen = self.open.get() if self.open.exists() else (None, None, 0)
            fresh: dict[str, tuple] = {}  # what came just now; it goes into the state if more is to come, or if it is much
            names = [f.name for f in rows_type.fields if f.name != "path"]
            for pdf in rows:
                pdf = pdf.astype(object).where(pdf.notna(), None)
                for r in pdf.sort_values("snapshot", kind="stable").itertuples(index=False):
                    if snapshot is not None and r.snapshot < snapshot:
                        continue  # a newer one has begun, or is done
                    if snapshot is None or r.snapshot > snapshot:
                        self.paths.clear()
                        fresh.clear()
                        snapshot, expected, seen = int(r.snapshot), None, 0
                    if seen < 0:
                        continue  # handed on already
                    if r.path is None:
                        expected = int(r.expected)
                    else:
                        fresh[r.path] = tuple(getattr(r, c) for c in names)
                    if len(fresh) >= most_fresh:
                        seen = self._keep(fresh, seen)
                if expected is not None and seen >= 0:
                    if seen:
                        seen = self._keep(fresh, seen)
                    if seen + len(fresh) >= expected:
                        yield from self._done(key, names, fresh)
                        seen = -1
            if seen >= 0:
                seen = self._keep(fresh, seen)
            self.open.update((snapshot, expected, seen))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if seen >= 0:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + wait_seconds * 1000)

        def _keep(self, fresh: dict[str, tuple], seen: int) -> int:
            """Moves rows into the state; how many paths are there now."""
            for path, values in fresh.items():
                seen += not (seen and self.paths.containsKey((path,)))
                self.paths.updateValue((path,), values)
            fresh.clear()
            return seen

        def _done(self, key: tuple, names: list[str], fresh: dict[str, tuple]) -> Iterator[pd.DataFrame]:
            """The snapshot's rows, a few thousand at a time, and one without a path."""
            out, held = [], 0
            for (path,), values in itertools.chain((((p,), v) for p, v in fresh.items()), self.paths.iterator()):
                out.append((key[0], path, *values))
                held += sum(len(v) for v in values if isinstance(v, str))
                if len(out) >= 2000 or held > 8 << 20:
                    yield pd.DataFrame(out, columns=["repo_id", "path", *names])
                    out, held = [], 0
            yield pd.DataFrame([*out, (key[0], None, *(None for _ in names))], columns=["repo_id", "path", *names])
            self.paths.clear()

        def handleExpiredTimer(self, key, timers, info) -> Iterator[pd.DataFrame]:  # noqa: N802
            """A snapshot that stayed incomplete is given up; its rows are forgotten, later ones of it are ignored."""
            snapshot = self.open.get()[0]
            self.paths.clear()
            self.open.update((snapshot, None, -1))
            yield pd.DataFrame(columns=["repo_id", *(f.name for f in rows_type.fields)])

        def close(self) -> None:
            pass

    return Whole()


#: What a stream of snapshots has besides the rows' own columns.
MARKS = ("repo_id", "snapshot", "expected")


def whole_snapshots(rows: DataFrame, wait_seconds: int = 3600) -> DataFrame:
    """Rows of complete snapshots only, and one row without a path for each, however its rows were split over micro-batches.

    rows: repo_id, snapshot (a number that grows), path, content_hash, ..., and per snapshot an end mark: path null and
    `expected` its number of paths, in any place. A path that comes twice counts once, its last row stands. A newer
    snapshot takes the place of an older one that isn't complete, rows of older ones are left out, and one that lacks rows
    for wait_seconds is given up. Rows wait in RocksDB on disk, which the session must have as its state store; what stays
    of a repo afterwards is three numbers. Timers would ask for empty batches for ever: with
    spark.sql.streaming.noDataMicroBatches.enabled off they fire when the next rows come.
    """
    own = StructType(sorted((f for f in rows.schema.fields if f.name not in MARKS), key=lambda f: f.name != "path"))
    out = StructType([rows.schema["repo_id"], *own.fields])
    return rows.groupBy("repo_id").transformWithStateInPandas(_whole(own, wait_seconds), out, "Append", "ProcessingTime")


def _gather(change: Change, rows: DataFrame, now: int, wait_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Puts a batch's rows to those that wait; the rows of snapshots that are whole by now, and their repos.

    Two tables: `waiting` has the rows and end marks of what isn't whole, `begun` each repo's last snapshot, whether it is
    done (handed on or given up), and when rows of it came last.
    """
    store, id_ = change.store, rows.schema["repo_id"]
    begun = change.read("begun") if "begun" in change.tables else store.spark.createDataFrame([], StructType([id_]).add("snapshot", "long").add("done", "boolean").add("came", "long"))
    last = begun.select("repo_id", F.col("snapshot").alias("last"), "done")
    live = rows.join(last, "repo_id", "left").where("last is null or snapshot > last or (snapshot = last and not done)").select(*rows.columns)
    live.write.parquet(path := shared_dir(store.spark, "live"))
    live = store.spark.read.schema(live.schema).parquet(path)  # the stream's own session plans without statistics of what has run
    repos = live.select("repo_id").distinct()
    change.upsert("waiting", live, ["repo_id", "snapshot", "path"], by=["repo_id"])
    held = change.read("waiting", keys=repos)
    of_repo = Window.partitionBy("repo_id")
    counted = held.join(repos, "repo_id", "left_semi").groupBy("repo_id", "snapshot").agg((F.count("path") >= F.max("expected")).alias("all"))
    counted = materialize(counted.withColumns({"newest": F.max("snapshot").over(of_repo), "whole": F.max(F.when(F.col("all"), F.col("snapshot"))).over(of_repo)}), "counted")
    late = begun.where(~F.col("done") & (F.col("came") < now - wait_seconds * 1000)).join(repos, "repo_id", "left_anti")
    late = materialize(late.withColumn("done", F.lit(True)), "late")
    now_begun = counted.where("snapshot = newest").select("repo_id", "snapshot", F.coalesce(F.col("all"), F.lit(False)).alias("done"), F.lit(now).cast("long").alias("came"))
    change.upsert("begun", now_begun.unionByName(late), ["repo_id"])
    change.delete("waiting", counted.where("snapshot < newest or snapshot <= whole").select("repo_id", "snapshot").union(late.select("repo_id", "snapshot")))
    whole = counted.where("snapshot = whole").select("repo_id", "snapshot")
    return held.where("path is not null").join(whole, ["repo_id", "snapshot"], "left_semi").select("repo_id", *(c for c in rows.columns if c not in MARKS)), whole.select("repo_id")


def index_stream(snapshots: DataFrame, store: IndexStore, derive: Callable[[DataFrame], dict[str, DataFrame]], keys: dict[str, list[str]], wait_seconds: int = 3600) -> None:
    """Takes arriving snapshots (as `whole_snapshots` has them; with content_hash) into the index, each once it is complete.

    A batch's snapshots are compared with the stored files, derive gets only rows of added and changed ones, and only the
    buckets that change are written. Files and what is derived from them become visible together, as one version of the
    store, so a batch that is repeated after a failure gives the same index. The stream's checkpoint stands beside the
    tables; a later call goes on where the last one ended.

    Rows wait in a store of their own inside the checkpoint, not in a streaming state: that takes a call to Python for each
    repo and some more for each row. It is committed after the index, so rows may come to the index twice, which changes
    nothing, but not get lost.
    """
    waiting = IndexStore(store.spark, f"{store.base}-stream/waiting")
    waiting.bucket_bytes = store.bucket_bytes

    def batch(df: DataFrame, number: int) -> None:
        state = waiting.change()
        rows, repos = _gather(state, df, int(time.time() * 1000), wait_seconds)
        if repos.take(1):
            change = store.change()
            apply_snapshot(change, rows, derive, keys, also=repos)
            change.commit()
        state.commit()
        waiting.vacuum(keep=1)

    q = snapshots.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", f"{store.base}-stream").start()
    q.awaitTermination()
