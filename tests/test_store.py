"""The versioned store, and the stream of snapshots that writes it."""

import random

import pytest
from pyspark.sql import functions as F

from gleanery.plans.jobs import derive_chunks
from gleanery.sources.store import Conflict, IndexStore, apply_snapshot, take_leases, write_back_vectors
from gleanery.streaming import jobs as ST


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark, *values):
    return spark.createDataFrame(values, "id long, name string, n int")


def test_upserts_take_the_place_of_rows(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), bucket_mb=1)
    change = store.change()
    change.upsert("t", table(spark, (1, "a", 1), (2, None, 2), (2, None, 1), (None, "x", 0)), ["id"])
    assert change.commit() == 1 and rows(store.read("t")) == rows(table(spark, (1, "a", 1), (2, None, 1), (None, "x", 0)))
    for _ in range(2):  # the second time changes nothing
        change = store.change()
        change.upsert("t", table(spark, (2, "b", 5), (3, "c", 6), (None, None, 9)), ["id"])
        change.commit()
        assert rows(store.read("t")) == rows(table(spark, (1, "a", 1), (2, "b", 5), (3, "c", 6), (None, None, 9)))
    change = store.change()
    change.delete("t", table(spark, (1, "", 0), (None, "", 0), (77, "", 0)).select("id"))
    assert rows(change.read("t")) == rows(table(spark, (2, "b", 5), (3, "c", 6))) and len(rows(store.read("t"))) == 4
    change.commit()
    assert store.versions() == [1, 2, 3, 4] and len(rows(store.read("t", 1))) == 3 and len(rows(store.read("t"))) == 2
    store.vacuum(keep=1)
    assert store.versions() == [4] and rows(store.read("t")) == rows(table(spark, (2, "b", 5), (3, "c", 6))) and store.vacuum(1) == []
    empty = store.change()
    empty.upsert("t", table(spark).limit(0), ["id"])
    empty.delete("t", store.read("t").select("id"))
    empty.commit()
    assert rows(store.read("t")) == []


def test_a_failure_between_tables_leaves_the_old_version(spark, tmp_path):
    """A writer dies after files and before vectors: readers see neither; two writers of one version can't both win."""
    store = IndexStore(spark, str(tmp_path))
    change = store.change()
    change.upsert("files", table(spark, (1, "a", 1)), ["id"])
    change.upsert("vectors", table(spark, (1, "v", 1)), ["id"])
    change.commit()
    dies = store.change()
    dies.upsert("files", table(spark, (1, "new", 2), (2, "b", 2)), ["id"])
    with pytest.raises(Exception, match="boom"):
        dies.upsert("vectors", table(spark, (1, "w", 2)).withColumn("n", F.raise_error(F.lit("boom")).cast("int")), ["id"])
    again = IndexStore(spark, str(tmp_path))
    assert (rows(again.read("files")), rows(again.read("vectors"))) == ([(1, "a", 1)], [(1, "v", 1)])
    one, two = again.change(), again.change()
    one.upsert("files", table(spark, (5, "one", 5)), ["id"])
    two.upsert("files", table(spark, (5, "two", 5)), ["id"])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert rows(again.read("files")) == [(1, "a", 1), (5, "one", 5)]
    assert len(again.vacuum(keep=1)) >= 3 and rows(again.read("files")) == [(1, "a", 1), (5, "one", 5)]


def test_buckets_follow_from_bytes(spark, tmp_path):
    """A table that outgrows its buckets gets more; a change touches only the buckets of its rows, and a keyed read lists only those."""
    store = IndexStore(spark, str(tmp_path), bucket_mb=1)
    store.bucket_bytes = 40_000
    noise = lambda a, b: spark.range(a, b).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(1).alias("n"))
    for step in range(3):
        change = store.change()
        change.upsert("t", noise(5000 * step, 5000 * (step + 1)), ["id"])
        change.commit()
    t = store.manifest()[1]["t"]
    assert store.manifest(1)[1]["t"].buckets < t.buckets and max(t.sizes.values()) < 4 * store.bucket_bytes
    assert rows(store.read("t").select("id")) == [(i,) for i in sorted(range(15_000), key=lambda i: repr((i,)))]
    change = store.change()
    change.upsert("t", table(spark, (7, "seven", 7)), ["id"])
    change.commit()
    after = store.manifest()[1]["t"]
    assert sum(after.folders[b] != t.folders[b] for b in t.folders) == 1
    one = store.read("t", keys=table(spark, (7, "", 0)))
    assert one.where("id = 7").first().name == "seven" and one.count() < 15_000 / t.buckets * 3


def chunk_table(spark, *values):
    return spark.createDataFrame(values, "id long, repo_id string, language string, embedded boolean, claimed_at timestamp")


def test_vectors_are_written_back_by_id_and_leases_cleared(spark, tmp_path):
    import datetime

    old, store = datetime.datetime(2024, 1, 1), IndexStore(spark, str(tmp_path))
    change = store.change()
    change.upsert("chunks", chunk_table(spark, *((i, "r", "Go", False, None) for i in range(1, 6))), ["id"])
    take_leases(change, spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long"), "2024-01-01 00:00:00")
    change.commit()
    assert [r.claimed_at for r in store.read("chunks").orderBy("id").collect()] == [old, old, old, None, None]
    vectors = lambda *v: spark.createDataFrame(v, "id long, embedding array<float>")
    for v in (vectors((1, [1.0]), (2, [2.0]), (2, [2.0]), (3, None), (99, [9.0])), vectors((1, [1.0]), (2, [2.0])), vectors((2, [7.0]))):
        change = store.change()
        write_back_vectors(change, v)
        change.commit()
    assert rows(store.read("vectors")) == [(1, "r", "Go", [1.0]), (2, "r", "Go", [7.0])]
    assert [(r.embedded, r.claimed_at) for r in store.read("chunks").orderBy("id").collect()] == [(True, None), (True, None), (False, old), (False, None), (False, None)]


# ---- snapshots

SNAPSHOT = "repo_id int, snapshot long, path string, content string, expected long"


def body(k, v):
    return f"def f{k}():\n    return {v}\n" * 3


def arrives(spark, path, batches):
    """Rows as one file for each batch, hashed."""
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SNAPSHOT).withColumn("content_hash", F.sha1("content"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def derive(df):
    return {"derived": derive_chunks(df)}


def index(store):
    return rows(store.read("files").select("repo_id", "path", "content_hash")), rows(store.read("derived").select("repo_id", "path", "id", "content", "embedding"))


def test_any_split_into_batches_gives_the_index_of_the_whole(spark, tmp_path):
    """Two snapshots of several repos, their rows and end marks in any order over several batches; another call goes on from the first."""
    first = {r: {f"a{k}.py": body(k, 0) for k in range(3)} for r in range(4)}
    second = {0: {"a0.py": body(0, 0), "a1.py": body(1, 9), "new.py": body(7, 7)}, 1: {}, 3: {"a0.py": body(0, 5)}}
    row = lambda number, snapshot: [(r, number, p, c, None) for r, files in snapshot.items() for p, c in files.items()] + [(r, number, None, None, len(files)) for r, files in snapshot.items()]
    want = [(r, p, c) for r, files in {**first, **second}.items() for p, c in files.items()]
    whole = spark.createDataFrame(want, "repo_id int, path string, content string").withColumn("content_hash", F.sha1("content"))
    rnd, out = random.Random(5), []
    for parts in (1, 3):
        base = tmp_path / str(parts)
        store = IndexStore(spark, str(base / "index"))
        for call, rows_ in enumerate((row(1, first), row(2, second))):
            rnd.shuffle(rows_)
            schema = arrives(spark, str(base / "in" / str(call)), [rows_[k::parts] for k in range(parts)]).schema
            # the second call is given all files again; what the first has read is in its checkpoint
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
            ST.index_stream(stream, store, derive, {"derived": ["id"]})
        out.append(index(store))
    chunks = rows(derive_chunks(whole).select("repo_id", "path", "id", "content", "embedding"))
    assert out[0] == out[1] == (rows(whole.select("repo_id", "path", "content_hash")), chunks) and len(chunks) >= 7


def test_incomplete_and_outdated_snapshots_change_nothing(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    batches = [[(1, 1, "a.py", body(1, 1), None), (2, 5, "x.py", body(2, 2), None)], [(1, 1, "b.py", body(2, 1), None), (1, 1, None, None, 2)], [(2, 4, None, None, 1), (2, 4, "old.py", body(3, 3), None)], [(1, 1, "late.py", body(4, 4), None), (3, 1, None, None, 1)]]
    ST.index_stream(arrives(spark, str(tmp_path / "in"), batches), store, derive, {"derived": ["id"]})
    assert [(r.repo_id, r.path) for r in store.read("files").orderBy("path").collect()] == [(1, "a.py"), (1, "b.py")]


def test_only_what_changed_is_derived(spark, tmp_path):
    store, seen = IndexStore(spark, str(tmp_path / "index")), []
    files = lambda *v: spark.createDataFrame(v, "repo_id int, path string, content string").withColumn("content_hash", F.sha1("content"))

    def counted(df):
        seen.append(sorted(r.path for r in df.collect()))
        return derive(df)

    for snapshot in (files((1, "a.py", body(1, 1)), (1, "b.py", body(2, 2))), files((1, "a.py", body(1, 1)), (1, "b.py", body(2, 3)), (1, "c.py", body(3, 3)))):
        change = store.change()
        apply_snapshot(change, snapshot, counted, {"derived": ["id"]})
        change.commit()
    assert seen == [["a.py", "b.py"], ["b.py", "c.py"]] and store.read("derived").select("path").distinct().count() == 3
    gone = spark.createDataFrame([(1,)], "repo_id int")
    change = store.change()
    diff = apply_snapshot(change, files((1, "a.py", "")).limit(0), derive, {"derived": ["id"]}, also=gone)
    change.commit()
    assert {r.change for r in diff.collect()} == {"removed"} and index(store) == ([], [])


def test_much_of_one_repo_waits_in_the_state(spark, tmp_path, monkeypatch):
    """More rows of a repo than a batch may hold in memory, some of them twice."""
    rows_ = [(1, 1, f"p{k % 900}.py", body(k % 900, 1), None) for k in range(1000)] + [(1, 1, None, None, 900)]
    monkeypatch.setattr(ST, "MOST_FRESH", 100)
    stream = arrives(spark, str(tmp_path / "in"), [rows_[:500], rows_[500:]])
    store = IndexStore(spark, str(tmp_path / "index"))
    ST.index_stream(stream, store, lambda df: {}, {})
    assert store.read("files").count() == 900


def test_many_repos_come_without_a_state_for_each(spark, tmp_path, monkeypatch):
    """Their rows wait in tables; a call to Python for each repo and row took most of the time."""
    monkeypatch.setattr(ST, "whole_snapshots", None)
    big = 1 << 40
    rows_ = [(big + r, 1, f"f{k}.py", body(k, r), None) for r in range(1500) for k in range(2)] + [(big + r, 1, None, None, 2 + (r == 7)) for r in range(1500)]
    random.Random(1).shuffle(rows_)
    df = spark.createDataFrame(rows_, SNAPSHOT.replace("repo_id int", "repo_id long")).withColumn("content_hash", F.sha1("content"))
    df.repartition(2).write.parquet(f"{tmp_path}/in")
    store = IndexStore(spark, str(tmp_path / "index"))
    ST.index_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), store, derive, {"derived": ["id"]})
    want = df.where(f"path is not null and repo_id <> {big + 7}")
    assert rows(store.read("files").select("repo_id", "path")) == rows(want.select("repo_id", "path"))
    assert rows(store.read("derived").select("repo_id", "path", "embedding")) == rows(derive_chunks(want).select("repo_id", "path", "embedding"))


def test_snapshots_that_stay_incomplete_are_given_up(spark, tmp_path):
    """And the newest whole one of a batch counts, a begun newer one waits; nothing stays of what is done."""
    one, two = [(1, 1, "a.py", body(1, 1), None)], [(2, 1, "b.py", "old", None), (2, 2, "b.py", "new", None), (2, 3, "c.py", "next", None), (2, 1, None, None, 1), (2, 2, None, None, 1)]
    rest = [(1, 1, "z.py", body(2, 1), None), (1, 1, None, None, 2), (2, 3, None, None, 1)]
    for wait, given_up in ((0, True), (3600, False)):
        base = tmp_path / str(wait)
        store = IndexStore(spark, str(base / "index"))
        for call, batches in enumerate(([one, two], [rest])):
            stream = arrives(spark, str(base / "in"), batches) if not call else arrives(spark, str(base / "in/more"), batches)
            stream = spark.readStream.schema(spark.read.option("recursiveFileLookup", "true").parquet(str(base / "in")).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(base / "in"))
            ST.index_stream(stream, store, lambda df: {}, {}, wait_seconds=wait)
            got = {(r.repo_id, r.path) for r in store.read("files").collect()}
            assert got == ({(2, "b.py")} if not call else {(1, "a.py"), (1, "z.py"), (2, "c.py")} if not given_up else got & {(2, "b.py"), (2, "c.py")})
        held = IndexStore(spark, f"{store.base}-stream/waiting").read("waiting")
        assert held.count() == 0 or given_up


def test_vectors_row_by_row_are_those_of_the_embedding(spark, sf):
    from gleanery.functions import text as T
    from gleanery.operators import retrieval as R
    from gleanery.plans.views import view

    chunks = view(spark, sf, "corpus_chunks").withColumn("content", F.when(F.col("id") % 9 != 1, F.col("content")).otherwise("")).withColumn("path", F.when(F.col("id") % 9 != 1, F.col("path")).otherwise("."))
    text = T.embedding_text(F.col("path"), F.col("symbol"), F.col("kind"), F.col("content"))
    got = chunks.select("id", R.hashed_vector(T.split_identifiers(text)).alias("v")).where("v is not null")
    assert rows(got) == rows(R.hashed_embedding(chunks)) and 0 < got.count() < chunks.count()


def test_whole_snapshots_by_themselves(spark, tmp_path, monkeypatch):
    """The operator without the index: one row without a path for each whole snapshot."""
    monkeypatch.setattr(ST, "MOST_FRESH", 20)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        rows_ = [(1, 1, f"p{k % 90}.py", body(k % 90, 1), None) for k in range(100)] + [(1, 1, None, None, 90), (2, 1, "x.py", "", None)]
        out = []
        ST.whole_snapshots(arrives(spark, str(tmp_path / "in"), [rows_[:50], rows_[50:]])).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted((r.repo_id, r.path or "") for r in out) == [(1, ""), *sorted((1, f"p{k}.py") for k in range(90))]
