"""The index as a versioned store: tables in buckets, written anew where they change, and made visible by one file.

A table's rows are dealt into buckets by a hash of its bucket columns. A change writes new files for the buckets that it
touches, below a folder of its own; nothing that stands is touched. The manifest of the next version names, for each
table, the folder of every bucket. It becomes visible by one rename, so readers see all tables of a version or none of
them, a job that dies before leaves the last version as it was, and of two writers one fails. Old versions stay readable
until `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import incremental as I
from .tables import materialize

MANIFESTS = "_manifests"
BUCKET, PART = "_bucket", "_part"
#: About what one task writes of a bucket.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class Table:
    """What the manifest says of a table. folders: bucket number -> folder below the table; empty buckets have none."""

    schema: str
    by: list[str]
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)

    @property
    def type(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class IndexStore:
    """Tables below `base`, a folder that all executors share. bucket_mb: about how much a bucket holds; buckets split when they outgrow twice that."""

    def __init__(self, spark: SparkSession, base: str, bucket_mb: int = 256) -> None:
        self.spark, self.base, self.bucket_bytes = spark, base.rstrip("/"), bucket_mb << 20

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(MANIFESTS)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(MANIFESTS)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, Table]]:
        """The version's number and tables; the last version by default, 0 and no tables if there is none."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, {}
        with_ = self.spark._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(MANIFESTS, f"{version:012d}.json"))
        try:
            tables = json.loads(with_.toString(stream, "UTF-8"))
        finally:
            stream.close()
        numbered = lambda d: {int(k): v for k, v in d.items()}
        return version, {n: Table(**{**t, "folders": numbered(t["folders"]), "sizes": numbered(t["sizes"])}) for n, t in tables.items()}

    def read(self, name: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """A table of a version. keys: rows of its bucket columns; only the buckets that they fall into are listed and read."""
        table = self.manifest(version)[1][name]
        wanted = sorted(table.folders) if keys is None else _numbers(keys.select(_bucket(table.by, table.buckets)))
        return self._of(name, table, wanted)

    def _of(self, name: str, table: Table, wanted: list[int]) -> DataFrame:
        paths = [f"{self.base}/{name}/{table.folders[b]}/{BUCKET}={b}" for b in wanted if b in table.folders]
        return self.spark.read.schema(table.type).parquet(*paths) if paths else self.spark.createDataFrame([], table.type)

    def change(self) -> Change:
        return Change(self)

    def _publish(self, version: int, tables: dict[str, Table]) -> None:
        """Writes the manifest beside its place and renames it: a rename onto a file that exists fails."""
        text = json.dumps({n: asdict(t) for n, t in tables.items()})
        at, draft = self._path(MANIFESTS, f"{version:012d}.json"), self._path(MANIFESTS, f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} exists already")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` versions and the folders that only they, or writers that failed, have made. Not to be run beside a writer."""
        kept = self.versions()[-keep:]
        used = {f"{n}/{f}" for v in kept for n, t in self.manifest(v)[1].items() for f in t.folders.values()}
        gone = []
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(MANIFESTS, f"{v:012d}.json"), False)
        for table in self._fs.listStatus(self._path()):
            name = table.getPath().getName()
            for folder in self._fs.listStatus(table.getPath()) if name != MANIFESTS else []:
                at = f"{name}/{folder.getPath().getName()}"
                if at not in used:
                    self._fs.delete(folder.getPath(), True)
                    gone.append(at)
        return sorted(gone)


def _bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias(BUCKET)


def _numbers(df: DataFrame) -> list[int]:
    """Bucket numbers, as many as there are buckets at most."""
    return sorted(r[0] for r in df.distinct().collect())


class Change:
    """Changes of several tables that become one version on `commit`. Until then nobody sees them, the change itself does."""

    def __init__(self, store: IndexStore) -> None:
        self.store = store
        self.version, self.tables = store.manifest()

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        table = self.tables[name]
        return self.store._of(name, table, sorted(table.folders) if keys is None else _numbers(keys.select(_bucket(table.by, table.buckets))))

    def upsert(self, name: str, rows: DataFrame, key: list[str], by: list[str] | None = None, gone: DataFrame | None = None) -> None:
        """Rows take the place of stored ones with their key (nulls are equal); of rows with one key the least in the order of all columns stays. gone: rows of key columns, the bucket columns among them, whose stored rows go first. by: the columns of the key that deal rows into buckets (all by default), fixed by the first write. Writing the same rows again changes nothing."""
        if not set(by or key) <= set(key):
            raise ValueError("rows are dealt into buckets by columns of their key")
        self._write(name, rows, key, by, gone)

    def delete(self, name: str, gone: DataFrame) -> None:
        """Stored rows go whose columns equal those of a row of gone; the bucket columns must be among them."""
        self._write(name, self.read(name).limit(0), [], None, gone)

    def _write(self, name: str, rows: DataFrame, key: list[str], by: list[str] | None, gone: DataFrame | None) -> None:
        store = self.store
        fresh, gone = materialize(rows, "fresh"), None if gone is None else materialize(gone.distinct(), "gone")
        table, size = self.tables.get(name), self._bytes(fresh)
        if table is None:
            table = Table(fresh.schema.json(), by or key, self._buckets(size))
        elif by and by != table.by:
            raise ValueError(f"{name} is dealt out by {table.by}")
        size += sum(table.sizes.values())
        if size > 2 * table.buckets * store.bucket_bytes:  # outgrown: all buckets are written anew, as more
            stored = store._of(name, table, sorted(table.folders))
            table = replace(table, buckets=self._buckets(size))
            touched = list(range(table.buckets))
        else:
            changed = [df.select(_bucket(table.by, table.buckets)) for df in (fresh, gone) if df is not None]
            touched = _numbers(changed[0].union(changed[-1]))
            stored = store._of(name, table, touched)
        if not touched:
            self.tables[name] = table
            return
        if gone is not None:
            stored = _anti(stored, gone, gone.columns)
        if key:
            stored = _anti(stored, fresh.select(*key), key)
        parts = max(1, -(-size // (table.buckets * PART_BYTES)))  # a bucket is written by so many tasks
        part = F.col(BUCKET) * parts + F.pmod(F.hash(*table.by), F.lit(parts))
        both = stored.unionByName(fresh.select(*table.type.names)).select(*table.type.names, _bucket(table.by, table.buckets))
        both = both.withColumn(PART, part.cast("int")).repartitionById(min(len(touched) * parts, 10_000), PART)
        if key:  # the order of all columns decides between rows of one key; they meet in their part
            ordered = [*table.by, *(c for c in key if c not in table.by)]
            rest = [c for c in table.type.names if c not in key]
            both = both.groupBy(BUCKET, *ordered, PART).agg(F.min(F.struct(*rest)).alias("_row") if rest else F.count("*").alias("_row"))
            both = both.select(*(F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in table.type.names), BUCKET)
        folder = f"v{self.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        both.drop(PART).sortWithinPartitions(BUCKET, *table.by).write.partitionBy(BUCKET).parquet(f"{store.base}/{name}/{folder}")
        folders, sizes = ({b: x for b, x in d.items() if b < table.buckets and b not in set(touched)} for d in (table.folders, table.sizes))
        for status in store._fs.listStatus(store._path(name, folder)):
            part = status.getPath().getName()
            if part.startswith(f"{BUCKET}="):
                b = int(part.removeprefix(f"{BUCKET}="))
                folders[b], sizes[b] = folder, int(store._fs.getContentSummary(status.getPath()).getLength())
        self.tables[name] = replace(table, folders=folders, sizes=sizes)

    def _bytes(self, written: DataFrame) -> int:
        """What a table just written takes up."""
        path = self.store.spark._jvm.org.apache.hadoop.fs.Path
        return sum(int(self.store._fs.getContentSummary(path(p)).getLength()) for p in {f.rpartition("/")[0] for f in written.inputFiles()})

    def _buckets(self, size: int) -> int:
        return max(1, -(-size // self.store.bucket_bytes))

    def commit(self) -> int:
        """Makes all changes visible at once; the new version's number."""
        self.store._publish(self.version + 1, self.tables)
        self.version += 1
        return self.version


def _anti(stored: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """stored without rows whose columns equal those of a row of keys, nulls too."""
    there = keys.select(*(F.col(c).alias(f"_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return stored.join(there, same, "left_anti")


def write_back_vectors(change: Change, vectors: DataFrame, chunks: str = "chunks", table: str = "vectors") -> None:
    """Vectors (id, embedding) of stored chunks (id, embedded, claimed_at, ...; dealt out by id) come into the index, by id: those of unknown chunks are left out, an old one is replaced, and the chunk counts as embedded, its lease is cleared. What searches filter by, repo_id and language, comes along. Both tables change in one version; only the buckets of the given ids are read."""
    some = materialize(vectors.where("embedding is not null").groupBy("id").agg(F.min("embedding").alias("embedding")), "vectors")
    known = change.read(chunks, keys=some)
    met = materialize(known.join(some, "id"), "embedded")
    change.upsert(table, met.select("id", *(c for c in ("repo_id", "language") if c in known.columns), "embedding"), ["id"])
    done = met.withColumns({"embedded": F.lit(True), "claimed_at": F.lit(None).cast(known.schema["claimed_at"].dataType)})
    change.upsert(chunks, done.select(*known.columns), ["id"])


def take_leases(change: Change, ids: DataFrame, as_of: str, chunks: str = "chunks") -> None:
    """Marks chunks (id) as being worked on since as_of; see `pending_chunks` for which are free."""
    known = change.read(chunks, keys=ids)
    mine = known.join(ids.select("id").distinct(), "id", "left_semi")
    change.upsert(chunks, mine.withColumn("claimed_at", F.lit(as_of).cast(known.schema["claimed_at"].dataType)).select(*known.columns), ["id"])


def apply_snapshot(change: Change, snapshot: DataFrame, derive: Callable[[DataFrame], dict[str, DataFrame]], keys: dict[str, list[str]], also: DataFrame | None = None) -> DataFrame:
    """Takes whole snapshots of some repos (repo_id, path, content_hash, ...) into the store and returns the diff (repo_id, path, change).

    The table `files` has what is known of each path. derive makes the other tables' rows (each with repo_id and path) out
    of added and changed rows only; keys: their key columns. also: repos (repo_id) whose snapshot is empty. What was derived from removed and changed paths goes. Nothing
    is visible before the change is committed.
    """
    if "files" in change.tables:
        snapshot = materialize(snapshot, "snapshot")
        repos = snapshot.select("repo_id") if also is None else snapshot.select("repo_id").union(also.select("repo_id"))
        diff = I.diff_rows(change.read("files").join(repos.distinct(), "repo_id", "left_semi"), snapshot)
    else:
        diff = snapshot.withColumn("change", F.lit("added"))
    diff = materialize(diff, "diff")
    stale = I.stale_paths(diff)
    fresh = diff.where(F.col("change").isin("added", "changed")).drop("change")
    for name, rows in derive(fresh).items():
        old = change.read(name).join(stale, ["repo_id", "path"], "left_semi").select(*keys[name]) if name in change.tables else None
        change.upsert(name, rows, keys[name], gone=old)
    change.upsert("files", fresh.select("repo_id", "path", "content_hash"), ["repo_id", "path"], gone=stale)
    return diff.select("repo_id", "path", "change")
