"""Helpers that the operators of this subpackage share: Arrow batches as numpy, polynomial hashes, written tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Words are runs of bytes that are none of these.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Folders of local applications that name none, as tests do.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that all executors share. Only a session without executors of its own may leave that unset, as tests do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/gleanery-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: lineage is cut and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, mb: int = 4) -> DataFrame:
    """df dealt out to all cores if it has less than `mb` MB for each: a small file may be one task otherwise. Larger tables come in tasks enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (mb << 20) else df


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that matter, as (doc_id long, text string); other columns can't clash. Null text is empty."""
    return spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))


def small(df: DataFrame, most: int = 1_000_000, size: Column | None = None, most_mb: int = 32) -> DataFrame:
    """df to be broadcast if its counted rows (of a few longs each) are few and, where a row's size is given, their sum is small; else it is joined by shuffle."""
    few = df.limit(most + 1).count() <= most
    if few and size is not None:
        few = (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most_mb << 20
    return F.broadcast(df) if few else df


def parts_for(df: DataFrame, column: str, mb: int = 16) -> int:
    """How many parts hold about mb MB of the column each; grows with the input, at least the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (mb << 20)))


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and len + 1 offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a single longer row is a range of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply rounds), in place of x where possible."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class Poly:
    """Prefix polynomial hashes modulo 2**64 over random byte values: the hash of any substring takes O(1)."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(rng.integers(1 << 60, 1 << 63)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up, self.down = (np.concatenate([a, a * U64(pow(b, m, 1 << 64))]) for a, b in ((self.up, self.base), (self.down, self.inverse)))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """H with H[i] the hash of data[:i]."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], equal for equal strings wherever they stand."""
        return (prefixes[end] - prefixes[start]) * self.down[start]


POLY, POLY2 = Poly(11), Poly(23)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def distinct_words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows data[at[i]:at[i+1]]: the xxh3-128 digests of their different words (lower-cased A-Z), as two numbers each, and of all words in order: which of those it is, its row, and len + 1 word offsets of the rows. Words never cross rows."""
    n = len(at) - 1
    lengths = np.diff(at)
    parted = np.full(int(at[-1] - at[0]) + n, 0x20, np.uint8)  # a space after each row
    where = np.arange(int(at[-1] - at[0])) + np.repeat(np.arange(n), lengths)
    parted[where] = LOWER[data[at[0] : at[-1]]] if lower else data[at[0] : at[-1]]
    del where
    start, end = word_spans(parted)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    kind, offsets = (pa.binary(), ends.astype(np.int32)) if ends[-1] < 1 << 31 else (pa.large_binary(), ends)
    words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(parted[~SPACE[parted]])]).dictionary_encode()
    bounds = np.searchsorted(start, at - at[0] + np.arange(n + 1))
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), "<u8").reshape(-1, 2)
    return digests, words.indices.to_numpy(), np.repeat(np.arange(n), np.diff(bounds)), bounds


def words_of(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same words' 64-bit hashes, their rows, and the rows' word offsets."""
    digests, which, row, bounds = distinct_words(data, at, lower)
    return digests[which, 1], row, bounds


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Gives free memory back to the system: Python workers outlive their tasks and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mapped(f: Callable[..., Iterator[pa.RecordBatch]], *args) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f with its further arguments, for mapInArrow; its memory goes back when the task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches, *args)
        finally:
            trim()

    return run


def grouped(f: Callable[..., pa.Table], *args) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table, *args)
        finally:
            trim()

    return run


def cogrouped(f: Callable[..., pa.Table], *args) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for applyInArrow of two tables."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        try:
            return f(a, b, *args)
        finally:
            trim()

    return run


def frames(table: list[tuple[int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
    """Rows (bucket int, blob binary) of packed numpy columns."""
    return pa.record_batch([pa.array([b for b, _ in table], pa.int32()), pa.array([pack(x) for _, x in table], pa.binary())], ["bucket", "blob"])


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of one length, one after the other: number of rows, then each column's bytes. dtypes are known to the reader."""
    first = next(iter(columns.values()))
    return np.int64(len(first)).tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in columns.values())


def unpack(blobs: list[bytes], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    """The columns of all blobs, joined."""
    out: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in dtypes.items()}
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k, t in dtypes.items():
            out[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in out.items()}


def bucketed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob), one for each bucket that occurs."""
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        columns, bucket = {k: v[order] for k, v in columns.items()}, bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
        yield frames([(int(bucket[a]), {k: v[a:b] for k, v in columns.items()}) for a, b in zip(lo, hi, strict=True)])


BLOBS = "bucket int, blob binary"
