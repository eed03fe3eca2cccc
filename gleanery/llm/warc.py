"""WARC archives, written and read by Spark's own text writer and reader, so any file system that Spark knows will do.

Reading: the reader deals out byte ranges and cuts them at every record magic, real or inside a payload. Each piece
names a candidate record and, from its Content-Length, where the next record must begin. Per file, pointer jumping
from offset 0 over those links leaves the reachable records; all other magics are payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
#: The digits of base32 (RFC 4648); fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as upper-case base32: each 5 of the 40 hex digits are 4 of its characters."""
    five = [F.conv(F.substring(F.sha1(payload), 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    digit = lambda v, shift: F.substr(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*(digit(v, s) for v in five for s in (15, 10, 5, 0)))


def _number(n: Column) -> Column:
    return n.cast("string")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """One record per row: a response, or, where a smaller id has the same payload of at least `least` bytes, a revisit of it without payload.

    Null payload is empty; control characters in a URL become spaces; rows of one id and payload are all responses or
    all revisits; a null id comes last and is written without one. per_file bounds the records of a file.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    size = F.octet_length("payload")
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    same = rows.where(size >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    rows = rows.join(C.small(C.materialize(same)), "digest", "left")
    revisit = (size >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda i: F.concat(F.lit("<urn:page:"), _number(i), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", _number(size)), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.when(F.col("id").isNotNull(), line("WARC-Record-ID", name(F.col("id")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", name(F.col("first")))).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", _number(F.octet_length(http) + F.when(revisit, 0).otherwise(size))),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for row in head.decode("utf-8", "replace").split("\r\n"):
        key, sep, value = row.partition(":")
        if sep:
            out[key.strip().lower()] = value.strip()
    return out


def parse(record: bytes) -> tuple[int, dict[str, str], bytes | None] | None:
    """Of what follows a magic: the bytes up to the end of the record by its Content-Length, the named fields, and the block if all of it is there. None if this is no record head."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = _fields(record[:end])
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    n = int(fields["content-length"])
    whole = end + 4 + n + len(END)
    return whole, fields, record[end + 4 : end + 4 + n] if len(record) >= end + 4 + n else None


def _named(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_SCHEMA = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
PIECE = "file string, block long, idx long, size long, jump long, whole boolean"
PIECE_SCHEMA = [("file", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("size", pa.int64()), ("jump", pa.int64()), ("whole", pa.bool_())]


def _record(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """The columns of a record. The digest of a response is computed from its payload; a revisit carries that of the full payload, and its length in the HTTP head."""
    http, payload = {}, block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(head)
    kind = fields["warc-type"]
    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    if kind == "revisit":
        digest, size = fields.get("warc-payload-digest", "").rpartition(":")[2] or None, int(http.get("content-length", 0))
    return _named(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, kind, _named(fields.get("warc-refers-to")), payload if payloads else None


def _columns(rows: list[tuple], schema: list) -> dict[str, pa.Array]:
    return {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(schema)}


def _pieces(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Rows of PIECE and, where a piece holds a whole record, of RECORD. A byte range is read by one task from its start, so (file, block, idx) names a piece whenever it is read."""
    at, idx = None, 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            pieces, records = [], []
            for value, file, block in zip(part.column("value").cast(pa.binary()).to_pylist(), part.column("file").to_pylist(), part.column("block").to_pylist(), strict=True):
                at, idx = (file, block), idx + 1 if at == (file, block) else 0
                got = parse(value)
                whole = bool(got and got[2] is not None)
                pieces.append((file, block, idx, len(value), got[0] if got else None, whole))
                records.append(_record(got[1], got[2], payloads) if whole else (None,) * 7)
            columns = _columns(pieces, PIECE_SCHEMA) | _columns(records, RECORD_SCHEMA)
            yield pa.record_batch(list(columns.values()), list(columns))


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the candidates (sorted by offset) lie on the chain from offset 0: pointers double in each round, and so does what is known to be reachable."""
    n = len(offset)
    to = np.searchsorted(offset, successor)
    to = np.append(np.where((to < n) & (offset[np.minimum(to, n - 1)] == successor), to, n), n) if n else np.zeros(1, np.int64)
    known = np.zeros(n + 1, bool)
    if n and offset[0] == 0:
        known[0] = True
    for _ in range(max(1, n).bit_length()):
        known[to[known]] = True
        to = to[to]
    return known[:n]


def _chained(table: pa.Table) -> pa.Table:
    """Of a file's pieces: the record each belongs to (its offset) and the place in it; pieces of no record go."""
    order = np.lexsort((table.column("idx").to_numpy(), table.column("block").to_numpy()))
    size = table.column("size").to_numpy()[order]
    jump = table.column("jump").fill_null(-1).to_numpy()[order]
    step = len(MAGIC)
    begin = np.concatenate([[0], np.cumsum(size + step)])[:-1] - step  # where each piece's magic stands; the first piece has none
    real = np.zeros(len(size), bool)
    able = np.flatnonzero((np.arange(len(size)) > 0) & (jump >= 0))
    real[able] = reachable(begin[able], begin[able] + step + jump[able])
    last = np.maximum.accumulate(np.where(real, np.arange(len(size)), -1))
    keep = np.flatnonzero(last >= 0)
    keep = keep[begin[keep] < begin[last[keep]] + step + jump[last[keep]]]  # a tail that no record claims is none
    rows = table.take(pa.array(order[keep]))
    return rows.append_column("offset", pa.array(begin[last[keep]], pa.int64())).append_column("nth", pa.array(keep - last[keep], pa.int64()))


def _joined(table: pa.Table, payloads: bool) -> pa.Table:
    """One record from its pieces, with the magics that were payload put back."""
    order = np.argsort(table.column("nth").to_numpy())
    values = table.column("value").cast(pa.binary()).to_pylist()
    got = parse(MAGIC.encode().join(values[i] for i in order))
    row = _record(got[1], got[2], payloads) if got and got[2] is not None else None
    where = [table.column("file")[0].as_py(), table.column("offset")[0].as_py()]
    columns = {"file": pa.array([where[0]] if row else [], pa.string()), "offset": pa.array([where[1]] if row else [], pa.int64())} | _columns([row] if row else [], RECORD_SCHEMA)
    return pa.table(columns)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """file, offset, page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the WARC/1.1 files below path. Files may be read in any number of byte ranges; records that payload magics cut into pieces are put together again; records cut off by the end of a file are left out."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a file's pieces meet without their payloads, however large it is
    pieces = raw.mapInArrow(C.mapped(_pieces, False), f"{PIECE}, {RECORD}")
    own = [c.split()[0] for c in RECORD.split(", ")]
    chained = C.materialize(pieces.groupBy("file").applyInArrow(C.grouped(_chained), f"{PIECE}, {RECORD}, offset long, nth long"))
    records = chained.where("nth = 0 and whole").select("file", "offset", "block", "idx", *own)
    if payloads:
        full = raw.mapInArrow(C.mapped(_pieces, True), f"{PIECE}, {RECORD}").select("file", "block", "idx", "payload")
        records = records.drop("payload").join(full, ["file", "block", "idx"])
    records = records.select("file", "offset", *own)
    if chained.where("nth = 0 and not whole").take(1):
        cut = chained.where("nth = 0 and not whole").select("file", "offset")
        parts = chained.join(C.small(cut), ["file", "offset"], "left_semi").select("file", "block", "idx", "offset", "nth")
        values = raw.mapInArrow(C.mapped(_numbered), "value binary, file string, block long, idx long")
        whole = values.join(C.small(parts), ["file", "block", "idx"]).groupBy("file", "offset").applyInArrow(C.grouped(_joined, payloads), f"file string, offset long, {RECORD}")
        records = records.union(whole)
    return records if payloads else records.drop("payload")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, idx = None, 0
    for batch in batches:
        number = []
        for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
            at, idx = (file, block), idx + 1 if at == (file, block) else 0
            number.append(idx)
        yield pa.record_batch([batch.column("value").cast(pa.binary()), batch.column("file"), batch.column("block"), pa.array(number, pa.int64())], ["value", "file", "block", "idx"])
