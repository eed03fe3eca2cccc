"""Repository archives: gzip tarballs to one row per file."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.display import decode_text

MAX_BYTES, MAX_RATIO = 60 << 20, 8
#: Bytes of an archive before compression, and of a member's headers and padding, about.
PART_BYTES, MEMBER_BYTES = 32 << 20, 3 << 10
FILES = "archive string, commit_sha string, path string, size long, content binary, problem string"


def guard_archives(archives: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """archives with problem 'too large' where the compressed size passes the limit; judged before any content is read."""
    return archives.withColumn("problem", F.when(F.col("length") > most, "too large"))


def _limited(data: bytes, most: int) -> Iterator[tuple[tarfile.TarInfo, tarfile.TarFile]]:
    class Counted(io.RawIOBase):
        def __init__(self) -> None:
            self.inner, self.seen = gzip.GzipFile(fileobj=io.BytesIO(data)), 0

        def readable(self) -> bool:
            return True

        def readinto(self, b) -> int:
            got = self.inner.read(len(b))
            self.seen += len(got)
            if self.seen > most:
                raise ValueError("unpacks to too much")
            b[: len(got)] = got
            return len(got)

    with tarfile.open(fileobj=io.BufferedReader(Counted()), mode="r|") as tar:
        for member in tar:
            yield member, tar


def open_archives(archives: DataFrame, most: int = MAX_BYTES, largest_file: int = P.MAX_FILE_BYTES, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """(archive, commit_sha, path, size, content, problem) of every regular file of archives (path, length, content).

    The top folder goes; long and pax names are honoured; the commit is the global pax comment if it is 40 hex digits.
    Files above largest_file, and those whose path is not wanted, have a null content, and their bodies are not unpacked
    (P.wants_content: what admission by path keeps). An archive that is too large, unpacks to more than eight times the
    limit, or is damaged has one row that names its problem (files before a damage are kept).
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                out, problem, sha = [], row.problem, None
                if not problem:
                    try:
                        for m, tar in _limited(row.content, most * MAX_RATIO):
                            comment = tar.pax_headers.get("comment", "")
                            sha = comment if re.fullmatch(r"[0-9a-f]{40}", comment) else None
                            if m.isreg() and "/" in m.name.strip("/"):
                                path = m.name.strip("/").split("/", 1)[1]
                                body = tar.extractfile(m).read() if m.size <= largest_file and (wanted is None or wanted(path)) else None
                                out.append((row.path, sha, path, m.size, body, None))
                    except (OSError, EOFError, tarfile.TarError, ValueError) as e:
                        problem = "unpacks to too much" if "too much" in str(e) else "damaged"
                if problem:
                    out.append((row.path, sha, None, None, None, problem))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in FILES.split(", ")])

    some = guard_archives(archives, most)
    kept = some.select("path", "problem", F.when(F.col("problem").isNull(), F.col("content")).alias("content"))
    return kept.mapInPandas(unpack, FILES)


def read_archives(spark: SparkSession, glob: str, most: int = MAX_BYTES, wanted: Callable[[str], bool] | None = P.wants_content) -> DataFrame:
    """The files of all archives that match; one archive is the unit of work. Oversized ones are rejected by their length alone; bodies that admission refuses by path stay packed."""
    files = spark.read.format("binaryFile").load(glob)
    large = files.where(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    small = files.where(F.col("length") <= most).select("path", "length", "content")
    return open_archives(small.union(large), most, wanted=wanted)


def pack_archives(files: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """(path, length, content): gzip tarballs of the files (repo_id, path, content) of each repo, as a code host would send them; for tests and exports.

    A repo is dealt by a hash of its files into groups of about half of `most` bytes each, counted beforehand, so that no
    task has a whole repo; a group that is still larger goes on in a further archive. Only one file may pass `most`.
    Archives are named REPO.partG-K.tar.gz (repo_of takes that off again).
    """
    weight = F.coalesce(F.octet_length("content").cast("long"), F.lit(0)) + F.lit(MEMBER_BYTES)
    sizes = files.groupBy(F.col("repo_id").alias("repo")).agg(F.greatest(F.lit(1), F.ceil(F.sum(weight) / F.lit(max(1, most // 2)))).alias("parts"))
    sizes = F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes
    dealt = files.select("repo_id", "path", "content").join(sizes, F.col("repo_id").eqNullSafe(F.col("repo")))
    dealt = dealt.select("repo_id", "path", "content", F.pmod(F.xxhash64("path", "content"), F.col("parts")).alias("part"))

    def archive(repo: str, rows: list) -> bytes:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w:gz", format=tarfile.PAX_FORMAT, pax_headers={"comment": hashlib.sha1(repo.encode()).hexdigest()}, compresslevel=1) as tar:
            top = tarfile.TarInfo(f"{repo}-main")
            top.type = tarfile.DIRTYPE
            tar.addfile(top)
            for path, body in rows:
                info = tarfile.TarInfo(f"{repo}-main/{path}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return raw.getvalue()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        repo, part, out, rows, size = str(pdf["repo_id"].iloc[0]), pdf["part"].iloc[0], [], [], 0

        def close() -> None:
            content = archive(repo, rows)
            out.append((f"{repo}.part{part}-{len(out)}.tar.gz", len(content), content))

        for r in pdf.sort_values("path").itertuples():
            body = r.content.encode() if isinstance(r.content, str) else bytes(r.content)
            if rows and size + len(body) + MEMBER_BYTES > most:
                close()
                rows, size = [], 0
            rows.append((r.path, body))
            size += len(body) + MEMBER_BYTES
        close()
        return pd.DataFrame(out, columns=["path", "length", "content"])

    return dealt.groupBy("repo_id", "part").applyInPandas(pack, "path string, length long, content binary")


def file_texts(files: DataFrame) -> DataFrame:
    """(repo_id, path, content) of unpacked files whose bodies were read, as text: what admission and the chunker take."""
    return files.where("content is not null").select(F.regexp_replace(repo_of(F.col("archive")), r"\.tar\.gz$", "").alias("repo_id"), "path", decode_text(F.col("content")).alias("content"))


def repo_of(archive: Column) -> Column:
    """REPO.tar.gz of an archive's name by pack_archives."""
    return F.regexp_replace(archive, r"\.part\d+-\d+\.tar\.gz$", ".tar.gz")
