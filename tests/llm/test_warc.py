import base64
import hashlib

import numpy as np
from tests_llm_corpus import prose

from gleanery.llm import common as C
from gleanery.llm.warc import END, MAGIC, read_warc, reachable, write_warc

FAKE = MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" + END
PAYLOADS = ["plain", "", None, "plain", FAKE, "a" + FAKE + "b" + FAKE, MAGIC, MAGIC * 3, END, "x" + END + MAGIC, "\r\n", "é" * 900, prose(3, 3000), "plain", "", MAGIC[:-1], FAKE[:30]]


def expected(rows, least):
    out = []
    for i, u, p in rows:
        b = (p or "").encode()
        same = [j for j, _, q in rows if (q or "").encode() == b and j is not None]
        first = min(same) if same and len(b) >= least else None
        revisit = first is not None and first != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(3 * k + 1, f"http://h/{k}\r\nX: y" if k == 2 else f"http://h/{k}", p) for k, p in enumerate(PAYLOADS)]
    rows += [rows[0], (None, None, "alone"), (None, "u", "plain")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    for least in (0, 3):
        path = C.shared_dir(spark)
        write_warc(df, path, least=least, per_file=4)
        got = read_warc(spark, path).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows, least)
    full = {r.page_id: r for r in read_warc(spark, path, payloads=True).collect()}
    assert all(bytes(full[i].payload) == (p or "").encode() for i, _, p in rows if i and full[i].record_type == "response")


def test_small_byte_ranges_and_cut_off_files(spark):
    df = spark.createDataFrame([(k, "u", FAKE + prose(k, 50) + MAGIC) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    path = C.shared_dir(spark)
    write_warc(df, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted(r.page_id for r in read_warc(spark, path).collect()) == list(range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    cut = C.shared_dir(spark)
    spark.createDataFrame([(text[: len(text) // 2],)], "value string").coalesce(1).write.option("lineSep", "\n").text(cut)
    n = len(read_warc(spark, cut).collect())
    assert 15 <= n <= 20


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = C.shared_dir(spark)
    write_warc(df, path)
    assert read_warc(spark, path).count() == 0


def test_pointer_jumping():
    offset = np.array([0, 10, 15, 30, 31, 50])
    successor = np.array([10, 30, 31, 50, 50, 99])
    assert reachable(offset, successor).tolist() == [True, True, False, True, False, True]
    assert reachable(offset[1:], successor[1:]).any() == False  # noqa: E712
    assert reachable(np.zeros(0, int), np.zeros(0, int)).tolist() == []
    chain = np.arange(5000) * 7
    assert reachable(chain, chain + 7).all()
