"""Fill-in-middle: outputs equal a version written with regular expressions and slices; the round trip is exact."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed, rows):
    rnd = random.Random(seed)
    piece = lambda: rnd.choice(["a", "é", "日本", "<", "P", "S", "M", ">", " ", "\n", "\t ", "\x1c", "\x0b", "word", " x "] + ["<M>"] * (rnd.random() < 0.03))
    return ["".join(piece() for _ in range(rnd.choice([0, 1, 2, 6, 40, 300]))) for _ in range(rows)]


EDGES = [None, "", " ", "\n\n", "one", "one ", " one", "<P>", "a<", "<<<", "<S", "a <P", "x" * 5, "é é é"]


def test_outputs_and_round_trip(spark):
    rows = list(enumerate(EDGES * 8 + texts(1, 400), start=-20)) + [(None, "no id at all"), (7, "twice"), (7, "twice"), (7, "another of that id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fim.restore_middle(fim.fill_in_middle(df.withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y"), "restored": F.lit("z"), "h1": F.lit(0)})))
    got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in out.collect()), key=repr)
    assert got == sorted(((i, brute(i, t), t or "") for i, t in rows), key=repr)
    assert {f for _, (_, f, *_), _ in got} == {"plain", "psm", "spm"}
    digests = {r.doc_id: r for r in fim.digests(fim.fill_in_middle(df.where("doc_id < 0"))).collect()}
    for i, t in [x for x in rows if x[0] is not None and x[0] < 0]:
        assert (digests[i].output_sha256, digests[i].restored_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (brute(i, t)[-1], t or ""))


def test_empty_table_and_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digests(fim.fill_in_middle(df)).collect() == []
    named = fim.fill_in_middle(spark.createDataFrame([(3, "a b c")], "key int, body string"), "key", "body", fim_percent=100, spm_percent=0).first()
    assert named.form == "psm" and named.output.startswith("<P>")


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_of_any_size(monkeypatch, block):
    """A text longer than a block is scattered and gathered piece by piece."""
    monkeypatch.setattr(fim, "BLOCK", block)
    some = [t or "" for t in EDGES + texts(5, 60)]
    data = np.frombuffer("".join(some).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
    draws = np.array([[int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)] for i in range(len(some))])
    r = fim.transformed(data, at, draws, 50, 80)
    for i, t in enumerate(some):
        assert (bytes(r["data"][r["at"][i] : r["at"][i + 1]]).decode(), r["n"][i]) == (brute(i, t)[-1], brute(i, t)[0])
    back, where = fim.restored(r["data"], r["at"], r["form"])
    assert bytes(back) == bytes(data) and (where == at).all()


def test_a_very_long_text(spark):
    text = "wörter und  <mehr>\n" * 300_000  # 6 MB
    df = spark.createDataFrame([(i, text) for i in (1, 2, 3, 4)], "doc_id long, text string")
    rows = fim.fill_in_middle(df, fim_percent=100).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars) == (900_001, *_long(r.doc_id, text)) for r in rows)
    assert fim.restore_middle(fim.fill_in_middle(df, fim_percent=100)).where(F.col("restored") != F.lit(text)).count() == 0


def _long(doc_id, text):
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = TOKENS.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    return "spm" if h[3] % 100 < 80 else "psm", len("".join(units[:a])), len("".join(units[a:b]))


def test_a_spoiled_output_is_an_error(spark):
    df = spark.createDataFrame([("<P>a<S>b", "psm")], "output string, form string")
    with pytest.raises(Exception, match="each marker once"):
        fim.restore_middle(df).collect()
