"""Literal cases of the text, path and display rules."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import display as D
from gleanery.functions import paths as P
from gleanery.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_identifiers(spark):
    got = one(spark, a=T.split_identifiers(F.lit("retryWithBackoff MAX_AUTH_RETRIES HTTPServer2 kebab-case x")), b=T.split_identifiers(F.lit(None).cast("string"))).asDict()
    assert got == {"a": ["retry", "with", "backoff", "max", "auth", "retries", "http", "server2", "kebab", "case"], "b": []}


@pytest.mark.parametrize("a,b", [("retry", "retries"), ("retrying", "retry"), ("classes", "class"), ("matches", "match"), ("caches", "caching")])
def test_stems_meet(spark, a, b):
    r = one(spark, a=T.stem(F.lit(a)), b=T.stem(F.lit(b)))
    assert r.a == r.b


def test_query_terms(spark):
    r = one(spark, t=T.query_terms(F.lit("How does the authentication retry work?")), o=T.or_query(T.query_terms(F.lit("'; DROP TABLE x; -- & | !"))), n=T.or_query(T.query_terms(F.lit("what is the"))), c=T.query_terms(F.lit("constructor")))
    words = [x.word for x in r.t]
    assert {"authentication", "auth", "retry", "backoff", "work"} <= set(words) and not {"how", "does", "the", "retries"} & set(words)
    assert set(r.o) <= set("abcdefghijklmnopqrstuvwxyz0123456789 |") and r.n is None and [x.word for x in r.c] == ["constructor"]


def test_paths(spark):
    kept = ["src/index.ts", "lib/a/b.py", "README.md", "Dockerfile", "package.json", ".py"]
    skipped = {"node_modules/x/index.js": "ignored-dir", ".github/w.yml": "ignored-dir", "a/.hidden/x.ts": "ignored-dir", "x.min.js": "ignored-file", "package-lock.json": "ignored-file", "types.d.ts": "ignored-file", "logo.png": "unsupported", "a_pb2.py": "ignored-file", "noext": "unsupported"}
    df = spark.createDataFrame([(p,) for p in [*kept, *skipped]], "p string").select("p", P.skip_reason_path(F.col("p")).alias("r"), P.detect_language(F.col("p")).alias("l"))
    rows = {r.p: r for r in df.collect()}
    assert all(rows[p].r is None for p in kept) and {p: rows[p].r for p in skipped} == skipped
    assert tuple(rows["src/index.ts"].l) == ("TypeScript", "typescript", "ast") and tuple(rows["README.md"].l) == ("Markdown", None, "markdown") and rows["Dockerfile"].l.strategy == "lines"


def test_contents(spark):
    df = spark.createDataFrame([("a\0b",), ("x" * 2001,), ("y" * 900 + "\n" + "z",), ("fine\nlines",)], "t string")
    assert [r[0] for r in df.select(P.skip_reason_content(F.col("t"))).collect()] == ["binary", "minified", "minified", None]


def test_references(spark):
    good = {"owner/next.js": ("owner", "next.js"), "https://github.com/a/b/tree/main/x?y#z": ("a", "b"), "git@github.com:a/b.git": ("a", "b"), "www.github.com/A/B/": ("A", "B"), " a/b ": ("a", "b")}
    bad = ["", "just-a-name", "a/..", "-a/b", "https://example.com"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string").select("x", D.parse_repo_ref(F.col("x")).alias("r"))
    got = {r.x: r.r and tuple(r.r) for r in df.collect()}
    assert {k: got[k] for k in good} == good and all(got[b] is None for b in bad)


def test_links_and_numbers(spark):
    n = lambda x: F.lit(x).cast("int")
    r = one(spark, a=D.blob_url(F.lit("o"), F.lit("r"), F.lit("abc"), F.lit("src/a b.ts"), n(3), n(9)), b=D.blob_url(F.lit("o"), F.lit("r"), F.lit(None).cast("string"), F.lit("x.ts"), n(3), n(3)), c=D.compact(n(12345)), d=D.compact(n(1234)), e=D.compact(n(999)), f=D.quoted_list(F.array(*map(F.lit, "abcde"))), g=D.quoted_list(F.array(F.lit("a"))), h=D.eta_text(F.lit(2.0), F.lit(31)), i=D.eta_text(F.lit(None).cast("double"), F.lit(31)), j=D.decode_text(F.lit(b"\xef\xbb\xbfa\xffb")))
    assert r.a == "https://github.com/o/r/blob/abc/src/a%20b.ts#L3-L9" and r.b == "https://github.com/o/r/blob/HEAD/x.ts#L3"
    assert (r.c, r.d, r.e, r.f, r.g) == ("12k", "1.2k", "999", "“a”, “b”, “c” and “d”", "“a”")
    assert (r.h, r.i, r.j) == ("about 15 s left", "measuring speed…", "a�b")
