"""The folds against the loops that cut files with definitions."""

import random
import re

from pyspark.sql import functions as F

from gleanery.operators import chunking as C
from gleanery.operators import folds as FO

SCHEMA = "repo_id string, path string, language string, strategy string, content string"
LIMITS = C.MAX_CHARS, C.MIN_CHARS, C.MAX_LINES, C.OVERLAP


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé漢 ") for _ in range(r.choice([0, 3, 9, 40])))
    out = []
    for k in range(240):
        md = k % 2 == 0
        lines = []
        for _ in range(r.choice([1, 3, 20, 90, 400])):
            p = r.random()
            if md and p < 0.15:
                lines.append("#" * r.randint(1, 7) + r.choice([" ", "  ", "\t", ""]) + word() + r.choice(["", "x" * 90]))
            elif md and p < 0.2:
                lines.append(r.choice(["```", "  ~~~", "```py"]))
            elif p < 0.35:
                lines.append(r.choice(["", "  ", "\t", "　", "\x1c"]))
            else:
                lines.append(word() * r.choice([1, 1, 2, 9, 12 if k % 5 else 45]))
        out.append(("r", f"f{k}", "Markdown" if md else "YAML", "markdown" if md else "lines", r.choice(["\n", "\n", "\r\n", "\r"]).join(lines)))
    wide = "\n".join("w" * n for n in (370, 380, 375, 390, 371, 1600, 5, 372, 372, 372, 372, 372))  # windows that advance a line at a time
    edges = [wide, "", None, "\n" * 500, "x" * 1500, "x" * 1501, "x" * 24, "# a\n```\n# b\n```\n# c\n" + "y" * 800, "#\n# \n#  \n" + "z" * 400, "\n".join("ab" for _ in range(2000))]
    return out + [("r", f"e{k}{s}", None, s, t) for k, t in enumerate(edges) for s in ("markdown", "lines")] + [("r", "none", None, None, "q" * 30)]


def test_folds_equal_loops(spark):
    rows = corpus()
    got = FO.plain_chunks(spark.createDataFrame(rows, SCHEMA), *LIMITS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan
    want = sorted((p, *c) for _, p, g, s, t in rows if t for c in C.chunk_text(t, g, s))
    have = sorted((r.path, r.start_line, r.end_line, r.symbol, r.kind, r.content) for r in got.collect())
    key = lambda x: (x[0], x[1], x[2], x[3] or "", x[4])
    assert [key(x) for x in have] == [key(x) for x in want] and have == want


def test_windows_by_brute_force(spark):
    """No loop of the library's: each window is the longest that begins where the rule says."""
    for _, path, _, strategy, t in corpus():
        if strategy != "lines" or not t or not path.startswith("e"):
            continue
        ls = re.split("\r\n?|\n", t)
        want, s = [], 0
        while True:
            e = max([e for e in range(s, min(len(ls), s + 81)) if e == s or sum(len(x) + 1 for x in ls[s : e + 1]) <= 1500])
            want.append((s, e))
            if e == len(ls) - 1:
                break
            s = max(e - 3, s + 1)
        df = spark.createDataFrame([(t,)], "content string").select(FO.lines_of(F.col("content")).alias("ls"))
        got = df.select(FO.line_windows(F.col("ls"), F.lit(0), F.lit(0), F.array().cast("array<string>"), 1500, 81, 4).alias("w")).first().w
        assert [(w.a, w.b) for w in got] == want and all(w.stop - w.start == sum(len(x) + 1 for x in ls[w.a : w.b + 1]) for w in got)


def test_most_and_extra_columns(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in corpus()[:20]], SCHEMA + ", kind string, _lines int")
    assert FO.plain_chunks(rows, *LIMITS, most=2).groupBy("path").count().agg(F.max("count")).first()[0] == 2
    assert FO.plain_chunks(rows.limit(0), *LIMITS).count() == 0
