"""Chunks by their properties, and cases of each strategy."""

from gleanery.operators import chunking as C

TS = "import a from 'a';\n\nexport class Store {\n" + "".join(f"  method{k}(x: number) {{\n" + "".join(f"    const value{k}_{i} = compute(x, {i}, 'some text');\n" for i in range(22)) + "  }\n\n" for k in range(2)) + "}\n\nexport const run = async (q: string) => {\n" + "  await step(q);\n" * 40 + "};\n"
PY = "import os\n\n\nclass Tree:\n" + "".join(f"    def grow{k}(self, n):\n" + f"        total = total + n * {k}  # and a comment\n" * 22 + "\n" for k in range(2))


def spans(text, language, strategy="ast"):
    return C.chunk_text(text, language, strategy)


def check(text, chunks):
    lines = text.split("\n")
    for a, b, _, _, content in chunks:
        assert content == "\n".join(lines[a - 1 : b])
        assert len(content) <= 1.35 * C.MAX_CHARS
    seen = {i for a, b, *_ in chunks for i in range(a, b + 1)}
    missed = [x for i, x in enumerate(lines, 1) if i not in seen and x.strip()]
    assert sum(map(len, missed)) < 60


def test_definitions():
    for text, language in ((TS, "TypeScript"), (PY, "Python")):
        chunks = spans(text, language)
        check(text, chunks)
        names = " ".join(c[2] or "" for c in chunks)
        assert ("Store.method0" in names and "run" in names) if language == "TypeScript" else "Tree.grow1" in names
        assert any(c[3] == "method" for c in chunks)


def test_a_long_class_keeps_its_first_and_last_lines():
    """Signature, fields and closing line go with the methods beside them, and each chunk has the class's name."""
    field = "  private readonly name_of_a_field: Map<string, number> = new Map();\n"
    for fields, rows in ((1, 18), (1, 26), (25, 26)):
        method = lambda k: f"  method{k}(x: number) {{\n" + "".join(f"    const value{k}_{i} = compute(x, {i}, 'some text');\n" for i in range(rows)) + "  }\n"  # noqa: B023, E731
        text = "export class Store extends Base {\n" + field * fields + "".join(map(method, range(4))) + "}\n"
        chunks = [c for c in spans(text, "TypeScript") if c[4].strip()]
        held = {i for a, b, *_ in chunks for i in range(a, b + 1)}
        lines = text.split("\n")
        assert all(i in held for i, x in enumerate(lines, 1) if x.strip() and x != "}")
        assert all("Store" in (c[2] or "") for c in chunks) and all(len(c[4]) <= C.EDGE * C.MAX_CHARS for c in chunks)
        assert chunks[0][4].startswith("export class Store") and (chunks[-1][4].endswith("\n}") or rows > 20)
        if fields == 1:
            assert chunks[0][2].startswith("Store.method0") or "Store" in chunks[0][2]


def names(text, language="TypeScript"):
    return [(d.name, d.kind, d.start + 1, d.end + 1, d.depth) for d in C.signature_boundaries(text.split("\n"), language)]


def test_names_of_members_constants_and_tests():
    text = """const limit = 5
const table = {
  a: 1, // }
  b: [2, 3],
};
function run() {
  const local = 1;
  return local;
}
res.sendFile = function sendFile(path) {
  return path;
};
module.exports.open = (a) => {
  return a;
};
exports.Store = class {
};
describe('the store', () => {
  it.only("keeps 'all'", async () => {
    const inner = 2;
  });
});
const { a, b } = table;
"""
    assert names(text) == [("limit", "variable", 1, 1, 0), ("table", "variable", 2, 5, 0), ("run", "function", 6, 9, 0), ("res.sendFile", "function", 10, 12, 0), ("open", "function", 13, 15, 0), ("Store", "class", 16, 17, 0), ('describe "the store"', "test", 18, 22, 0), ("it \"keeps 'all'\"", "test", 19, 21, 1)]


def test_braces_in_strings_templates_and_comments_are_no_code():
    text = """function one() {
  const a = "}"; // }
  /* }
  function hidden() { */
  const b = `}
function alsoHidden() {
  ${ [1].map((x) => { return `}${x}`; }) } }`;
  return a + b + '\\'}';
}
function two(x) {
}
"""
    assert [(n, a, b) for n, _, a, b, _ in names(text)] == [("one", 1, 9), ("two", 10, 11)]


def test_headings():
    md = "# One\n\n" + "a sentence of the first section. " * 9 + "\n\n## Two\n\n" + "word " * 180 + "\n\n```\n# not a heading\n```\n## Three\n\n" + "text " * 200
    chunks = spans(md, "Markdown", "markdown")
    check(md, chunks)
    assert [c[2] for c in chunks] == ["One", "Two", "Three"] and {c[3] for c in chunks} == {"section"}
    folded = "## A\n\nshort\n## B\n\nshort too\n## C\n\n" + "text " * 200
    assert [c[2] for c in spans(folded, "Markdown", "markdown")] == ["A, C"]  # B joins A and keeps its name; the sliver of both joins C
    assert not any(c[2] and "not a heading" in c[2] for c in chunks)


def test_windows_and_small_files():
    text = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(400))
    chunks = spans(text, "Kotlin", "lines")
    check(text, chunks)
    assert all(n[0] == max(p[1] - 3, p[0] + 1) for p, n in zip(chunks, chunks[1:]))
    assert [(c[0], c[1], c[3]) for c in spans("let a = 1;\nlet b = 2; // and more", "TypeScript")] == [(1, 2, "file")]
    assert spans("tiny", "Go") == [] and spans("", "Go") == []
    long = "\n".join(["y" * 700] * 9)
    assert [c[:2] for c in spans(long, "Kotlin", "lines")][:2] == [(1, 2), (2, 3)]


def test_chunk_table(spark):
    df = spark.createDataFrame([("r", "a.ts", "TypeScript", "ast", TS), ("r", "b.py", "Python", "ast", PY), ("r", "c.md", "Markdown", "markdown", ""), ("r", "d.md", "Markdown", "markdown", None)], "repo_id string, path string, language string, strategy string, content string")
    one, two = (sorted((r.id, r.path, r.start_line) for r in C.chunk_files(df).collect()) for _ in range(2))
    assert one == two and len({r[0] for r in one}) == len(one) and {r[1] for r in one} == {"a.ts", "b.py"}
