"""What a path or a text says about a file: its language, and whether it is worth indexing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> (language, grammar). Without a grammar a file is cut into line windows; Markdown into sections.
EXTENSIONS = {
    "ts": ("TypeScript", "typescript"), "mts": ("TypeScript", "typescript"), "cts": ("TypeScript", "typescript"), "tsx": ("TypeScript", "tsx"),
    "js": ("JavaScript", "javascript"), "mjs": ("JavaScript", "javascript"), "cjs": ("JavaScript", "javascript"), "jsx": ("JavaScript", "javascript"),
    "py": ("Python", "python"), "go": ("Go", "go"), "rs": ("Rust", "rust"), "java": ("Java", "java"), "cs": ("C#", "c-sharp"),
    "c": ("C", "cpp"), "h": ("C", "cpp"), "cc": ("C++", "cpp"), "cpp": ("C++", "cpp"), "cxx": ("C++", "cpp"), "hpp": ("C++", "cpp"), "hh": ("C++", "cpp"),
    "rb": ("Ruby", "ruby"), "php": ("PHP", "php"), "sh": ("Shell", "bash"), "bash": ("Shell", "bash"), "css": ("CSS", "css"),
    "kt": ("Kotlin", None), "kts": ("Kotlin", None), "swift": ("Swift", None), "scala": ("Scala", None), "dart": ("Dart", None), "lua": ("Lua", None),
    "ex": ("Elixir", None), "exs": ("Elixir", None), "erl": ("Erlang", None), "hs": ("Haskell", None), "clj": ("Clojure", None), "r": ("R", None),
    "jl": ("Julia", None), "zig": ("Zig", None), "vue": ("Vue", None), "svelte": ("Svelte", None), "astro": ("Astro", None), "scss": ("SCSS", None),
    "sql": ("SQL", None), "graphql": ("GraphQL", None), "gql": ("GraphQL", None), "proto": ("Protobuf", None), "tf": ("Terraform", None),
    "yaml": ("YAML", None), "yml": ("YAML", None), "toml": ("TOML", None), "md": ("Markdown", None), "mdx": ("Markdown", None),
}
# Whole names, lower-cased.
SPECIAL_FILES = {"dockerfile": "Dockerfile", "makefile": "Makefile", "package.json": "JSON"}
# Folders that hold no source.
IGNORED_DIRS = (
    "node_modules bower_components vendor third_party third-party dist build out target obj coverage .git .github .next .nuxt .svelte-kit "
    ".turbo .cache .venv venv __pycache__ .mypy_cache .pytest_cache .idea .vscode .gradle Pods DerivedData __snapshots__ fixtures testdata"
).split(" ")
# Generated, locked and packed files.
IGNORED_FILES = (
    r"(?i)\.min\.(js|css)$", r"(?i)\.bundle\.js$", r"(?i)\.map$", r"(?i)\.d\.ts$", r"(?i)\.snap$", r"(?i)\.lock$",
    r"(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|composer\.lock|Gemfile\.lock|Cargo\.lock|poetry\.lock|go\.sum)$",
    r"(?i)(^|/)CHANGELOG\.md$", r"(?i)\.generated\.\w+$", r"_pb2\.py$", r"\.pb\.go$",
)
# Where tests live; weights of tests and of prose against code.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|specs?|e2e|benchmarks?)/|[._-](test|spec)s?\.[a-z]+$"
TEST_PRIOR, DOCS_PRIOR = 0.65, 0.9
MAX_LINE, MEAN_LINE, MAX_FILE_BYTES = 2000, 300, 200 * 1024


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_part(path: Column) -> Column:
    """Up to and with the last slash; empty without one."""
    return F.regexp_extract(path, "^(.*/)?", 0)


def file_part(path: Column) -> Column:
    return F.substr(path, F.length(dir_part(path)) + 1)


def detect_language(path: Column) -> Column:
    """struct<language, grammar, strategy>; null if the name says nothing. Strategies: ast (a grammar is known), markdown, lines."""
    base = F.lower(base_name(path))
    ext = F.when((F.instr(base, ".") > 0), F.element_at(F.split(base, r"\."), -1))
    pick = lambda table: F.try_element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), F.coalesce(ext, F.lit("")))
    special = F.try_element_at(F.create_map(*(x for k, v in SPECIAL_FILES.items() for x in (F.lit(k), F.lit(v)))), base)
    language = F.coalesce(special, pick({k: v[0] for k, v in EXTENSIONS.items()}))
    grammar = F.when(special.isNull(), pick({k: v[1] for k, v in EXTENSIONS.items() if v[1]}))
    strategy = F.when(language == "Markdown", "markdown").when(grammar.isNotNull(), "ast").otherwise("lines")
    return F.when(language.isNotNull(), F.struct(language.alias("language"), grammar.alias("grammar"), strategy.alias("strategy")))


def skip_reason_path(path: Column) -> Column:
    """ignored-dir, ignored-file or unsupported; null: keep. Only folders are tested against the list, not the file's own name."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(dirs, lambda d: d.isin(IGNORED_DIRS) | (d.startswith(".") & (d != ".")))
    ignored = F.lit(False)
    for pattern in IGNORED_FILES:
        ignored = ignored | path.rlike(pattern)
    return F.when(hidden, "ignored-dir").when(ignored, "ignored-file").when(detect_language(path).isNull(), "unsupported")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def longest_line(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))


def skip_reason_content(text: Column) -> Column:
    """binary (a NUL) or minified (a line over 2000 characters, or over 300 a line); null: keep."""
    return F.when(F.instr(text, "\0") > 0, "binary").when((longest_line(text) > MAX_LINE) | (F.length(text) / line_count(text) > MEAN_LINE), "minified")


def path_prior(path: Column, language: Column) -> Column:
    return F.when(path.rlike(TEST_PATH), TEST_PRIOR).when(language == "Markdown", DOCS_PRIOR).otherwise(1.0)


def wants_content(path: str) -> bool:
    """skip_reason_path() is null, for readers that decide file by file whether to unpack a body."""
    *dirs, name = path.split("/")
    base = name.lower()
    known = base in SPECIAL_FILES or ("." in base and base.rsplit(".", 1)[1] in EXTENSIONS)
    return known and not any(d in IGNORED_DIRS or (d.startswith(".") and d != ".") for d in dirs) and not any(re.search(p, path) for p in IGNORED_FILES)
