"""Text analysis as column expressions: identifiers, stems, query terms, postings' words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing in a question about code.
QUESTION_WORDS = (
    "a an and are as at be by can code do does for from how i if in into is it its me my of on or our "
    "should so that the their them then there these this to use used uses using was we what when where "
    "which who why will with you your find show get gets function functions method logic "
    "handle handles handled handling implement implemented implementation part place thing things any all"
).split(" ")

# The usual English stop words of text search, dropped in the keyword leg.
ENGLISH_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split(" ")

# Code abbreviations of words in questions.
ALIASES = {
    "authentication": ["auth"],
    "authenticate": ["auth"],
    "authorization": ["auth", "authz"],
    "configuration": ["config", "conf"],
    "config": ["configuration"],
    "database": ["db"],
    "request": ["req"],
    "response": ["res", "resp"],
    "error": ["err"],
    "errors": ["err"],
    "message": ["msg"],
    "initialize": ["init"],
    "initialise": ["init"],
    "parameter": ["param"],
    "parameters": ["params"],
    "argument": ["arg"],
    "arguments": ["args"],
    "directory": ["dir"],
    "temporary": ["tmp", "temp"],
    "environment": ["env"],
    "password": ["pwd", "passwd"],
    "repository": ["repo"],
    "connection": ["conn"],
    "context": ["ctx"],
    "retry": ["retries", "backoff"],
    "retries": ["retry", "backoff"],
}

MAX_TERMS = 16


def no_words() -> Column:
    return F.array().cast("array<string>")


def split_identifiers(text: Column) -> Column:
    """Lower-case words of camelCase, PascalCase, snake_case and kebab-case text; one-letter words go. Null text has none."""
    humps = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    humps = F.regexp_replace(humps, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9]+"), lambda w: F.length(w) > 1)


def stem(word: Column) -> Column:
    """A small suffix stripper: enough for retry, retries and retrying to meet."""
    n = F.length(word)
    cut = (
        F.when((n > 5) & word.endswith("ing"), F.left(word, n - 3))
        .when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 4) & word.endswith("ed"), F.left(word, n - 2))
        .when((n > 4) & word.rlike("(ss|x|ch|sh)es$"), F.left(word, n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )
    return F.when((F.length(cut) > 3) & cut.endswith("e"), F.left(cut, F.length(cut) - 1)).otherwise(cut)


def with_aliases(words: Column) -> Column:
    """Each word, followed by its abbreviations."""
    table = F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), no_words()))))


def query_terms(query: Column) -> Column:
    """Meaningful words of a question with their stems, the first word of each stem, at most 16: array<struct<word, stem>>."""
    kept = F.filter(with_aliases(split_identifiers(query)), lambda w: (F.length(w) >= 2) & ~w.isin(QUESTION_WORDS))
    terms = F.transform(kept, lambda w: F.struct(w.alias("word"), stem(w).alias("stem")))
    fold = F.aggregate(terms, F.array().cast("array<struct<word:string,stem:string>>"), lambda acc, t: F.when(F.exists(acc, lambda a: a["stem"] == t["stem"]), acc).otherwise(F.concat(acc, F.array(t))))
    return F.slice(fold, 1, MAX_TERMS)


def or_query(terms: Column) -> Column:
    """The terms' words as an OR query; null if there are none."""
    words = F.filter(F.transform(terms, lambda t: F.regexp_replace(t["word"], "[^a-z0-9]", "")), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(words, " | "))


def head_words(path: Column, symbol: Column) -> Column:
    return F.concat(split_identifiers(symbol), split_identifiers(path))


def searchable_text(path: Column, symbol: Column, content: Column, most: int | None = None) -> Column:
    """struct<head, body>: symbol and path words, content words, all of them or up to `most` characters."""
    body = F.array_join(split_identifiers(content), " ")
    body = body if most is None else F.left(body, F.lit(most))
    return F.struct(F.array_join(head_words(path, symbol), " ").alias("head"), body.alias("body"))


def embedding_text(path: Column, symbol: Column, kind: Column, content: Column) -> Column:
    """What is embedded for a chunk: path, kind and symbol with its words, then the content."""
    words = F.array_join(split_identifiers(symbol), " ")
    named = F.concat(path, F.lit(" — "), kind, F.lit(" "), symbol, F.lit(" ("), words, F.lit(")"))
    return F.concat(F.when(F.coalesce(symbol, F.lit("")) != "", named).otherwise(path), F.lit("\n"), content)


def term_hits(tokens: Column, terms: Column) -> Column:
    """Words of the terms that any token meets: equal stems, or one a prefix (of four letters at least) of the other. In the order of the tokens."""

    def meets(stemmed: Column) -> Column:
        same = lambda t: (stemmed == t["stem"]) | ((F.length(t["stem"]) >= 4) & stemmed.startswith(t["stem"])) | ((F.length(stemmed) >= 4) & t["stem"].startswith(stemmed))
        return F.transform(F.filter(terms, same), lambda t: t["word"])

    return F.array_distinct(F.flatten(F.transform(F.transform(tokens, stem), meets)))
