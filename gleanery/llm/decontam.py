"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Token positions that each seed compares; those between are ignored. Any window of 8 to 13 tokens with 80 % equal ones
#: holds one of these unharmed (counted over all patterns of substitutions).
MASKS = ((0, 1, 2, 4, 6), (0, 2, 3, 6, 7), (0, 1, 4, 5, 7), (1, 3, 4, 6, 7))
SPAN = 8
#: Items of fewer tokens than a mask spans are looked for as a whole, if they have so many characters.
SHORT_CHARS = 24
#: Seeds that are broadcast at most; words of the bitmap that stands before the shuffle of more.
MANY, WORDS = 1_000_000, 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(df: DataFrame, keys: list[str], masks: list[tuple[int, ...]], span: int) -> DataFrame:
    """(keys, pos, seed) of every position and mask; df has `words`."""
    hashed = df.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    spots = F.when(F.size("wh") >= span, F.sequence(F.lit(0), F.size("wh") - span)).otherwise(F.array().cast("array<int>"))
    at = lambda k, mask: lambda i: F.xxhash64(F.lit(k + 100 * (span < SPAN) * span), *(F.get("wh", i + o) for o in mask))
    seeds = [F.transform(spots, at(k, mask)) for k, mask in enumerate(masks)]
    # the seeds of all masks in one array of longs, so that one pass over the texts and one posexplode do
    all_ = hashed.select(*keys, F.size(spots).alias("n"), F.concat(*seeds).alias("seeds"))
    # the outer form, as the plain one makes Catalyst infer a filter that evaluates the arrays once more for every element
    return all_.select(*keys, "n", F.posexplode_outer("seeds").alias("k", "seed")).where("seed is not null").select(*keys, (F.col("k") % F.col("n")).alias("pos"), "seed")


def _hits(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """found with the items of its seeds. Many seeds are joined by shuffle, but only of what passes a bitmap of them (one hash, 64 bits a word), which is broadcast: at most a million words, 16 bytes each."""
    if seeds.limit(MANY + 1).count() <= MANY:
        return found.join(F.broadcast(seeds), "seed")
    slot = F.pmod(F.xxhash64("seed"), F.lit(64 * WORDS))
    word, bit = F.floor(slot / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")
    bitmap = C.materialize(seeds.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    passed = found.withColumns({"word": word, "bit": bit}).join(F.broadcast(bitmap), "word").where(F.col("bit").bitwiseAND(F.col("bits")) != 0)
    return passed.drop("word", "bit", "bits").join(seeds, "seed")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, percent: int = 80) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id, n_match and n_tokens (equal tokens and length of the best aligned window), doc_start (token of the document where the item's first token falls; may be negative).

    Texts are lower-cased runs of letters and digits. Every position of every text is hashed under each mask; equal
    hashes of a document and an item put both on one diagonal. Around it, every window of `window` tokens of the item
    (the whole item if shorter) is compared token by token, and `percent` of them must be equal, so substituted words
    do no harm. Items of fewer than 8 tokens must stand whole in a document, and match nothing if they have fewer than
    24 letters and digits, which chance may bring together. Null texts are empty; rows of one doc_id are one document;
    null ids match nothing; very long texts are rows like others; other columns don't matter.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    split = lambda df: df.select("doc_id", tokens(F.col("text")).alias("words"))
    letters = F.char_length(F.array_join("item", ""))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(item_text).cast("string")).alias("item")).where("item_id is not null")
    items = C.materialize(items.where((F.size("item") >= SPAN) | (letters >= SHORT_CHARS)).distinct())
    lengths = sorted(r.n for r in items.select(F.size("item").alias("n")).where(F.col("n") < SPAN).distinct().collect())
    hits = None
    for masks, span, these in [(MASKS, SPAN, F.size("item") >= SPAN), *(([tuple(range(n))], n, F.size("item") == n) for n in lengths)]:
        own = items.where(these).withColumnRenamed("item", "words")
        seeds = C.materialize(_seeds(own, ["item_id"], masks, span).select("seed", "item_id", F.col("pos").alias("at")).distinct())
        part = _hits(_seeds(split(texts), ["doc_id"], masks, span), seeds).select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("doc_start"))
        hits = part if hits is None else hits.union(part)
    hits = C.materialize(hits.distinct())
    near = split(texts.join(C.small(hits.select("doc_id").distinct()), "doc_id", "left_semi"))
    found = near.join(C.small(hits), "doc_id").join(C.small(items, size=F.octet_length(F.array_join("item", " ")) + 16 * F.size("item")), "item_id")
    return _verified(found, window, percent)


def _verified(found: DataFrame, window: int, percent: int) -> DataFrame:
    n = F.size("item")
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.get("item", i).eqNullSafe(F.get("words", i + F.col("doc_start"))), 1).otherwise(0))
    found = found.select("doc_id", "item_id", "doc_start", equal.alias("equal"), F.least(n, F.lit(window)).alias("n_tokens"))
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("n_tokens") + 1), lambda s: F.aggregate(F.slice("equal", s, F.col("n_tokens")), F.lit(0), lambda a, x: a + x))
    best = found.select("doc_id", "item_id", "doc_start", "n_tokens", F.array_max(sums).alias("n_match")).where(F.col("n_match") * 100 >= F.col("n_tokens") * percent)
    top = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_match", "n_tokens", -F.col("doc_start"))).alias("b"))
    return top.select("doc_id", "item_id", F.col("b.n_match").cast("long").alias("n_match"), F.col("b.n_tokens").cast("long").alias("n_tokens"), (-F.col("b.col3")).cast("long").alias("doc_start"))
