"""From raw documents to tokens: toxic texts go, one of each group of near copies stays, repeated passages and texts that leak benchmarks go, the rest is encoded.

Null texts count as empty and stay, as nothing speaks against them. Rows of a null doc_id belong to no document: no stage
drops them by id, but repeats of earlier documents are cut from them. Repeated rows of one doc_id are one document: all
of them stay or go. Texts of any length are whole rows. An empty table comes back empty. Extra columns of documents, with
whatever names, come along unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import ship
from gleanery.llm import bpe, cdc, decontam, minhash, toxicity
from gleanery.llm.common import delete, materialize, small
from gleanery.llm.common import shared_dir as _shared_dir
from gleanery.llm.queries import tokenizer_path


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those ids."""
    return docs.join(small(materialize(ids.select("doc_id").distinct())), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.toxicity(docs, model).where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; the smallest doc_id of each group stays."""
    return _without(docs, minhash.near_duplicates(docs, words=5, percent=80).where("not kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the text; a text of which nothing but white space is left goes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = cdc.chunk_dedup(docs, carry=others or ("doc_id",))
    text = F.col("kept").cast("string")
    columns = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"rest.{c}") for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length(text)).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    gone = (F.col("n_removed") > 0) & (F.trim(F.translate(text, "\t\n\r\f\x0b", "     ")) == "")
    return out.where(~gone).select(*(columns[c].alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, tokenizer_path(), digests=True)


def _shipping(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipping(f)) for name, f in (("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("benchmark_decontamination", drop_leaks), ("bpe", encode))]

#: Compression distances, signatures and merges are not SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), _shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
