"""A training-corpus pipeline over ``documents``: five stages, each a filter or an encoder of this library.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of ``documents``. A stage judges only what its predecessors kept.

Defined results: documents without a letter go in the first stage, and all do if it has no row to learn from; rows with a null id pass the near-duplicate and substring
stages untouched; repeated rows (equal id and text) leave one; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe_codec, decontaminate, langid, neardup, passages
from tessera.llm.sample import remainder
from tessera.llm.store import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; learnt from the documents at hand that are not held out.

    Only ``und`` is rejected, which a fitted model gives to texts without a letter: its choice of language and its score decide
    nothing here. Where no row can be learnt from there is no model, and every document goes.
    """
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs, learn=~held)
    judged = langid.identify(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text")), model, text="_text", keep=["_row"])
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    dropped = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    dropped = materialize(dropped, "pipeline-dropped")
    if dropped.count() <= neardup.BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    return _once(kept)


def _once(docs: DataFrame) -> DataFrame:
    """Repeated ids reduced to one row each (the smallest text); the texts are moved only if there are any."""
    again = materialize(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    n = again.count()
    if not n:
        return docs
    again = F.broadcast(again) if n <= neardup.BROADCAST_IDS else again
    rest = [c for c in docs.columns if c != "doc_id"]
    first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("r")).select("doc_id", "r.*")
    return docs.join(again, "doc_id", "left_anti").select(*docs.columns).union(first.select(*docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that a document of a smaller id keeps."""
    return passages.remove_passages(docs, length="n_chars")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe_codec.digests(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("encode", encode)]

#: Kernel classification, MinHash and BPE can't be expressed in SQL: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
