"""Retrieval and answer metrics as grouped aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

K_VALUES = (1, 3, 5, 8)


def cases(hits: DataFrame, expected: DataFrame, ks: Sequence[int] = K_VALUES, *, qid: str = "qid", item: str = "document") -> DataFrame:
    """One row per case of ``expected`` (qid, category, documents): first rank, MRR, and hit and recall at each k.

    ``hits`` are (qid, rank, item). A case without expected documents has hit false and recall 0.
    """
    want = expected.select(qid, F.explode("documents").alias(item)).distinct()
    good = hits.join(want, [qid, item], "left_semi").groupBy(qid, item).agg(F.min("rank").alias("rank"))
    found = good.groupBy(qid).agg(F.min("rank").alias("first_rank"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"n_{k}") for k in ks])
    n = F.size(F.array_distinct("documents"))
    out = expected.join(found, qid, "left")
    per_k = [c for k in ks for c in (
        (F.coalesce(f"n_{k}", F.lit(0)) > 0).alias(f"doc_hit_{k}"),
        F.round(F.when(n > 0, F.coalesce(f"n_{k}", F.lit(0)) / n).otherwise(0.0), 6).alias(f"doc_recall_{k}"),
    )]
    return out.select(qid, "category", F.col("first_rank").cast("long").alias("first_rank"), F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"), *per_k)


def keyword_recall(hits: DataFrame, expected: DataFrame, ks: Sequence[int] = K_VALUES, *, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, keyword_recall_k...): the share of the case's keywords in the lower-cased text of the first k hits."""
    words = expected.select(qid, F.explode(F.array_distinct("keywords")).alias("w"))
    best = hits.join(words, qid).where(F.contains(F.lower(text), F.lower("w"))).groupBy(qid, "w").agg(F.min("rank").alias("rank"))
    found = best.groupBy(qid).agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"n_{k}") for k in ks])
    n = F.size(F.array_distinct("keywords"))
    return expected.join(found, qid, "left").select(qid, *[F.round(F.when(n > 0, F.coalesce(f"n_{k}", F.lit(0)) / n).otherwise(0.0), 6).alias(f"keyword_recall_{k}") for k in ks])


def chunk_hit(hits: DataFrame, expected: DataFrame, ks: Sequence[int] = K_VALUES, *, qid: str = "qid", item: str = "chunk_id") -> DataFrame:
    """Whether a labelled chunk is among the first k; null where no chunk is labelled, so that means leave the case out."""
    want = expected.select(qid, F.explode("chunks").alias(item))
    first = hits.join(want, [qid, item], "left_semi").groupBy(qid).agg(F.min("rank").alias("r"))
    labelled = F.size("chunks") > 0
    return expected.join(first, qid, "left").select(qid, *[F.when(labelled, F.coalesce(F.col("r") <= k, F.lit(False))).alias(f"chunk_hit_{k}") for k in ks])


def by_category(rows: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """Means over all cases (category ``overall``) and over each category, in one pass."""
    means = [F.round(F.avg("mrr"), 6).alias("mrr")]
    means += [F.round(F.avg(F.col(f"{m}_{k}").cast("double")), 6).alias(f"{m}_{k}") for k in ks for m in ("doc_hit", "doc_recall")]
    g = rows.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("cases"), *means)
    return g.select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("category")).alias("category"), *[c for c in g.columns if c not in ("category", "g")])


def summary(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, min, max, count, errors) of metric columns; null is an error."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")).select("s.*")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"), F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("errors"))


def relevant_count(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Hits that look relevant by score: reranked above .3, or any BM25; null scores do not count."""
    ok = F.coalesce(F.col("rerank_score") > 0.3, F.lit(False)) | F.coalesce(F.col("bm25_score") > 0, F.lit(False))
    return hits.groupBy(qid).agg(F.count_if(ok).alias("relevant"), F.count("*").alias("hits"))
