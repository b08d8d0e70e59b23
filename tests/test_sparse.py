"""Sparse BM25 vectors: made where the texts lie, with the same rows as by joining tokens."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as ix

from .test_bm25 import moved


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 9)) + " the end") for i in range(60)] + [(7, "twice told"), (7, "twice told"), (None, "lost"), (61, ""), (62, None), (63, "汉字 and more")]
    return spark.createDataFrame(rows, "id int, text string").repartition(3)


def shown(df):
    return sorted(map(repr, df.collect()))


def test_both_ways_give_the_same(spark, texts, monkeypatch):
    state = ix.state_of(texts.where("id < 40"))
    near = [shown(f(texts, *state)) for f in (ix.weights, ix.sparse_vectors)]
    monkeypatch.setattr(ix, "LOCAL_TOKENS", 0)
    assert near == [shown(f(texts, *state)) for f in (ix.weights, ix.sparse_vectors)] and len(near[0]) > 200
    assert any("idx=None" in r for r in near[0])  # tokens that the state has not seen


def test_tokens_stay_where_they_are(spark):
    many = spark.range(3000).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("w"), (F.col("id") * k % 50).cast("string"))), " ").alias("text")).repartition(3)  # else Spark knows that an id is in one task
    state = ix.state_of(many)
    rows = moved(spark, lambda: ix.sparse_vectors(many, *state).write.format("noop").mode("overwrite").save())
    assert sum(rows.values()) <= 3 * 3000 + 100 + 10 * spark.sparkContext.defaultParallelism
