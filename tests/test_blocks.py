"""Whole runs in blocks of questions: the same answers, and nothing of a block is left but its answers."""

from pyspark.sql import functions as F

from tessera.operators import chunk, enrich
from tessera.plans import pipelines as P
from tessera.plans.store import keeper, release, root, scratch


def tables(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    return {f.getPath().getName().rpartition("-")[0] for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}


def test_blocks_give_the_same_answers(spark):
    release(spark)
    docs = spark.createDataFrame([(f"d{i}_0123456789ab", f"# Part {i}\nThe rule for thing{i} is number{i}.\n\n# Rest\nThere are {i} days of leave.") for i in range(6)], "document_id string, text string")
    keep = keeper(spark)
    chunks = keep(enrich.enrich(chunk.chunks(docs)), "chunks")
    index = keep(P.to_index(chunks, P.Settings()), "index")
    asked = spark.range(5).select(F.col("id").alias("qid"), F.concat(F.lit("What is the rule for thing"), F.col("id").cast("string"), F.lit("?")).alias("question"))
    once = sorted(map(tuple, P.ask(index, chunks, asked, keep=keep, messages=False).collect()))
    parts = sorted(map(tuple, P.ask(index, chunks, asked, keep=keep, messages=False, block=3).collect()))
    assert once == parts and [r[0] for r in once] == list(range(5)) and all(f"thing{r[0]}" in r[3] + r[1] and r[4] for r in once)
    assert tables(spark) == {"chunks", "index", "understood", "answered"}


def test_scratch_keeps_what_is_asked(spark):
    release(spark)
    with scratch(spark) as keep:
        inner = keeper(spark)(spark.range(3), "inner")
        kept = keep(inner.selectExpr("id + 1 AS id"), "kept")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3] and tables(spark) == {"kept"}
