"""Small tables for the edge cases that every operator must handle, and plain versions of shared rules."""

import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("n", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("lang_pred", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("label", T.StringType()), T.StructField("bucket", T.StringType()),
])


def table(spark, rows):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", "s", "p", "k", "l", "b") for i, t in rows], DOCS)


LONG = "word%d " * 3
EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "null id here and some more words to read"),
    (7, " ".join(f"w{i % 977}" for i in range(30000))), (8, "x" * 200000), (9, "Ünïcödé ☃ 日本語 text   <|endoftext|> <|startoftext|> it's we'll 123 4"),
    (10, "\n\n\n"), (11, "a\u0000b \u0085c\x1cd"),
]


def docs(spark, n=None):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower_az(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)
