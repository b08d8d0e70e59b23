"""Files to Markdown by a pluggable parser, with a content-addressed cache: a table keyed by digest and parameters, not by name."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .readers import files, result_dir

PARSED = "cache_key string, markdown string, parameters string"


class DocumentParser(Protocol):
    parameters: str  # everything but the file that a result depends on

    def parse(self, name: str, content: bytes) -> str: ...


class TextParser:
    """Plain text and Markdown as they are; pages by their tags, without a service."""

    parameters = json.dumps({"parser": "text", "version": 1})

    def parse(self, name: str, content: bytes) -> str:
        text = content.decode("utf-8-sig", errors="replace")
        if not re.search(r"(?i)<(html|body|p|h[1-6]|div)\b", text):
            return text
        text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "", text)
        text = re.sub(r"(?i)<h([1-6])[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", text)
        text = re.sub(r"(?i)</?(p|br|div|h[1-6]|ul|ol|li|tr|table)[^>]*>", "\n", text)
        return html.unescape(re.sub(r"<[^>]+>", "", text)).strip()


def cache_key(content: Column | str, parameters: str) -> Column:
    content = F.col(content) if isinstance(content, str) else content
    return F.sha2(F.concat_ws("|", F.sha2(content, 256), F.lit(parameters)), 256)


def parse_files(inputs: DataFrame, parser: DocumentParser, cache: DataFrame | None = None, *, force: bool = False, reparse: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, new cache rows) of inputs (name, content).

    documents: (name, document_dir, cache_key, markdown, restored). An input whose key the cache has is restored from it, unless
    ``force`` holds or ``reparse`` (cache_key), the answer to whether known ones should be parsed again, names it. Equal
    contents are parsed once. The new rows belong into the cache; write them before using the documents, which read them.
    """
    spark = inputs.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], PARSED)
    known = cache.where(F.lit(not force)).select("cache_key", "markdown")
    if reparse is not None:
        known = known.join(reparse.select("cache_key"), "cache_key", "left_anti")
    keyed = inputs.select("name", "content", cache_key("content", parser.parameters).alias("cache_key"))
    w = Window.partitionBy("cache_key").orderBy("name")
    todo = keyed.join(known.select("cache_key"), "cache_key", "left_anti").withColumn("n", F.row_number().over(w)).where("n = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, name, content in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([parser.parse(name, content)]), pa.array([parser.parameters])], names=["cache_key", "markdown", "parameters"])

    fresh = todo.select("cache_key", "name", "content").mapInArrow(run, PARSED)
    have = fresh.select("cache_key", "markdown", F.lit(False).alias("restored")).union(known.dropDuplicates(["cache_key"]).select("cache_key", "markdown", F.lit(True)))
    named = keyed.select("name", result_dir(F.col("name"), F.col("content")).alias("document_dir"), "cache_key")
    return named.join(have, "cache_key").select("name", "document_dir", "cache_key", "markdown", "restored"), fresh


def parse_dir(spark: SparkSession, path: str, parser: DocumentParser, cache_path: str, suffix: str = ".pdf", **options) -> DataFrame:
    """Documents of the files of a directory; the cache is a table at ``cache_path`` that grows. No file at all is an error."""
    found = files(spark, path, suffix)
    if found.isEmpty():
        raise FileNotFoundError(f"no {suffix} file in {path}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    cache = spark.read.schema(PARSED).parquet(cache_path) if exists else spark.createDataFrame([], PARSED)
    _, fresh = parse_files(found.select("name", "content"), parser, cache, **options)
    fresh.write.mode("append").parquet(cache_path)
    return parse_files(found.select("name", "content"), parser, spark.read.schema(PARSED).parquet(cache_path))[0]
