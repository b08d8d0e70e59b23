"""Sharding by bytes: contiguous, balanced shards from global prefix sums.

Rows are put into one total order (the id, then checksum and size), range-partitioned and sorted; only the id, size and
checksum travel. Each partition reports its total bytes and rows; prefix sums of those few totals give every partition
its global start, so each row's global byte interval is known without a global sort in one task. A row belongs to the
shard in which the middle of its interval falls, with targets at equal fractions of all bytes: shard sizes differ from
the target by less than the largest row.

Defined results: a null text has size ``overhead`` and checksum 0; a null id sorts first; rows equal in id, checksum and
size are interchangeable, and lie in one range partition, in 24 bytes each; an empty table gives no rows. With fewer rows than shards some
shards are empty. Only the size and checksum of a very long text are moved; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import checkpoint

SHARDS, OVERHEAD = 24, 8


def shard_by_bytes(docs: DataFrame, *, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row per input row: id, size, text_crc32, global byte ``start``, shard, slot (position in the shard, from 0)."""
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    rows = docs.select(
        F.col(doc_id).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0).cast("long")).alias("crc"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("size")]
    ranged = checkpoint(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = n = 0
        for b in batches:
            size, n = size + int(np.sum(b.column(0).to_numpy())), n + b.num_rows
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "size": [size], "n": [n]})

    per_part = sorted(ranged.select("size").mapInArrow(totals, "part long, size long, n long").collect())
    total = max(1, sum(r["size"] for r in per_part))
    before: dict[int, tuple[int, int]] = {}
    size = n = 0
    for r in per_part:
        before[r.part] = (size, n)
        size, n = size + r["size"], n + r.n

    fields = {f.name: f for f in ranged.schema.fields}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, row = before.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            sizes = b.column(1).to_numpy().astype(np.int64)
            ends = start + np.cumsum(sizes)
            begins = ends - sizes
            shard = cut(begins, sizes, total, n_shards)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(begins), pa.array(shard.astype(np.int32)), pa.array(row + np.arange(b.num_rows))], names=["id", "size", "crc", "start", "shard", "row"])
            start, row = (int(ends[-1]) if len(ends) else start), row + b.num_rows

    placed = ranged.mapInArrow(place, f"id {fields['id'].dataType.simpleString()}, size long, crc long, start long, shard int, row long")
    firsts = {r.shard: r.row for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    first = F.element_at(F.create_map(*[F.lit(x) for k, v in firsts.items() for x in (k, v)]), F.col("shard")) if firsts else F.lit(0).cast("long")
    return placed.select(F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), "start", "shard", (F.col("row") - first).cast("long").alias("slot"))


def cut(begins: np.ndarray, sizes: np.ndarray, total: int, n_shards: int) -> np.ndarray:
    """Shard of each byte interval: where its middle falls among equal targets, in exact integers."""
    twice = 2 * begins + sizes
    if 2 * total * n_shards < 2**63:
        return np.minimum(twice * n_shards // (2 * total), n_shards - 1)
    return np.array([min(n_shards - 1, x * n_shards // (2 * total)) for x in twice.tolist()])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` into shards 0 to 23 by the law ``bytes``."""
    s = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
