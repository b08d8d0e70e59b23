"""Media columns: payloads kept as lossless WebP images, and features of the pixels that are read back.

``store`` turns each text into a payload (its UTF-8 bytes, zeros up to a positive multiple of 64) and writes it as an
image of 8-bit samples; ``read`` decodes stored images to pixel arrays and computes features. A payload's width is 64
pixels, doubled until the height fits the format; one larger than the format's 2**28 pixels becomes several images, one behind
the other. All work is row by row: no shuffle, and equal texts give equal images.

Defined results: null and empty texts have a payload of 64 zeros; rows of equal id are stored one by one; very long texts are
stored whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel as K
from .webp import decode_bytes, encode_bytes
from .store import small_batches

UNIT = 64


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): the stored form of each text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "_text"):
                data, offsets = K.text_bytes(b.column(1))
                sizes = np.diff(offsets)
                padded = np.maximum(UNIT, -(-sizes // UNIT) * UNIT)
                media = []
                for at, n, m in zip(offsets.tolist(), sizes.tolist(), padded.tolist()):
                    payload = np.zeros(m, np.uint8)
                    payload[:n] = data[at : at + n]
                    media.append(encode_bytes(payload, UNIT))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(padded), pa.array(media, pa.binary())], names=[doc_id, "n_bytes", "payload_bytes", "media"])

    return rows.mapInArrow(run, f"`{doc_id}` {rows.schema[doc_id].dataType.simpleString()}, n_bytes long, payload_bytes long, media binary")


def features(samples: np.ndarray) -> str:
    """Mean, standard deviation, entropy in bits, distinct values and steepness of the samples, as text."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    p = counts[counts > 0] / n
    mean = float(counts @ np.arange(256)) / n
    var = float(counts @ np.arange(256) ** 2) / n - mean * mean
    steep = int(np.abs(np.diff(samples.astype(np.int16))).sum()) / n
    return f"mean={mean:.3f};std={max(0.0, var) ** 0.5:.3f};entropy={max(0.0, -float(p @ np.log2(p))):.4f};distinct={len(p)};steep={steep:.3f}"


def read(media: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """What the pixels of each stored image say: the columns of ``store`` without the image, digests and features."""
    kind = media.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for m, n in zip(b.column(3), b.column(2).to_pylist()):
                stored = m.as_py()
                samples = decode_bytes(stored, n)
                payload = samples.tobytes()
                for column, v in zip(out, (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples))):
                    column.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(out, kinds))], names=[doc_id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    rows = media.select(doc_id, "n_bytes", "payload_bytes", "media")
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every whole text of ``documents`` stored as an image and read back."""
    return read(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
