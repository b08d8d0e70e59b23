"""Quality by ordinal cumulative-link regression on hashed text.

A text's features are the roots of the shares of its byte 1- to 3-grams and of its repeated neighbour words, hashed to DIM
columns. One weight vector is shared by all grades; grade k or more has probability sigmoid(w.x - theta_k) with ordered
thresholds theta. The sum of these tail probabilities is the expected grade; a tail probability selects.

The fit uses at most about ``per_grade`` rated rows of each grade (a documented bound, chosen by a hash of the id), weighted
to the grades' real shares; only their features reach the driver, a few kilobytes each.

Defined results: null and empty texts have no features and hence the prior's grades; without ratings of two grades every
expected grade and tail is null and nothing is selected out; rows of equal id are graded one by one; very long texts are read
whole, in a batch of their own; other columns pass through, but one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import kernel as K
from .sample import remainder, stratified
from .store import small_batches

PER_GRADE, BITS = 800, 13
DIM = 1 << BITS
_ROWS = 256
TAIL = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x DIM: roots of shares, each row of length 1 but for hash collisions."""
    n_docs = len(offsets) - 1
    sizes = np.diff(offsets)
    counts = np.zeros(n_docs * DIM)
    b = data.astype(np.uint32)
    row = np.repeat(np.arange(n_docs, dtype=np.int64) * DIM, sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(b))
    v = b
    for n in (1, 2, 3):
        if n > 1:
            v = v[:-1] << np.uint32(8) | b[n - 1 :]
        if not len(v):
            break
        h = ((v * np.uint32(2 * n + 1)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        counts += np.bincount((row[: len(v)] + h)[left[: len(v)] >= n], minlength=n_docs * DIM)
    out = counts.reshape(n_docs, DIM)
    w = K.Words(data, offsets, K.NONSPACE)
    if len(w.hashes) > 1:
        doc = w.doc_of_word()
        same = np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1]))
        again = np.bincount(doc[same], minlength=n_docs)
        out[:, DIM - 1] += again * 8
    out /= np.maximum(1, out.sum(axis=1, keepdims=True))
    return np.sqrt(out).astype(np.float32)


@dataclass
class Ordinal:
    weights: np.ndarray
    thetas: np.ndarray  # of grades 1, 2, ...

    def tails(self, x: np.ndarray) -> np.ndarray:
        """documents x (grades - 1): probability of grade k or more."""
        z = (x @ self.weights)[:, None] - self.thetas
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, grades: np.ndarray, share: np.ndarray | None = None, rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> Ordinal:
    """Adam on the likelihood of grades 0 to n - 1; ``share`` are the grades' real shares."""
    n = int(grades.max()) + 1
    have = np.bincount(grades, minlength=n) / len(grades)
    weight = (share / np.maximum(have, 1e-9))[grades] if share is not None else np.ones(len(grades))
    weight = weight / weight.sum()
    tail = np.array([(weight * (grades >= k)).sum() for k in range(1, n)])
    start = -np.log(np.clip(tail, 1e-4, 1 - 1e-4) / np.clip(1 - tail, 1e-4, 1))
    scale = np.sqrt(DIM) / 16
    x = x * np.float32(scale)
    w, t0, gaps = np.zeros(x.shape[1]), start[0], np.log(np.maximum(np.diff(start), 1e-3))
    params = np.concatenate([w, [t0], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for r in range(1, rounds + 1):
        w, gaps = params[: x.shape[1]], np.exp(params[x.shape[1] + 1 :])
        theta = params[x.shape[1]] + np.concatenate([[0], np.cumsum(gaps)])
        p = sig((x @ w.astype(np.float32))[:, None] - theta)
        upper = np.hstack([np.ones((len(x), 1)), p])  # P(grade >= k), k = 0..n-1
        lower = np.hstack([p, np.zeros((len(x), 1))])
        i = np.arange(len(x))
        a, b = upper[i, grades], lower[i, grades]
        prob = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a) / prob, b * (1 - b) / prob  # derivatives of log prob
        g_theta = np.zeros((len(x), n - 1))
        up, low = grades > 0, grades < n - 1
        g_theta[i[up], grades[up] - 1] += da[up]
        g_theta[i[low], grades[low]] -= db[low]
        g_theta *= weight[:, None]
        g_z = -weight * (np.where(up, da, 0) - np.where(low, db, 0))
        each = g_theta.sum(axis=0)
        later = np.cumsum(each[::-1])[::-1]
        g = np.concatenate([x.T @ g_z.astype(np.float32) + ridge * w, [later[0]], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-9)
    theta = params[x.shape[1]] + np.concatenate([[0], np.cumsum(np.exp(params[x.shape[1] + 1 :]))])
    return Ordinal((params[: x.shape[1]] * scale).astype(np.float32), theta)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batch, text):
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def train(docs: DataFrame, ratings: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", learn: Column | None = None, per_grade: int = PER_GRADE) -> Ordinal | None:
    """A model from (doc_id, grade) with grades 0, 1, ...; None with fewer than two grades. ``learn`` judges the ratings' id."""
    small_batches(docs.sparkSession)
    rated = ratings.select(F.col(doc_id), F.col(grade).cast("int").alias("grade")).where(F.col("grade") >= 0).where(learn if learn is not None else F.lit(True)).distinct()
    counts = {r.grade: r["count"] for r in rated.groupBy("grade").count().collect()}
    chosen = stratified(rated, "grade", doc_id, per_grade, "quality").select(F.col(doc_id).alias("id"), "grade")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "text"):
                x = features(*K.text_bytes(b.column(1)))
                at = [np.flatnonzero(r) for r in x]
                packed = [i.astype(np.uint16).tobytes() + r[i].astype(np.float16).tobytes() for i, r in zip(at, x)]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(packed, pa.binary())], names=["id", "grade", "x"])

    got = sorted((r.id, r.grade, bytes(r.x)) for r in rows.select("id", "text", "grade").mapInArrow(run, "id string, grade int, x binary").collect())
    y = np.array([g[1] for g in got], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = np.zeros((len(got), DIM), np.float32)
    for row, (_, _, p) in zip(x, got):
        n = len(p) // 4
        row[np.frombuffer(p, np.uint16, n)] = np.frombuffer(p, np.float16, n, 2 * n)
    total = sum(counts.values())
    return fit(x, y, np.array([counts.get(k, 0) / total for k in range(int(y.max()) + 1)]))


def grade(docs: DataFrame, model: Ordinal | None, *, text: str = "text", keep: list[str] | None = None, tail: float = TAIL) -> DataFrame:
    """The columns ``keep`` (all but those named like a result, if None) with expected_grade, tails (P of grade 1 or more, 2 or more, ...) and kept.

    ``kept``: the probability of grade 1 or more reaches ``tail``.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("expected_grade", "tails", "kept")] if keep is None else keep
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = inner.drop("_text").schema.add("expected_grade", "double").add("tails", T.ArrayType(T.DoubleType())).add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in _slices(whole, "_text"):
                none = [None] * b.num_rows
                p = m.tails(features(*K.text_bytes(b.column(b.num_columns - 1)))) if m else None
                got = (p.sum(axis=1), list(p), p[:, 0] >= tail) if m else (none, none, [True] * b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got[0], pa.float64()), pa.array(got[1], pa.list_(pa.float64())), pa.array(got[2], pa.bool_())], names=schema.names)

    return inner.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "expected_grade", "tails", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents`` graded: 0 poor, 1 sound but toxic, 2 sound; a quarter of the ratings is held out."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", (F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("grade"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = grade(docs, train(docs, ratings, learn=~held), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "expected_grade", F.get("tails", F.lit(0)).alias("p_sound"), F.get("tails", F.lit(1)).alias("p_best"), "kept")
