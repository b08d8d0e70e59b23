"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams for n = 1 to 4 (letters lower-cased, other ASCII as spaces), hashed to fixed widths.
The kernel of two texts is the weighted sum over n of the shared n-grams divided by the root of the product of the set
sizes. Landmarks are a few texts of each language; the Nyström map through the landmark kernel gives features on which
one-versus-rest ridge regression is fitted. Scoring is two matrix products for each batch: presence rows by landmark
presence (the kernel), then by the weights.

The fit uses at most about ``per_language`` labelled rows of each language (a documented bound, chosen by a hash of the
id); only their presence bits reach the driver. The model broadcast has a fixed size per landmark.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled rows everything is; rows
of equal id are judged one by one; a null id is not held out; very long texts are read whole, in a batch of their own. The
label column is read for the fit only; other columns pass through, but one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .sample import remainder, stratified
from .store import small_batches

PER_LANGUAGE, LANDMARKS = 500, 160
WIDTHS = {1: 8, 2: 12, 3: 13, 4: 13}  # n -> bits of the hash
BLEND = {1: 0.5, 2: 1.0, 3: 1.5, 4: 1.0}
_STARTS = dict(zip(WIDTHS, np.cumsum([0, *(1 << b for b in WIDTHS.values())]).tolist()))
DIM = sum(1 << b for b in WIDTHS.values())
_ROWS = 128
UNKNOWN = "und"
_PLAIN = K.LOWER.copy()
_PLAIN[[c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x DIM, 1 where the document has the n-gram."""
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs * DIM, np.uint8)
    b = _PLAIN[data].astype(np.uint32)
    row = np.repeat(np.arange(n_docs, dtype=np.int64) * DIM, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(b))  # bytes to the document's end
    v = b
    for n, bits in WIDTHS.items():
        if n > 1:
            v = v[:-1] << np.uint32(8) | b[n - 1 :]
        if not len(v):
            break
        h = v if n == 1 else (v * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        at = row[: len(v)] + h.astype(np.int64) + _STARTS[n]
        out[at[left[: len(v)] >= n]] = 1
    return out.reshape(n_docs, DIM)


def normalized(p: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that the dot product of two is the kernel."""
    out = p.astype(np.float32)
    for n, bits in WIDTHS.items():
        part = out[:, _STARTS[n] : _STARTS[n] + (1 << bits)]
        part *= np.sqrt(BLEND[n] / np.maximum(1, part.sum(axis=1, keepdims=True)))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for d in np.flatnonzero(~out):
        part = data[offsets[d] : offsets[d + 1]]
        if (part >= 128).any():
            out[d] = any(c.isalpha() for c in part.tobytes().decode())
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x DIM, normalized
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def decide(self, p: np.ndarray) -> np.ndarray:
        """documents x languages: decision values from presence rows."""
        return (normalized(p) @ self.landmarks.T) @ self.weights + self.bias


def fit(p: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 0.1, packed: bool = False) -> Model:
    """``p`` has presence rows, ``packed`` with eight to a byte; only ``_ROWS`` of them at a time are made floats, as this runs on the driver."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    each = max(1, landmarks // len(names))
    marks = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    rows = lambda at: normalized(np.unpackbits(p[at], axis=1) if packed else p[at])
    q = rows(marks)
    values, vectors = np.linalg.eigh((q @ q.T).astype(np.float64))
    keep = values > values[-1] * 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([rows(slice(at, at + _ROWS)) @ q.T for at in range(0, len(p), _ROWS)]).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.bincount(y, minlength=len(names))[y]  # every language weighs the same
    share /= share.mean()
    mean, target_mean = np.average(phi, axis=0, weights=share), np.average(target, axis=0, weights=share)
    a = (phi - mean) * share[:, None]
    w = np.linalg.solve(a.T @ (phi - mean) + ridge * np.eye(phi.shape[1]), a.T @ (target - target_mean))
    return Model(names, q, (root @ w).astype(np.float32), (target_mean - mean @ w).astype(np.float32))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batch, text):
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """A model from the rows for which ``learn`` holds and the label is not null; None if there are none."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), (learn if learn is not None else F.lit(True)).alias("learn"))
    chosen = stratified(rows.where("learn"), "lang", "id", per_language, "langid").select("id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "text"):
                data, offsets = K.text_bytes(b.column(2))
                ok = has_letter(data, offsets)
                bits = [x.tobytes() for x in np.packbits(presence(data, offsets), axis=1)[ok]]
                ids = b.column(0).cast(pa.string()).filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([ids, b.column(1).filter(pa.array(ok)), pa.array(bits, pa.binary())], names=["id", "lang", "bits"])

    got = sorted((r.lang, r.id, bytes(r.bits)) for r in chosen.mapInArrow(run, "id string, lang string, bits binary").collect())
    if not got:
        return None
    p = np.frombuffer(b"".join(g[2] for g in got), np.uint8).reshape(len(got), -1)
    return fit(p, [g[0] for g in got], landmarks, packed=True)


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None, sharpness: float = 4.0) -> DataFrame:
    """The columns ``keep`` (all but those named like a result, if None) with lang_pred and score, judged from the text alone.

    ``score`` is the softmax of the decision values at the chosen language.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = inner.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in _slices(whole, "_text"):
                data, offsets = K.text_bytes(b.column(b.num_columns - 1))
                names, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
                ok = np.flatnonzero(has_letter(data, offsets)) if m else np.zeros(0, np.int64)
                if len(ok):
                    z = m.decide(presence(data, offsets)[ok]).astype(np.float64)
                    best = z.argmax(axis=1)
                    names[ok] = np.array(m.languages, object)[best]
                    score[ok] = 1 / np.exp(sharpness * (z - z.max(axis=1, keepdims=True))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the language of every whole text of ``documents``, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    out = identify(docs, train(docs, learn=~held), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
