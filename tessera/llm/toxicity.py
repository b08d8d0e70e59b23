"""Toxicity by a convolutional text classifier, trained in numpy.

Words (letters and digits, A-Z lower-cased) get the sum of hashed embeddings: two of the whole word, so that a word which
shares one bucket with another still differs from it, and one for each of its beginnings of 3 to 8 bytes, so that unseen
words of a known stem have a meaning. Filters one, two and three words wide run over the whole text, each keeps its maximum, and a
logistic unit gives the score. All filters of a batch are one matrix product; maxima are taken by segments.

The fit uses at most about ``per_label`` labelled rows of each label (a documented bound, chosen by a hash of the id; rows
of more than ``most_bytes`` are not learnt from, and if the rest has more than ``fit_bytes`` in all, fewer rows are chosen, so
that the driver gets at most about 8 bytes for each of these bytes). A quarter of them only calibrates: first the score, by a logistic
curve weighted to the labels' real shares, then for each language the threshold of best F1, which ``flagged`` uses.

Defined results: null and wordless texts have empty maxima and hence a score too; without labelled rows every score is 0;
rows of equal id are scored one by one; a null id is not held out; a language unknown to the fit has the common threshold; very
long texts are scored whole, in a batch of their own; other columns pass through, but one named ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .sample import remainder, stratified
from .store import small_batches

PER_LABEL, MOST_BYTES, FIT_BYTES = 1500, 256 << 10, 16 << 20
BUCKET_BITS, SIZE, FILTERS, SPANS = 16, 16, 16, (1, 2, 3)
BEGINNINGS = (3, 4, 5, 6, 7, 8)
_PARTS = 2 + len(BEGINNINGS)
CUT = 0.7
_COLUMNS = FILTERS * sum(SPANS)


def codes(w: K.Words) -> np.ndarray:
    """words x 2: the hash of each word, and its first 8 bytes (zeros beyond its end) as a number."""
    n = len(w.starts)
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    head = np.zeros(n, np.uint64)
    for i in range(8):
        head |= np.where(w.lens > i, data[w.starts + i], 0).astype(np.uint64) << np.uint64(8 * i)
    return np.stack([w.hashes, head], axis=1)


def buckets(code: np.ndarray) -> np.ndarray:
    """words x _PARTS: rows of the embedding table whose sum is a word's embedding."""
    size = 1 << BUCKET_BITS
    h, head = code.view(np.uint64)[:, 0], code.view(np.uint64)[:, 1]
    out = np.empty((len(code), _PARTS), np.int64)
    out[:, 0] = h >> np.uint64(64 - BUCKET_BITS)
    out[:, 1] = (h & np.uint64(size - 1)) + np.uint64(size)
    for k, n in enumerate(BEGINNINGS):
        part = K.mix((head & np.uint64((1 << 8 * n) - 1)) * np.uint64(2 * n + 1))
        out[:, 2 + k] = (part >> np.uint64(64 - BUCKET_BITS)) + np.uint64(2 * size)
    return out


@dataclass
class Net:
    e: np.ndarray
    w: np.ndarray  # SIZE x _COLUMNS: for each span, and each place in it, FILTERS columns
    b: np.ndarray
    v: np.ndarray
    c: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(rng: np.random.Generator) -> "Net":
        f = lambda *s: rng.standard_normal(s).astype(np.float32)
        n = FILTERS * len(SPANS)
        return Net(f(3 << BUCKET_BITS, SIZE) * 0.05, f(SIZE, _COLUMNS) * 0.3, np.zeros(n, np.float32), f(n) * 0.3)

    def embed(self, code: np.ndarray) -> np.ndarray:
        rows = buckets(code)
        x = self.e[rows[:, 0]]
        for k in range(1, _PARTS):
            x += self.e[rows[:, k]]
        return x

    def pooled(self, hashes: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """documents x filters: maxima over each document (0 at least), and on demand the word at which each stands (-1: none)."""
        n_docs = len(first) - 1
        out = np.zeros((n_docs, len(self.b)), np.float32)
        where = np.full(out.shape, -1, np.int64) if places else None
        if not len(hashes):
            return out, where
        x = self.embed(hashes) @ self.w
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))  # words to the document's end
        col = 0
        for k, span in enumerate(SPANS):
            n = len(hashes) - span + 1
            if n < 1:
                break
            a = x[:n, col : col + FILTERS].copy()
            for p in range(1, span):
                a += x[p : p + n, col + p * FILTERS : col + (p + 1) * FILTERS]
            col += span * FILTERS
            a[left[:n] < span] = -np.inf
            some = np.flatnonzero((np.diff(first) >= span) & (first[:-1] < n))
            if len(some):
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                top = np.maximum.reduceat(a, first[:-1][some], axis=0)
                out[some, s] = np.maximum(0, top + self.b[s])
                if places:
                    for d in some:
                        where[d, s] = first[d] + a[first[d] : min(n, first[d + 1])].argmax(axis=0)
        return out, where

    def logit(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(hashes, first)[0] @ self.v + np.float32(self.c)

    def score(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.logit(hashes, first).astype(np.float64) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*texts, np.zeros((0, 2), np.uint64)]), np.cumsum([0, *map(len, texts)])


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.05, seed: int = 11) -> Net:
    """Adagrad on the log loss, both labels weighing the same. ``texts`` are codes of words."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    sums = {k: np.full(getattr(net, k).shape, 1e-3, np.float32) for k in ("e", "w", "b", "v")}
    sum_c = 1e-3

    def step(name: str, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        sums[name][at] += g * g
        getattr(net, name)[at] -= rate * g / np.sqrt(sums[name][at])

    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            h, first = _joined([texts[i] for i in pick])
            pool, where = net.pooled(h, first, places=True)
            dz = ((_sigmoid(pool @ net.v + net.c) - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dpool = dz[:, None] * net.v * (pool > 0)
            gv, gc = pool.T @ dz + 1e-4 * net.v, float(dz.sum())
            d, f = np.nonzero(dpool)
            g, gw = dpool[d, f], np.zeros_like(net.w)
            touched, grads = [], []
            starts = np.cumsum([0, *(s * FILTERS for s in SPANS)])
            for k, span in enumerate(SPANS):
                mine = f // FILTERS == k
                for p in range(span):
                    words = where[d[mine], f[mine]] + p
                    cols = starts[k] + p * FILTERS + f[mine] % FILTERS
                    np.add.at(gw.T, cols, g[mine, None] * net.embed(h[words]))
                    touched.append(buckets(h[words]))
                    grads.append(g[mine, None] * net.w.T[cols])
            gb = np.bincount(f, weights=g, minlength=len(net.b)).astype(np.float32)
            if grads:
                rows, back = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(rows), SIZE), np.float32)
                np.add.at(total, back.ravel(), np.repeat(np.concatenate(grads), _PARTS, axis=0))
                step("e", total, rows)
            step("w", gw + 1e-4 * net.w)
            step("b", gb)
            step("v", gv)
            sum_c += gc * gc
            net.c -= rate * gc / sum_c**0.5
    return net


def calibrate(net: Net, texts: list[np.ndarray], labels: np.ndarray, languages: list[str | None], share: float) -> None:
    """Fits score = sigmoid(slope * logit + shift) with label 1 weighing ``share``, then a threshold for each language."""
    z = np.concatenate([net.logit(*_joined(texts[i : i + 64])) for i in range(0, len(texts), 64)]).astype(np.float64)
    z = np.clip(z, -30, 30)
    w = np.where(labels == 1, share / max(1, (labels == 1).sum()), (1 - share) / max(1, (labels == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps with a weak prior on a slope of 1
        p = _sigmoid(a * z + b)
        r, q = w * (p - labels), w * p * (1 - p)
        g = np.array([r @ z + 1e-4 * (a - 1), r.sum() + 1e-4 * b])
        hess = np.array([[q @ (z * z) + 1e-4, q @ z], [q @ z, q.sum() + 1e-4]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -1, 1)
    net.slope, net.shift = float(max(a, 1e-3)), float(b)
    p = _sigmoid(net.slope * z + net.shift)
    for lang in sorted({x for x in languages if x is not None}):
        mine = np.array([x == lang for x in languages])
        if labels[mine].sum() >= 5:
            cuts = np.unique(np.append(p[mine], CUT))
            f1 = [2 * (w[mine] * labels[mine])[p[mine] >= c].sum() / max(1e-12, w[mine][p[mine] >= c].sum() + (w[mine] * labels[mine]).sum()) for c in cuts]
            net.thresholds[lang] = float(cuts[int(np.argmax(f1))])


def word_hashes(b: pa.RecordBatch, text: str) -> K.Words:
    return K.Words(*K.text_bytes(b.column(b.schema.get_field_index(text))))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", learn: Column | None = None, per_label: int = PER_LABEL, most_bytes: int = MOST_BYTES, fit_bytes: int = FIT_BYTES) -> Net | None:
    """A network from the labelled rows for which ``learn`` (on the labels' id) holds; None without both labels."""
    small_batches(docs.sparkSession)
    rated = labels.select(F.col(doc_id), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).where(learn if learn is not None else F.lit(True)).distinct()
    counts = {r.label: r["count"] for r in rated.groupBy("label").count().collect()}
    texts = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))

    def labelled(n: int) -> DataFrame:
        chosen = stratified(rated, "label", doc_id, n, "toxicity").select(F.col(doc_id).alias("id"), "label")
        rows = texts.join(F.broadcast(chosen), "id")
        return rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)

    rows = labelled(per_label)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > fit_bytes:
        rows = labelled(max(1, int(per_label * fit_bytes / total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                w = word_hashes(b, "text")
                c = codes(w)
                words = [c[lo:hi].tobytes() for lo, hi in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), b.column(3), pa.array(words, pa.binary())], names=["id", "lang", "label", "words"])

    got = sorted(((r.id, r.label, r.lang or "", bytes(r.words)) for r in rows.select("id", "lang", "text", "label").mapInArrow(run, "id string, lang string, label int, words binary").collect()))
    y = np.array([g[1] for g in got])
    if len(set(y.tolist())) < 2:
        return None
    texts = [np.frombuffer(g[3], np.uint64).reshape(-1, 2) for g in got]
    order = np.random.default_rng(5).permutation(len(got))
    held = order[: len(order) // 4]
    if len(set(y[order[len(held) :]].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = order
        net = fit(texts, y)
    else:
        rest = order[len(held) :]
        net = fit([texts[i] for i in rest], y[rest])
    calibrate(net, [texts[i] for i in held], y[held], [got[i][2] or None for i in held], counts[1] / (counts[0] + counts[1]))
    return net


def score(docs: DataFrame, net: Net | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but one named ``score``, if None) with ``score``, from the text alone."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"] if keep is None else keep
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = inner.drop("_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in K.slices(whole, "_text", K.SLICE_BYTES // 4):
                w = word_hashes(b, "_text")
                s = m.score(codes(w), w.first) if m else np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], names=schema.names)

    return inner.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the toxicity of every whole text of ``documents``; ``flagged`` uses the threshold of the row's language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~held)
    out = score(docs, net, keep=["doc_id", "lang"])
    cut = F.lit(CUT)
    for lang, at in (net.thresholds if net else {}).items():
        cut = F.when(F.col("lang") == lang, F.lit(at)).otherwise(cut)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
