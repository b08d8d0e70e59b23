"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (an item of fewer words is one window). A document
contains a window only if it contains each of the window's word shingles, so for exact containment one shingle is a
sufficient prefix: the rarest one over the whole corpus. The join goes:

1. count, over all documents, the shingles that any window has (one pass, counts summed before the shuffle);
2. order the shingles of each window by that count and keep the rarest as its prefix; a count of 0 rules the window out;
3. join documents with prefixes on the shingle, apply the positional and length bounds (the window must fit between
   the document's ends around the matched position), and compare the words byte by byte.

Windows are broadcast in blocks of at most ``block_bytes``. A larger benchmark is worked off block by block: each reads the
documents again and writes only the hits (hashes of id and text, spans, items), so what is kept grows with the hits and not
with blocks times texts; at the end the hits go back to the rows. Texts are never shuffled.

Defined results: null or wordless texts have no words and no hits; rows with equal ids are judged one by one; items with
a null id or no words are ignored; items that repeat an id count once; very long texts are read whole, in a batch of their
own; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernel as K
from .store import drop, materialize, small_batches

WINDOW, SHINGLE, BLOCK_BYTES = 10, 5, 32 << 20


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item, phrase, n): the windows of each item as words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                w = K.Words(*K.text_bytes(b.column(1)))
                ids, first = b.column(0).to_pylist(), w.first.tolist()
                out: dict = {}
                for d, item in enumerate(ids):
                    lo, hi = first[d], first[d + 1]
                    if item is None or lo == hi:
                        continue
                    n = min(window, hi - lo)
                    for at in range(lo, hi - n + 1):
                        out[(item, w.phrase(at, at + n), n)] = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary()), pa.array([k[2] for k in out], pa.int32())], names=["item", "phrase", "n"]
                )

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, phrase binary, n int").distinct()


def phrase_shingles(phrases: list[bytes], shingle: int) -> list[tuple[int, np.ndarray]]:
    """(k, hashes of the k-word shingles in order) of each phrase; k is ``shingle`` or the phrase's words if fewer."""
    w = K.Words(*K.text_bytes(pa.array([p.decode("utf-8") for p in phrases], pa.string())))
    out, first, by_k = [], w.first.tolist(), {}
    for d in range(len(phrases)):
        n = first[d + 1] - first[d]
        k = min(shingle, n)
        if k not in by_k:
            by_k[k] = w.shingles(k)[0]
        out.append((k, by_k[k][first[d] : first[d] + n - k + 1]))
    return out


def _count_pass(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """Occurrences over all documents of the given shingles (k -> sorted hashes)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), np.int64) for k, v in shared.value.items()}
        for whole in batches:
            for b in K.slices(whole, "text"):
                w = K.Words(*K.text_bytes(b.column(0)))
                for k, known in shared.value.items():
                    h, ok = w.shingles(k)
                    h = h[ok]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    totals[k] += np.bincount(at[known[at] == h], minlength=len(known))
        for k, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(shared.value[k][some].view(np.int64)), pa.array(n[some])], names=["k", "h", "n"])

    rows = docs.select("text").mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return {(r.k, r.h): r.n for r in rows}


def _prefixes(windows: dict[bytes, list[str]], docs: DataFrame, shingle: int) -> dict[int, tuple[np.ndarray, dict]]:
    """k -> (sorted prefix hashes, hash -> [(offset, words, phrase)]): the rarest shingle of each window that can occur."""
    phrases = list(windows)
    shingles = phrase_shingles(phrases, shingle)
    keys: dict[int, set] = defaultdict(set)
    for k, h in shingles:
        keys[k].update(h.tolist())
    seen = _count_pass(docs, {k: np.array(sorted(v), np.uint64) for k, v in keys.items()})
    tables: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for phrase, (k, h) in zip(phrases, shingles):
        n, at = min((seen.get((k, x), 0), i) for i, x in enumerate(h.view(np.int64).tolist()))
        if n:
            tables[k][int(h[at])].append((at, k + len(h) - 1, phrase))
    return {k: (np.array(sorted(t), np.uint64), dict(t)) for k, t in tables.items()}


def find_hits(w: K.Words, tables: dict, windows: dict[bytes, list[str]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """document -> ([(first word, words)], items) for the windows that occur in it."""
    out: dict[int, tuple[list, set]] = {}
    doc_of = None
    for k, (known, table) in tables.items():
        h, ok = w.shingles(k)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        found = np.flatnonzero((known[at] == h) & ok)
        if not len(found):
            continue
        if doc_of is None:
            doc_of = w.doc_of_word()
        for p, d, key in zip(found.tolist(), doc_of[found].tolist(), h[found].tolist()):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            for offset, n, phrase in table[key]:
                start = p - offset
                if start < lo or start + n > hi or w.phrase(start, start + n) != phrase:
                    continue
                spans, items = out.setdefault(d, ([], set()))
                spans.append((start - lo, n))
                items.update(windows[phrase])
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids of the items of which a window occurs), spans.

    ``spans`` are the hit word ranges as [first word, words] pairs, flattened. See the module for method and edge cases.
    """
    small_batches(docs.sparkSession)
    size = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")) + 64)).first()[0] or 0
    # A word or more each window: a table of few windows is few files, however many partitions a shuffle has.
    wins = materialize(item_windows(items, item_id, item_text, window).coalesce(max(1, -(-size * window // block_bytes))), "decontaminate-windows")
    total = wins.agg(F.sum(F.length("phrase") + F.length("item") + 64)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    parts = []
    for block in range(n_blocks):
        windows: dict[bytes, list[str]] = defaultdict(list)
        for r in wins.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks)) == block).toLocalIterator():
            windows[bytes(r.phrase)].append(r.item)
        if n_blocks == 1:
            found = _hits(rows, _prefixes(windows, rows, shingle), dict(windows))
        else:
            hits = _hits(rows, _prefixes(windows, rows, shingle), dict(windows)).where("n_hit > 0").select(F.xxhash64("id").alias("_id"), F.col("version").alias("_version"), "spans", "items")
            parts.append(materialize(hits.distinct(), "decontaminate-block"))
    drop(wins)
    if n_blocks > 1:
        found = _together(_hits(rows, {}, {}), parts)
    return found.select(F.col("id").alias(doc_id), "n_words", "n_hit", "items", "spans")


OUT = "n_words long, n_hit long, spans array<int>, items array<string>, version long"


def _hits(rows: DataFrame, tables: dict, windows: dict) -> DataFrame:
    """(id, n_words, n_hit, spans, items, version) of each row, as far as these windows go."""
    shared = rows.sparkSession.sparkContext.broadcast((tables, windows))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(OUT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, windows = shared.value
        for whole in batches:
            for b in K.slices(whole, "text"):
                w = K.Words(*K.text_bytes(b.column(1)))
                hits = find_hits(w, tables, windows)
                n_hit = np.zeros(b.num_rows, np.int64)
                spans, items = [[]] * b.num_rows, [[]] * b.num_rows
                for d, (pairs, names) in hits.items():
                    pairs = sorted({*pairs})
                    n_hit[d] = covered(pairs, int(w.counts[d]))
                    spans[d], items[d] = [x for p in pairs for x in p], sorted(names)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts), pa.array(n_hit), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), b.column(2)], names=schema.names)

    return rows.select("id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, schema)


def covered(pairs: list[tuple[int, int]], n_words: int) -> int:
    """Words that lie in any of the ranges (first word, words)."""
    mark = np.zeros(n_words + 1, np.int32)
    lo, n = np.array(pairs).T
    np.add.at(mark, lo, 1)
    np.add.at(mark, lo + n, -1)
    return int((np.cumsum(mark) > 0).sum())


def _together(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The rows with the hits of all blocks, found again by 128 bits of hashes of id and text. Few hits are broadcast by the optimizer; else ids move, texts never."""
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    every = every.groupBy("_id", "_version").agg(F.flatten(F.collect_list("spans")).alias("flat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    pairs = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), (F.size("flat") / 2 - 1).cast("int")), lambda i: F.struct(F.get("flat", i * 2).alias("at"), F.get("flat", i * 2 + 1).alias("n")))))
    # Ranges in order: what a range adds is what lies beyond the furthest end before it.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    step = lambda s, p: F.struct(F.greatest(s["end"], p["at"] + p["n"]).alias("end"), (s["sum"] + F.greatest(p["at"] + p["n"] - F.greatest(s["end"], p["at"]), F.lit(0))).alias("sum"))
    one = every.withColumn("pairs", pairs).select("_id", "_version", "items", F.aggregate("pairs", start, step, lambda s: s["sum"]).alias("n_hit"), F.flatten(F.transform("pairs", lambda p: F.array(p["at"], p["n"]))).alias("spans"))
    base = rows.select("id", "version", "n_words")
    out = base.join(one, (F.xxhash64("id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), none("items", "array<string>"), none("spans", "array<int>"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, all columns kept, in which no window of an item occurs. Each row is judged by itself."""
    text = options.pop("text", "text")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return decontaminate(rows, items, doc_id="_row", text="_text", **options).where("n_hit = 0").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document of ``documents`` against every item of ``benchmark``."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
k AS (SELECT item, t, CASE WHEN len(t) < {WINDOW} THEN len(t) ELSE {WINDOW} END AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS t FROM benchmark WHERE item_id IS NOT NULL) WHERE len(t) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(t, a, a + n - 1), ' ') AS p FROM (SELECT item, t, n, unnest(range(1, len(t) - n + 2)) AS a FROM k)),
dw AS (SELECT doc_id, n, a, array_to_string(list_slice(t, a, a + n - 1), ' ') AS p FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS a FROM w, (SELECT DISTINCT n FROM win) WHERE len(t) >= n)),
hit AS (SELECT dw.doc_id, dw.a, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.p = win.p),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
