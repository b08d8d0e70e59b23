"""Substring deduplication by paragraph MinHash banding.

Natural paragraphs, for near copies: lines, and blocks of several lines between blank lines, of ``LENGTH`` words or more.
Windows, for exact copies wherever in its line the passage stands: ``LENGTH`` words that start where the content says so, at each word
position whose 5-word shingle hash is the least of ``SPREAD`` consecutive ones, and at both ends of the text. Two texts that
share ``LENGTH + SPREAD - 1`` (47) words in a row share a window.

1. Count the anchors (the shingles at which windows start) over all documents; a window whose anchor is in one
   document only has no exact copy. Only anchors and positions are shuffled.
2. The documents with repeated anchors make the windows there; natural paragraphs are made of all documents. Equal shingle
   sets are one class. Natural ones go on if their class is in two documents or shares a band with another class.
3. Each class has 8 bands of 4 minima: a pair of similarity 0.75 collides with probability 0.95, one of 0.85 with 0.998.
   Classes that share a band are joined, star first, and confirmed by exact Jaccard on the sets. Windows and natural
   paragraphs don't mix.
4. Components of the confirmed links are clusters. A cluster in two documents or more keeps the paragraphs of its smallest
   doc_id; in the others they are removed. Overlapping paragraphs of a document are merged into passages.

Defined results: texts of fewer than ``LENGTH`` words are left alone, as are rows with a null id or text; repeats within one
document only are no cluster; rows of equal id and text are one document; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernel as K
from .neardup import BROADCAST_IDS, link
from .store import drop, free_shuffles, in_scratch, materialize, small_batches

SHINGLE, PERCENT = 5, 75
LENGTH, SPREAD = 24, 24
BANDS, ROWS = 8, 4
_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_PLACE_BITS = 26
_BAND = [f"b{i}" for i in range(BANDS)]
#: Keeps the classes and bands of natural paragraphs apart from those of windows.
_NATURAL = np.uint64(0x6A09E667F3BCC909)


def anchors(w: K.Words, shingle: int = SHINGLE, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, shingle hashes) at which paragraphs start: the leftmost least of every ``spread`` positions, and a text's ends."""
    h, ok = w.shingles(shingle)
    n = len(h)
    if not n or n >= 1 << _PLACE_BITS:
        if n:
            raise ValueError("a text of more than 67 million words")
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, last = np.repeat(w.first[:-1], w.counts), np.repeat(w.first[1:], w.counts)
    place = np.arange(n)
    v = (h & ~np.uint64((1 << _PLACE_BITS) - 1)) | place.astype(np.uint64)
    v[~ok] = np.uint64(2**64 - 1)
    least, width = v, 1
    while width * 2 <= spread:
        least, width = np.minimum(least, _ahead(least, width)), width * 2
    least = np.minimum(least, _ahead(least, spread - width))
    # A window starts at each position from which ``spread`` shingles fit, and at the first of a shorter document.
    starts = (place + spread + shingle - 1 <= last) | ((place == first) & ok)
    ends = w.first[1:][w.counts >= length]
    at = np.concatenate([(least[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64), w.first[:-1][w.counts >= length], ends - length])
    at = np.unique(at)
    at = at[at + length <= last[at]]
    return at, h[at]


def _ahead(v: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return v
    out = np.full(len(v), 2**64 - 1, np.uint64)
    out[:-by] = v[by:]
    return out


def _words(b: pa.RecordBatch) -> tuple[K.Words, np.ndarray]:
    data, offsets = K.text_bytes(b.column(b.schema.get_field_index("text")))
    return K.Words(data, offsets), offsets


def _lists(doc: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """One list for each of n documents of the values, whose documents ``doc`` names in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def outlines(rows: DataFrame) -> DataFrame:
    """For each row (id, version, text): ``anchor`` and ``at`` (word position) of its windows; ``start`` and ``end`` (characters), ``key`` and
    band hashes ``b0`` to ``b7`` of its natural paragraphs, as lists side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                w, offsets = _words(b)
                at, h = anchors(w)
                doc = np.searchsorted(w.first, at, side="right") - 1
                cols = [b.column(0), b.column(1), _lists(doc, b.num_rows, h.view(np.int64)), _lists(doc, b.num_rows, (at - w.first[doc]).astype(np.int32))]
                at, count = natural(w)
                order = np.argsort(at, kind="stable")
                at, count = at[order], count[order]
                doc = np.searchsorted(w.first, at, side="right") - 1
                start = end = key = np.zeros(0, np.int64)
                bands = np.zeros((0, BANDS), np.int64)
                if len(at):
                    short, begins, key = natural_sets(w, at, count)
                    bands = _bands(lambda m, a, x=_halves(short), begins=begins: np.minimum.reduceat(x * m + a, begins), len(at), _NATURAL)
                    start, end = _characters(w, offsets, doc, at, count)
                cols += [_lists(doc, b.num_rows, x) for x in (start, end, key, *bands.T)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "version", "anchor", "at", "start", "end", "key", *_BAND])

    kind = rows.schema["id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<long>" for c in ("start", "end", "key", *_BAND))
    return rows.select("id", "version", "text").mapInArrow(run, f"id {kind}, version long, anchor array<long>, at array<int>, {lists}")


def _characters(w: K.Words, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets in their documents of the runs of ``count`` words at the positions ``at``."""
    chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    begin = chars[offsets[doc]]
    return chars[w.starts[at]] - begin, chars[w.ends[at + count - 1]] - begin


def _listed(outline: DataFrame, *names: str) -> DataFrame:
    """One row for each entry of the lists side by side, with its id and version."""
    return outline.select("id", "version", F.inline(F.arrays_zip(*names)))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, version, start, end, key, set) of the paragraphs at word positions ``places`` of rows (id, version, places, text).

    Offsets are in characters; ``key`` is that of the shingles with their multiplicities; ``set`` has them as 32-bit hashes, and is
    null where this batch has shown it before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                w, offsets = _words(b)
                places = b.column(2)
                doc = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
                at = places.flatten().to_numpy().astype(np.int64) + w.first[doc]
                h, _ = w.shingles(SHINGLE)
                sets = h[at[:, None] + np.arange(LENGTH - SHINGLE + 1)]
                key = K.mix(K.mix(sets).sum(axis=1, dtype=np.uint64)).view(np.int64)
                start, end = _characters(w, offsets, doc, at, LENGTH)
                new = np.zeros(len(key), bool)
                new[np.unique(key, return_index=True)[1]] = True
                short = (sets[new] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                ends = np.concatenate([[0], np.cumsum(new) * short.shape[1]]).astype(np.int32)
                shown = pa.ListArray.from_arrays(pa.array(ends), pa.array(short.ravel()), mask=pa.array(~new))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(start), pa.array(end), pa.array(key), shown], names=["id", "version", "start", "end", "key", "set"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "version", "places", "text").mapInArrow(run, f"id {kind}, version long, start long, end long, key long, set array<int>")


def natural(w: K.Words, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of lines, and of blocks of several lines between blank lines, of ``length`` words at least.

    A text without blank lines is no block: copies of whole texts are found by their lines.
    """
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, feed = w.doc_of_word(), w.data == 10
    line, feeds = np.cumsum(feed)[w.starts], np.flatnonzero(feed)
    solid = np.cumsum(K.NONSPACE[w.data])[feeds]
    blank = np.zeros(len(w.data), bool)
    blank[feeds[:-1][solid[1:] == solid[:-1]]] = True
    block = np.cumsum(blank)[w.starts]

    def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])]))
        return at, np.append(at[1:], n)

    (a, b), (c, d) = runs(line), runs(block)
    several = (line[c] != line[d - 1]) & ~((c == w.first[doc[c]]) & (d == w.first[doc[c] + 1]))
    at, to = np.concatenate([a, c[several]]), np.concatenate([b, d[several]])
    long = to - at >= length
    return at[long], (to - at)[long]


def natural_sets(w: K.Words, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles end to end as 32-bit hashes, where each paragraph's begin, keys of the shingles with their multiplicities)."""
    h, _ = w.shingles(SHINGLE)
    k = count - SHINGLE + 1
    begins = np.cumsum(k) - k
    short = h[np.arange(int(k.sum())) + np.repeat(at - begins, k)] >> np.uint64(32)
    return short, begins, K.mix(np.add.reduceat(K.mix(short ^ _NATURAL), begins)).view(np.int64)


def sets_of(rows: DataFrame) -> DataFrame:
    """(key, set) of the natural paragraphs named by ``keys`` in rows (keys, text), once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                w, _ = _words(b)
                at, count = natural(w)
                if not len(at):
                    continue
                short, begins, key = natural_sets(w, at, count)
                need = np.unique(b.column(0).flatten().to_numpy())
                named, where = np.unique(key, return_index=True)
                where = where[np.isin(named, need)]
                parts = np.split(short.astype(np.uint32).view(np.int32), begins[1:])
                yield pa.RecordBatch.from_arrays([pa.array(key[where]), pa.array([parts[i] for i in where.tolist()], pa.list_(pa.int32()))], names=["key", "set"])

    return rows.select("keys", "text").mapInArrow(run, "key long, set array<int>")


def _halves(hashes: np.ndarray) -> np.ndarray:
    return (K.mix(hashes) >> np.uint64(32)).astype(np.uint32)


def _bands(least: Callable[[np.uint32, np.uint32], np.ndarray], n: int, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
    """n x BANDS hashes, from a function that gives the least permuted value of each set for a multiplier and an addend."""
    bands = np.zeros((n, BANDS), np.uint64) + (np.arange(1, BANDS + 1, dtype=np.uint64) ^ salt)
    for k in range(BANDS):
        for m, a in zip(_MUL[k * ROWS : (k + 1) * ROWS], _ADD[k * ROWS : (k + 1) * ROWS]):
            bands[:, k] = K.mix(bands[:, k] * np.uint64(0x9E3779B97F4A7C15) ^ least(m, a).astype(np.uint64))
    return bands.view(np.int64)


def banded(classes: DataFrame) -> DataFrame:
    """The classes with the hashes of their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = b.column(3).flatten().to_numpy().view(np.uint32).astype(np.uint64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), np.uint64)
            sets = _halves(sets)
            bands = _bands(lambda m, a, sets=sets: (sets * m + a).min(axis=1) if len(sets) else np.zeros(0, np.uint32), len(sets))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, listed], names=["id", "lo", "hi", "sig", "bands"])

    kind = classes.schema["lo"].dataType.simpleString()
    return classes.select("id", "lo", "hi", "sig").mapInArrow(run, f"id long, lo {kind}, hi {kind}, sig array<int>, bands array<long>")


def close(a: str, b: str) -> Column:
    """Exact Jaccard of two sets reaches the threshold."""
    inter = F.size(F.array_intersect(a, b))
    size = lambda x: F.size(F.array_distinct(x))
    return inter * 100 >= (size(a) + size(b) - inter) * PERCENT


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.where(F.col(doc_id).isNotNull() & t.isNotNull()).select(F.col(doc_id).alias("id"), F.xxhash64(t).alias("version"), t.alias("text"))


def _places(outline: DataFrame) -> DataFrame:
    """(id, version, places) of the documents that have anchors which another document has too."""
    seen = _listed(outline, "anchor").groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    seen = materialize(seen, "passages-anchors")  # both sides of the join below are plain, so a frequent anchor is split over tasks
    places = materialize(_listed(outline, "anchor", "at").join(seen, "anchor", "left_semi").groupBy("id", "version").agg(F.collect_set("at").alias("places")), "passages-places")
    drop(seen)
    return places


def _natural_classes(rows: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The natural paragraphs of rows (id, version, text) that can be in a cluster, the classes (id, lo, hi, sig, bands) of these, and the
    tables that the classes read. ``outline`` is removed."""
    # Bands in columns of their own, since arrays would make the grouping sort its rows.
    classes = _listed(outline, "key", *_BAND).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), *[F.first(c).alias(c) for c in _BAND])
    classes = materialize(classes.select("key", "lo", "hi", F.array(*_BAND).alias("bands")), "passages-line-classes")
    free_shuffles(rows.sparkSession)
    buckets = classes.select(F.explode("bands").alias("bucket"), "key").repartition("bucket")  # one exchange for the groups and the join
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 < k1").select("bucket")
    near = buckets.join(shared, "bucket", "left_semi").select("key").distinct().withColumn("near", F.lit(True))
    able = materialize(classes.join(near, "key", "left").withColumn("near", F.coalesce("near", F.lit(False))).where("near or lo < hi"), "passages-line-able")
    drop(classes)
    free_shuffles(rows.sparkSession)
    lines = materialize(_listed(outline, "start", "end", "key").join(able.select("key", "near"), "key"), "passages-lines")
    drop(outline)
    # One document shows the set of each class; a class that shares no band needs none.
    shown = lines.where("near").groupBy("key").agg(F.min(F.struct("id", "version")).alias("d")).groupBy("d.id", "d.version").agg(F.collect_list("key").alias("keys"))
    shown = materialize(shown, "passages-line-shown")
    if shown.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(shown.select("id").distinct()), "id", "left_semi")
    sets = sets_of(rows.join(shown, ["id", "version"])).groupBy("key").agg(F.first("set").alias("sig"))
    one = able.where("not near").select(F.col("key").alias("id"), "lo", "hi", F.lit(None).cast("array<int>").alias("sig"), F.array().cast("array<bigint>").alias("bands"))
    return lines, one.unionByName(able.where("near").join(sets, "key").select(F.col("key").alias("id"), "lo", "hi", "sig", "bands")), [able, shown]


def repeated_paragraphs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, start, end, cluster, keeper): each paragraph of a cluster that lies in two documents or more; rows of equal
    id and text give theirs each."""
    small_batches(docs.sparkSession)
    rows = rows_all = _rows(docs, doc_id, text)
    outline = materialize(outlines(rows), "passages-outlines")
    places = _places(outline)
    free_shuffles(docs.sparkSession)
    if places.count() <= BROADCAST_IDS:  # else every text is shuffled to find the ones that have places
        rows = rows.join(F.broadcast(places.select("id").distinct()), "id", "left_semi")
    found = materialize(paragraphs(rows.join(places, ["id", "version"])), "passages-paragraphs")
    drop(places)
    free_shuffles(docs.sparkSession)
    classes = found.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("set", ignorenulls=True).alias("sig"))
    lines, line_classes, used = _natural_classes(rows_all, outline)
    classes = materialize(banded(classes.withColumnRenamed("key", "id")).unionByName(line_classes), "passages-classes")
    for table in used:
        drop(table)
    del used, line_classes, outline
    free_shuffles(docs.sparkSession)
    linked = link(classes.select("id", "bands", "sig"), close, lambda ids: classes.join(ids, "id").select("id", "sig", F.col("sig").alias("set")), percent=PERCENT, sketched=True)
    named = classes.select("id", "lo", "hi").join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    wide = named.groupBy("cluster").agg(F.min("lo").alias("keeper"), F.max("hi").alias("hi")).where("keeper < hi").select("cluster", "keeper")
    free_shuffles(docs.sparkSession)
    keys = materialize(named.select(F.col("id").alias("key"), "cluster").join(wide, "cluster"), "passages-keys")
    drop(classes)
    spans = found.select("id", "version", "start", "end", "key").union(lines.select("id", "version", "start", "end", "key"))
    return spans.join(keys, "key").select("id", "version", "start", "end", "cluster", "keeper")


@in_scratch("passages-result")
def found_passages(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return passages(repeated_paragraphs(docs, doc_id=doc_id, text=text))


def passages(paragraph_rows: DataFrame) -> DataFrame:
    """Overlapping paragraphs of a document merged: (id, version, start, end, removed, kept_in, clusters)."""
    p = paragraph_rows.withColumn("removed", F.col("id") != F.col("keeper"))
    w = Window.partitionBy("id", "version", "removed").orderBy("start", "end", "cluster")
    p = p.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-9)) + 3).cast("int"))
    p = p.withColumn("island", F.sum("new").over(w))
    return p.groupBy("id", "version", "removed", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("keeper").alias("kept_in"), F.min("cluster").alias("cluster")).drop("island")


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage that other documents share: id, start, end (characters), removed, kept_in (the doc_id that keeps it), cluster."""
    return found_passages(docs, doc_id, text).select(F.col("id").alias(doc_id), "start", "end", "removed", "kept_in", "cluster")


def remove_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """The documents without the passages that an earlier document keeps, all columns kept.

    A document of which no word is left goes; one that had none stays. ``length`` names a column of character counts to renew.
    """
    cut = found_passages(docs, doc_id, text).where("removed")
    cut = cut.groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut")).withColumnsRenamed({"id": "_id", "version": "_version"})
    t = F.col(text).cast("string")
    both = docs.join(cut, (F.col(doc_id) == F.col("_id")) & (F.xxhash64(t) == F.col("_version")), "left")
    step = F.aggregate(
        "_cut", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, c: F.struct(c["end"].alias("at"), F.concat(s["out"], F.array(F.substring(t, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int")))).alias("out")),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(t, (s["at"] + 1).cast("int"), F.length(t))),
    )
    left = both.withColumn("_left", F.when(F.col("_cut").isNull(), t).otherwise(step))
    gone = F.col("_cut").isNotNull() & ~F.col("_left").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    out = {c: F.col(c) for c in docs.columns} | {text: F.col("_left")} | ({length: F.length("_left").cast(docs.schema[length].dataType)} if length else {})
    return left.where(~gone).select(*[v.alias(k) for k, v in out.items()])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the passages of ``documents`` that other documents share."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
