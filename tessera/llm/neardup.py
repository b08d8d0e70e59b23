"""MinHash near-duplicate detection with b-bit signatures.

1. One pass over the texts makes, for each document, its number of distinct shingles, a 128-bit fingerprint of the set,
   128 minima, their low 2 bits packed into four longs, and the hashes of 32 bands of 4 minima. Two documents of
   similarity 0.75 share no band with probability 5e-6.
2. Documents of equal fingerprint are a class; only its smallest id goes on. Groups of exact copies end here, in a
   grouped minimum that is combined before the shuffle.
3. Candidates: within a band bucket, every member against one (a star, not all pairs). The packed bits give a
   collision-corrected estimate by XOR and bit counts; pairs more than five standard deviations below the threshold are
   dropped, the others confirmed on their full shingle sets. A few bands come first; their links connect most copies.
4. Then, over all bands, only buckets whose members are still in different components: the members outside a bucket's largest
   component against that component's smallest id. What is still apart after that is joined by its sets, exactly: each set
   gives its rarest shingles as a prefix, so long that two sets of the threshold must share one of them; bounds on sizes and
   places drop pairs before they are made. Sets that only share a frequent template have no rare shingle in common, so a
   bucket of many such members makes no pairs. Every pair that shares a bucket is thus confirmed, ruled out, or already
   connected: no cap, no lost link.

Defined results: a document without words has no shingles and no links; one of fewer words than a shingle has one
shingle, its whole sequence. Rows of equal id are one document that holds all their texts. A null id is linked with
nothing, has a null component and is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel as K
from .components import components, join_groups
from .store import drop, free_shuffles, in_scratch, materialize, small_batches

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BITS = 32, 4, 2
_N = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(20240117))
_MUL = _rng.integers(0, 2**32, _N, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, _N, dtype=np.uint32)
_LANES = 0x5555555555555555
BLOCK, FIRST_BANDS = 512, 4
#: Ids that a broadcast may hold; beyond that many, the join shuffles.
BROADCAST_IDS = 4_000_000


def minima(hashes: np.ndarray, begins: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """documents x permutations; document i has the shingles from begins[i] up to the next."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), len(mul)), np.uint32)
    for j in range(len(mul)):
        out[:, j] = np.minimum.reduceat(x * mul[j] + add[j], begins)
    return out


def band_hashes(mins: np.ndarray) -> np.ndarray:
    acc = np.zeros((len(mins), BANDS), np.uint64) + K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        acc = K.mix(acc * np.uint64(0x9E3779B97F4A7C15) + mins[:, r::ROWS])
    return acc.view(np.int64)


def pack(mins: np.ndarray) -> np.ndarray:
    """The low 2 bits of each minimum, 32 to a long."""
    low = (mins & np.uint32(3)).astype(np.uint64).reshape(len(mins), -1, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def least_matches(percent: int, lanes: int = _N, sigmas: float = 5.0) -> int:
    """Matching 2-bit lanes that a pair at the threshold exceeds but for chance of ``sigmas`` standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 2**BITS  # equal minima, or unequal ones whose low bits collide
    return max(0, int(lanes * p - sigmas * (lanes * p * (1 - p)) ** 0.5))


def matches(a: str, b: str) -> Column:
    """Lanes in which two packed signatures agree."""
    lanes = []
    for i in range(_N // 32):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        lanes.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LANES))))
    return F.lit(_N) - sum(lanes[1:], lanes[0])


def _sets(b: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    return K.shingle_sets(K.Words(*K.text_bytes(b.column(1)), K.NONSPACE), shingle)


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, n, fa, fb, sig, bands) of each row; sig and bands are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                sets = _sets(b, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                fa, fb = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                sig, bands = [None] * len(n), [None] * len(n)
                if len(some):
                    flat = np.concatenate(sets)
                    begins = (np.cumsum(n) - n)[some]
                    fa[some] = np.add.reduceat(K.mix(flat), begins).view(np.int64)
                    fb[some] = K.mix(np.add.reduceat(K.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins) ^ n[some].astype(np.uint64)).view(np.int64)
                    mins = minima(flat, begins)
                    for i, s, h in zip(some.tolist(), pack(mins), band_hashes(mins)):
                        sig[i], bands[i] = s, h
                long = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(fa), pa.array(fb), pa.array(sig, long), pa.array(bands, long)], names=["id", "n", "fa", "fb", "sig", "bands"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, fa long, fb long, sig array<long>, bands array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in K.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in _sets(b, shingle)], pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, shingles array<long>")


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows with these ids."""
    need = materialize(ids, "neardup-needed")
    if need.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    return docs.join(need, "id", "left_semi").select("id", "text")


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. docs: (id, text)."""
    sets = full_sets(rows_of(docs, pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct()), shingle)
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb") - inter).alias("u")).where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b").distinct()


def link(classes: DataFrame, close: Callable[[str, str], Column], sets: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame], DataFrame] | None = None, percent: int = PERCENT, block: int = BLOCK, first_bands: int = FIRST_BANDS, sketched: bool = False) -> DataFrame:
    """(node, component) over classes (id, bands, sig) that share a band and are close.

    ``close`` judges two ``sig`` columns by name; ``confirm`` keeps the pairs (a, b) that a fuller look agrees to; ``sets``
    gives (id, sig, set) of a frame of ids. Three rounds, the later ones over buckets that those before left in several
    components: stars around the smallest id in the first bands; in all bands, stars around the bucket's largest component;
    an exact join of the sets by their prefixes. ``sketched`` says that ``sig`` is the set itself: that join then carries 128 bits of
    each set, which rule out only pairs that can't be close, and what is left is judged by ``close``.
    """
    sigs = classes.select("id", "sig")
    n_classes = classes.count()

    def linked_by(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        p = pairs.distinct().join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("gb")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("ga")), "a")
        return settled(p.where(close("ga", "gb")).select("a", "b"), before)

    def settled(pairs: DataFrame, before: DataFrame | None) -> DataFrame:
        pairs = materialize(pairs.distinct(), "link-pairs")
        pairs, raw = (confirm(pairs), pairs) if confirm else (pairs, None)
        if raw is not None:
            drop(raw)
        if before is None:
            return components(pairs, "a", "b")
        if pairs.isEmpty():
            return before
        # Components so far are nodes now, named by their smallest id, so that only what changes goes through the rounds.
        of = lambda end: before.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        roots = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b")
        moved = before.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        return materialize(moved.union(roots.join(before, "node", "left_anti").select("node", "component")), "link-linked")

    def labelled(members: DataFrame, linked: DataFrame) -> DataFrame:
        return members.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    def still_open(members: DataFrame, total: int) -> DataFrame:
        """Members (bucket, id, label) of buckets in several components."""
        several = members.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("n")).where("l0 < l1").select("bucket", "n")
        several = materialize(several, "link-several")
        return materialize(join_groups(members, several, "bucket", total), "link-open")

    # Most buckets have one member and link nothing: those rows go first, once for all rounds.
    buckets = classes.select(F.posexplode("bands").alias("band", "bucket"), "id")
    crowded = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("top"), F.count("*").alias("n")).where("a < top").select("bucket", "a", "n")
    crowded = materialize(crowded, "link-crowded")
    buckets = materialize(join_groups(buckets, crowded.select("bucket", "n"), "bucket", n_classes * BANDS), "link-buckets")
    free_shuffles(classes.sparkSession)
    first = buckets.where(F.col("band") < first_bands).select("bucket", "id")
    linked = linked_by(join_groups(first, crowded, "bucket", n_classes * first_bands).where("id > a").select("a", F.col("id").alias("b")), None)
    drop(crowded)

    named = materialize(labelled(buckets.select("bucket", "id"), linked), "link-labelled")
    drop(buckets)
    members = still_open(named, n_classes * BANDS)
    drop(named)
    total = members.count()
    groups = members.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.min("id").alias("a"))
    top = groups.groupBy("bucket").agg(F.max(F.struct("m", "a", "label")).alias("top"), F.sum("m").alias("n")).select("bucket", "top.a", F.col("top.label").alias("most"), "n")
    top = materialize(top, "link-top")
    linked = linked_by(join_groups(members, top, "bucket", total).where(F.col("label") != F.col("most")).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")), linked)

    free_shuffles(classes.sparkSession)
    named = materialize(labelled(members.select("bucket", "id"), linked), "link-labelled")
    drop(members)
    left = still_open(named, total)
    drop(named)
    apart = materialize(left.select("id", "label").distinct(), "link-apart")
    drop(left)
    if apart.isEmpty():
        return linked
    if not sketched:
        mine = materialize(sets(apart.select("id")).join(apart, "id"), "link-sets")
        return settled(prefix_pairs(mine, percent, block, close), linked)
    mine = sets(apart.select("id")).join(apart, "id").select("id", "label", F.array_distinct("set").alias("set"))
    mine = materialize(mine.withColumn("sig", sketch("set")), "link-sets")
    drop(apart)
    free_shuffles(classes.sparkSession)
    pairs = materialize(prefix_pairs(mine, percent, block, lambda a, b: may_reach(a, b, percent), cut=True), "link-candidates")
    free_shuffles(classes.sparkSession)
    both = pairs.join(mine.select(F.col("id").alias("b"), F.col("set").alias("gb")), "b").join(mine.select(F.col("id").alias("a"), F.col("set").alias("ga")), "a")
    return settled(both.where(close("ga", "gb")).select("a", "b"), linked)


def sketch(elements: str) -> Column:
    """128 bits of a set of hashes: the parity of the number of elements at each place. Two sketches differ in no more bits than the sets in elements."""

    def half(k: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        mine = lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1)) == k
        return F.aggregate(elements, F.lit(0).cast("long"), lambda s, x: F.when(mine(x), s.bitwiseXOR(bit(x))).otherwise(s))

    return F.array(half(0), half(1))


def may_reach(a: str, b: str, percent: int) -> Column:
    """Whether the sets (of ``na`` and ``nb`` elements) of two sketches can have the similarity."""
    apart = sum(F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in (0, 1))
    n = F.col("na") + F.col("nb")
    return apart <= n - 2 * n * percent / (100 + percent) + 1e-6


def prefix_pairs(sets: DataFrame, percent: int, block: int, close: Callable[[str, str], Column], cut: bool = False) -> DataFrame:
    """Pairs (a < b) of rows (id, label, sig, set) of different labels that are close, among them all whose sets have the similarity.

    A set of n elements has a partner only if the two share one of its n - ceil(n * percent / 100) + 1 rarest elements. A frequent
    element's rows are compared in blocks of about ``block`` by ``block``, so no task gets all of them. ``cut`` makes a table of the
    prefixes, so that the shuffle files that led to them can go before the join.
    """
    s = sets.where(F.size("set") > 0).select("id", "label", "sig", F.array_distinct("set").alias("set")).withColumn("n", F.size("set"))
    one = s.select("id", F.explode("set").alias("x"))
    seen = one.groupBy("x").agg(F.count("*").alias("f")).where("f > 1")
    seen = materialize(seen.select("x", "f", F.col("f").alias("n")), "link-shared")
    shared = join_groups(one, seen, "x", s.agg(F.sum("n")).first()[0] or 0)
    # Elements of one set only come first in its order: they take places of the prefix but have no partner.
    # Rows go to their set first: gathered where they are, nearly each would be a list of its own.
    ranked = shared.select("id", "f", "x").repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("common")).join(s.select("id", "label", "sig", "n"), "id")
    ranked = ranked.withColumn("alone", F.col("n") - F.size("common")).withColumn("keep", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")).where("keep > 0")
    # The optimizer also asks whether the prefix is empty, and may do so before it drops the sets that keep nothing: no length below 0.
    ranked = ranked.select("id", "label", "sig", "n", F.col("alone").alias("_alone"), F.slice("common", F.lit(1), F.greatest(F.col("keep"), F.lit(0)).cast("int")).alias("prefix"))
    if cut:
        ranked = materialize(ranked, "link-prefixes")
        drop(seen)
        free_shuffles(sets.sparkSession)
    rows = ranked.select("id", "label", "sig", "n", "_alone", F.posexplode("prefix").alias("p", "e"))
    rows = rows.select(F.col("e.x").alias("x"), F.ceil(F.col("e.f") / block).cast("int").alias("nb"), "id", "label", "sig", "n", (F.col("p") + F.col("_alone")).alias("at"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    a = rows.select("x", F.col("k").alias("i"), F.explode(F.sequence("k", F.col("nb") - 1)).alias("j"), F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("sig").alias("ga"))
    b = rows.select("x", F.explode(F.sequence(F.lit(0), "k")).alias("i"), F.col("k").alias("j"), F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("sig").alias("gb"))
    # The first shared element stands at these places of the two, so no more than what follows can be shared; they must share this many.
    can, must = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")), (F.col("na") + F.col("nb")) * percent / (100 + percent)
    fits = (F.col("la") != F.col("lb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & (can >= must - 1e-6)
    on = fits & ((F.col("l.i") < F.col("l.j")) | (F.col("a") < F.col("b"))) & close("ga", "gb")
    same = (F.col("l.x") == F.col("r.x")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    return a.alias("l").join(b.alias("r"), same & on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@in_scratch("neardup-result")
def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept. See the module."""
    small_batches(docs.sparkSession)
    least = least_matches(percent)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    sig = materialize(signatures(rows, "id", "text", shingle), "neardup-signatures")
    linkable = sig.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = materialize(linkable.groupBy("fa", "fb").agg(F.min(F.struct("id", "sig", "bands")).alias("m")).select("fa", "fb", "m.*"), "neardup-classes")
    sets = lambda ids: full_sets(rows_of(rows, ids), shingle).withColumnRenamed("shingles", "set").join(classes.select("id", "sig"), "id")
    linked = link(classes, lambda x, y: matches(x, y) >= least, sets, lambda pairs: materialize(confirm(pairs, rows, shingle, percent), "neardup-links"), percent, block)
    roots = classes.select("fa", "fb", "id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("fa", "fb", F.coalesce("component", "id").alias("root"))
    out = sig.select("id", "n", "fa", "fb").join(roots, ["fa", "fb"], "left")
    root = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("root")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("id") == root, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: near-duplicate components of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < 5 THEN array_to_string(t, ' ') ELSE array_to_string(list_slice(t, a, a + 4), ' ') END AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS a FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
