"""Index maintenance by anti-joins and rewrites, and BM25 statistics that grow and shrink with the corpus."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import meta_value, tokenize
from ..plans.store import keeper
from .retrieve import B, K1, checked_broadcast

MODES = {"chunk": "chunk", "chunk_sync": "chunk", "strict": "strict", "incremental": "incremental", "force": "force"}


def sync_mode(name: str | None) -> str:
    key = (name or "chunk").strip().lower()
    if key not in MODES:
        raise ValueError(f"unknown sync mode: {name}")
    return MODES[key]


def first_of(records: DataFrame, item: str) -> DataFrame:
    """One record of each id: of several, the one that sorts first by its columns as text."""
    rest = [c for c in records.columns if c != item]
    order = [F.to_json(F.struct(*rest)) if rest else F.lit(0)]
    w = Window.partitionBy(item).orderBy(*order)
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sync(index: DataFrame, records: DataFrame, mode: str = "chunk", *, item: str = "id", document: str = "document_id") -> DataFrame:
    """The index after the records came in, with a column ``change``: kept, inserted or replaced. Rows deleted are gone.

    chunk: ids that a document no longer has go, new ones come. incremental: only new ids come. strict and force: the
    documents' rows are all replaced. Documents without records are never touched.
    """
    mode = sync_mode(mode)
    records = first_of(records, item)
    cols = index.columns
    documents = records.select(document).distinct()
    untouched = index.join(documents, document, "left_anti").select(*cols, F.lit("kept").alias("change"))
    if mode in ("strict", "force"):
        old = index.join(documents, document, "left_semi").select(item).distinct().withColumn("_old", F.lit(True))
        new = records.join(old, item, "left")
        return untouched.union(new.select(*cols, F.when(F.col("_old"), "replaced").otherwise("inserted").alias("change")))
    touched = index.join(documents, document, "left_semi")
    kept = touched if mode == "incremental" else touched.join(records.select(item), item, "left_semi")
    new = records.join(index.select(item), item, "left_anti")
    return untouched.union(kept.select(*cols, F.lit("kept").alias("change"))).union(new.select(*cols, F.lit("inserted").alias("change")))


#: The metadata that an index keeps of a chunk, by the column that holds it.
METADATA = (
    "chunk_id", "chunk_type", "document_id", "document_name", "source_file", "source_path", "chunk_file", "retrieval_role", "semantic_unit_type", "title_path",
    "line_range", "parent_context", "neighbor_chunk_ids", "related_ref_chunk_ids", "small_to_big_context_ids", "content_hash", "chunk_strategy", "chunk_schema_version",
)
STRATEGY, SCHEMA_VERSION = "markdown_hybrid", "1"


def metadata(chunks: DataFrame, chunk_file: Column | None = None) -> DataFrame:
    """The chunks' metadata: the columns of ``METADATA``, each a scalar or JSON text; columns that the chunks lack are empty."""
    given = {"chunk_id": "id", "chunk_type": "type", "semantic_unit_type": "type"}
    constant = {"chunk_strategy": F.lit(STRATEGY), "chunk_schema_version": F.lit(SCHEMA_VERSION), "chunk_file": chunk_file if chunk_file is not None else F.lit("")}
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def one(name: str) -> Column:
        column = given.get(name, name)
        return meta_value(column, kinds[column]) if column in kinds else constant.get(name, F.lit(""))

    return chunks.select(*[one(n).alias(n) for n in METADATA])


def open_index(spark: SparkSession, root: str, schema, name: str = "document_chunks") -> DataFrame:
    """The latest version of a named index below ``root``; one without rows where none was written yet."""
    p, fs = _fs(spark, f"{root.rstrip('/')}/{name}")
    versions = sorted((s.getPath().toString() for s in (fs.listStatus(p) if fs.exists(p) else [])), reverse=True)
    done = next((v for v in versions if fs.exists(_fs(spark, f"{v}/_SUCCESS")[0])), None)
    return spark.read.schema(schema).parquet(done) if done else spark.createDataFrame([], schema)


def write_index(index: DataFrame, root: str, name: str = "document_chunks") -> str:
    """Writes the next version of a named index and gives its path; readers of the version before are not disturbed. No rows are an error."""
    path = f"{root.rstrip('/')}/{name}/{time.time_ns():020d}"
    index.write.parquet(path)
    if index.sparkSession.read.schema(index.schema).parquet(path).isEmpty():
        p, fs = _fs(index.sparkSession, path)
        fs.delete(p, True)
        raise ValueError(f"{name}: nothing to index")
    return path


def ids_by_document(records: DataFrame, item: str = "id", document: str = "document_id") -> DataFrame:
    """(document, ids): the sorted distinct ids of each document's records."""
    return records.groupBy(document).agg(F.array_sort(F.collect_set(item)).alias("ids"))


def add_directory(state: DataFrame, corpus: DataFrame, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """The state with the texts of all chunk files below ``path``: objects or arrays of them, with ``content``, ``text`` or ``document``.

    Files that are no JSON and chunks without text are passed over.
    """
    spark = state.sparkSession
    read = spark.read.schema("content string, text string, document string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    rows = read.json(path).select(F.coalesce(*[F.nullif(c, F.lit("")) for c in ("content", "text", "document")]).alias("text")).where("text is not null")
    return state_add(state, corpus, rows)


def existing(index: DataFrame, records: DataFrame, item: str = "id") -> DataFrame:
    return records.select(item).distinct().join(index, item, "left_semi")


def prune(index: DataFrame, local: DataFrame, document: str = "document_id") -> DataFrame:
    """The index without documents that are no longer there."""
    return index.join(local.select(document).distinct(), document, "left_semi")


def delete(index: DataFrame, *, ids: list | None = None, names: list | None = None, document: str = "document_id", name: str = "document_name") -> DataFrame:
    """The index without documents of these ids or names; a null id or name is never named."""
    gone = F.lit(False)
    if ids:
        gone = gone | F.coalesce(F.col(document).isin(ids), F.lit(False))
    if names:
        gone = gone | F.coalesce(F.col(name).isin(names), F.lit(False))
    return index.where(~gone)


def new_inputs(inputs: DataFrame, parsed: DataFrame, content: str = "content", key: str = "cache_key", parameters: Column | None = None) -> DataFrame:
    """Inputs whose digest (and parameters) no parsed row has, with that key: the parse cache as an anti-join."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    k = digest if parameters is None else F.sha2(F.concat_ws("|", digest, parameters), 256)
    return inputs.withColumn(key, k).join(parsed.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- BM25 state


def texts_stats(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(token, df) and one row (docs, len) of a batch of texts; texts without tokens count as documents.

    One pass: each text also counts for the empty token, whose row has the number and length of all texts.
    """
    t = texts.select(tokenize(text).alias("t")).select(F.size("t").cast("long").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("token"))
    counts = keeper(texts.sparkSession)(t.groupBy("token").agg(F.count("*").alias("df"), F.sum("len").alias("len")), "token-counts")
    corpus = counts.where("token = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("len"))
    return counts.where("token <> ''").select("token", "df"), corpus


def state_of(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(token, idx, df) and (docs, len): a fresh state; indexes follow the tokens' order."""
    df, corpus = texts_stats(texts, text)
    return numbered(df.withColumn("idx", F.lit(None).cast("long")), 0), corpus


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """Tokens without an index get the next ones in token order.

    They are range-partitioned and written as a table with their partition and place in it; prefix sums of the partitions' few
    counts do the rest, so there is no sort in one task and a lost executor can't change a partition.
    """
    spark = rows.sparkSession
    fresh = rows.where("idx is null").select("token", "df")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = fresh.repartitionByRange(parts, "token").withColumn("p", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("p").orderBy("token")).cast("long")
    sliced = keeper(spark)(sliced.withColumn("place", place), "numbered")
    base, at = [], after
    for p, n in sorted((r.p, r["count"]) for r in sliced.groupBy("p").count().collect()):
        base, at = [*base, (p, at - 1)], at + n
    starts = F.broadcast(spark.createDataFrame(base, "p int, start long"))
    new = sliced.join(starts, "p").select("token", (F.col("start") + F.col("place")).alias("idx"), "df")
    return rows.where("idx is not null").select("token", "idx", "df").union(new)


def state_add(state: DataFrame, corpus: DataFrame, texts: DataFrame, text: str = "text", sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """The state with texts added (sign 1) or taken away (-1): counts never fall below 0; a token with df 0 keeps its index."""
    df, extra = texts_stats(texts, text)
    both = state.select("token", "idx", "df").union(df.select("token", F.lit(None).cast("long"), F.col("df") * sign))
    merged = both.groupBy("token").agg(F.max("idx").alias("idx"), F.greatest(F.sum("df"), F.lit(0)).alias("df"))
    merged = merged.where("idx is not null or df > 0")
    top = state.agg(F.max("idx")).first()[0]
    total = corpus.union(extra.select((F.col("docs") * sign).alias("docs"), (F.col("len") * sign).alias("len")))
    sums = total.agg(F.greatest(F.sum("docs"), F.lit(0)).alias("docs"), F.greatest(F.sum("len"), F.lit(0)).alias("len"))
    return numbered(merged, 0 if top is None else top + 1), sums


STATE_VERSION = 1


def save_state(state: DataFrame, corpus: DataFrame, path: str) -> None:
    """Writes the state as a new snapshot below ``path``; a marker file, made last, makes it the current one.

    A run that dies on the way leaves the snapshot before it in place.
    """
    spark = state.sparkSession
    name = f"{path.rstrip('/')}/{time.time_ns():020d}"
    state.select("token", "idx", "df").write.parquet(f"{name}/tokens")
    corpus.select(F.lit(STATE_VERSION).alias("version"), "docs", "len").coalesce(1).write.parquet(f"{name}/corpus")
    p, fs = _fs(spark, f"{name}/_CURRENT")
    fs.create(p).close()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The latest whole snapshot; an empty state where there is none of this version."""
    p, fs = _fs(spark, path)
    names = sorted((s.getPath().toString() for s in (fs.listStatus(p) if fs.exists(p) else [])), reverse=True)
    for name in names:
        if fs.exists(_fs(spark, f"{name}/_CURRENT")[0]):
            corpus = spark.read.parquet(f"{name}/corpus")
            if corpus.where(F.col("version") == STATE_VERSION).isEmpty():
                break
            return spark.read.parquet(f"{name}/tokens"), corpus.select("docs", "len")
    return spark.createDataFrame([], "token string, idx long, df long"), spark.createDataFrame([(0, 0)], "docs long, len long")


def reset_state(spark: SparkSession, path: str) -> None:
    """The current state becomes an empty one; a damaged one goes as well."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)
    save_state(spark.createDataFrame([], "token string, idx long, df long"), spark.createDataFrame([(0, 0)], "docs long, len long"), path)


def state_stats(state: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: version, docs, len, average length (1 if empty), vocabulary size and tokens that some document has."""
    sizes = state.agg(F.count("*").alias("vocabulary"), F.count_if(F.col("df") > 0).alias("seen"))
    avg = F.round(F.when(F.col("docs") > 0, F.col("len") / F.col("docs")).otherwise(F.lit(1.0)), 2)
    return corpus.select(F.lit(STATE_VERSION).alias("version"), "docs", "len", avg.alias("avg_len")).crossJoin(sizes)


def idf(df: Column, docs: float) -> Column:
    """Unseen tokens have df 0 and the largest weight."""
    return F.when(df > 0, F.log(1 + (F.lit(docs) - df + 0.5) / (df + 0.5))).otherwise(F.log(F.lit(docs + 1)))


#: A state of more tokens than this is not sent to the workers; texts then meet it by a shuffle of their tokens.
LOCAL_TOKENS = 2_000_000


def vectors(texts: DataFrame, state: DataFrame, corpus: DataFrame, item: str = "id", text: str = "text") -> DataFrame:
    """(item, entries): of each text, an array of (token, idx, weight) with weights above 0, by idx; tokens without an index first.

    The state goes to the texts, which are counted and weighed where they lie. No item may be repeated.
    """
    docs, length = corpus.first()
    avg = float(length) / max(int(docs), 1) or 1.0
    t = texts.select(item, tokenize(text).alias("t")).select(item, "t", F.size("t").alias("len"))
    kind = t.schema[item].dataType.simpleString()
    known = state.select("token", "idx", "df").toArrow()
    names, idx, df = (known.column(c).combine_chunks() for c in range(3))
    # A last entry for tokens that the state doesn't have.
    df, idx = np.append(df.to_numpy(), 0), np.append(idx.to_numpy(), -1)
    seen = np.where(df > 0, np.log(1 + (docs - df + 0.5) / (df + 0.5)), np.log(docs + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            coded = b.column(1).flatten().dictionary_encode()
            words = coded.dictionary
            keys, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(words) + coded.indices.to_numpy(), return_counts=True)
            row, word = np.divmod(keys, max(len(words), 1))
            at = pc.fill_null(pc.index_in(words, value_set=names), len(names)).to_numpy()[word]
            order = np.lexsort((idx[at], row))
            row, word, at, tf = row[order], word[order], at[order], tf[order]
            weight = seen[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * b.column(2).to_numpy()[row] / avg))
            entries = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(idx[at], mask=idx[at] < 0), pa.array(weight)], ["token", "idx", "weight"])
            ends = pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, entries)], names=[item, "entries"])

    out = t.mapInArrow(run, f"`{item}` {kind}, entries array<struct<token:string,idx:bigint,weight:double>>")
    rounded = F.transform("entries", lambda e: F.struct(e["token"].alias("token"), e["idx"].alias("idx"), F.round(e["weight"], 6).alias("weight")))
    return out.select(item, F.filter(rounded, lambda e: e["weight"] > 0).alias("entries"))


def _apart(texts: DataFrame, state: DataFrame, item: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Texts that can be weighed where they lie, and those to be gathered first: all of a large state, or those that repeat an item."""
    if state.limit(LOCAL_TOKENS + 1).count() > LOCAL_TOKENS:
        return None, texts
    again = keeper(texts.sparkSession)(texts.groupBy(item).count().where("count > 1").select(F.col(item).alias("_again")), "again")
    if again.isEmpty():
        return texts, None
    same, again = texts[item].eqNullSafe(F.col("_again")), checked_broadcast(again)
    return texts.join(again, same, "left_anti"), texts.join(again, same, "left_semi")


def _either(near: DataFrame | None, far: DataFrame | None) -> DataFrame:
    return far if near is None else near if far is None else near.union(far)


def weights(texts: DataFrame, state: DataFrame, corpus: DataFrame, item: str = "id", text: str = "text") -> DataFrame:
    """(item, token, idx, weight): the sparse BM25 vector of each text as rows, weights above 0."""
    near, far = _apart(texts, state, item)
    near = near and vectors(near, state, corpus, item, text).select(item, F.explode("entries").alias("e")).select(item, "e.*")
    return _either(near, far and gathered(far, state, corpus, item, text))


def gathered(texts: DataFrame, state: DataFrame, corpus: DataFrame, item: str = "id", text: str = "text") -> DataFrame:
    """What ``weights`` gives, by a shuffle of all tokens."""
    docs, length = corpus.first()
    avg = float(length) / max(int(docs), 1) or 1.0
    t = texts.select(item, tokenize(text).alias("t"))
    rows = t.select(item, F.size("t").alias("len"), F.explode("t").alias("token")).groupBy(item, "token").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    w = idf(F.coalesce("df", F.lit(0)), float(docs)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(avg)))
    return rows.join(state, "token", "left").select(item, "token", "idx", F.round(w, 6).alias("weight")).where("weight > 0")


def sparse_vectors(texts: DataFrame, state: DataFrame, corpus: DataFrame, item: str = "id", text: str = "text") -> DataFrame:
    """(item, vector): index -> weight; tokens without an index have none."""
    near, far = _apart(texts, state, item)
    pairs = F.transform(F.filter("entries", lambda e: e["idx"].isNotNull()), lambda e: F.struct(e["idx"].alias("idx"), e["weight"].alias("weight")))
    near = near and vectors(near, state, corpus, item, text).select(item, pairs.alias("pairs")).where(F.size("pairs") > 0)
    far = far and gathered(far, state, corpus, item, text).where("idx is not null").groupBy(item).agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("pairs"))
    return _either(near, far).select(item, F.map_from_entries("pairs").alias("vector"))


def rescore(hits: DataFrame, questions: DataFrame, state: DataFrame, corpus: DataFrame, *, qid: str = "qid", item: str = "id", text: str = "text") -> DataFrame:
    """(qid, item, state_score): hits (qid, item, text) by BM25 of their text alone under the persistent statistics; 0 if nothing is shared."""
    q = questions.select(qid, F.explode(tokenize("question")).alias("token")).groupBy(qid, "token").agg(F.count("*").alias("qtf"))
    asked = state.join(checked_broadcast(q.select("token").distinct()), "token", "left_semi")
    w = weights(hits.select(item, text).dropDuplicates([item]), asked, corpus, item, text)
    pairs = hits.select(qid, item).distinct().join(checked_broadcast(q), qid).join(w, [item, "token"])
    s = pairs.groupBy(qid, item).agg(F.sum(F.col("qtf").cast("decimal(9,0)") * F.col("weight").cast("decimal(20,6)")).cast("double").alias("s"))
    return hits.select(qid, item).distinct().join(s, [qid, item], "left").select(qid, item, F.coalesce("s", F.lit(0.0)).alias("state_score"))
