import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

from .helpers import EDGE, SF, lower_az, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(lower_az(t or ""))


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            k = min(n, len(w))
            for a in range(len(w) - k + 1):
                wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (key := tuple(w[a : a + k])) in wins:
                    hit.update(range(a, a + k))
                    found |= wins[key]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [32 << 20, 700])
def test_edges(spark, block_bytes):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = EDGE + [(20, f"start {passage.upper()}, end"), (21, " ".join(passage.split()[3:13])), (22, " ".join(passage.split()[3:12])), (23, "One two one two")]
    items = [(1, passage), (2, passage), (2, passage), (3, "one"), (4, None), (5, ""), (None, passage), (6, "two one two"), (7, "日本語 text")]
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("clash"))
    got = D.decontaminate(table(spark, docs), it, block_bytes=block_bytes).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == brute(docs, items)


def test_blocks_and_dropping_agree(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    same = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], sorted(zip(r.spans[::2], r.spans[1::2]))) for r in df.collect())
    assert same(D.decontaminate(docs, items, block_bytes=40_000)) == same(D.decontaminate(docs, items))
    kept = lambda **o: sorted(r.doc_id for r in D.drop_contaminated(docs, items, **o).collect())
    assert kept(block_bytes=40_000) == kept() and 0 < len(kept()) < docs.count()


def test_empty_tables(spark):
    docs, items = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, items).count() == 0
    assert [r.n_hit for r in D.decontaminate(table(spark, [(1, "a b")]), items).collect()] == [0]


def test_query_against_brute_force(spark):
    got = D.query(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in brute(docs, items)]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert sum(r.contaminated for r in got)


def test_few_windows_are_few_files(spark, monkeypatch):
    files, write = {}, D.materialize

    def counted(df, label):
        out = write(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(D, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(50)]
        docs = [(1, items[7][1]), (2, "w1x1 w1x2 and no more")]
        it = spark.createDataFrame(items, "item_id long, text string")
        for block_bytes, most in ((32 << 20, 1), (60_000, 8)):
            got = D.decontaminate(table(spark, docs), it, block_bytes=block_bytes).collect()
            assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == brute(docs, items)
            assert 1 <= files["decontaminate-windows"] <= most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
