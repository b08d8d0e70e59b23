import zlib

import numpy as np

from tessera.llm import toxicity as X

from .helpers import EDGE, SF, table


def test_pooling_against_loops():
    rng = np.random.default_rng(1)
    net = X.Net.fresh(rng)
    net.b = rng.standard_normal(len(net.b)).astype(np.float32)
    texts = [rng.integers(0, 2**63, (n, 2)).astype(np.uint64) for n in (0, 1, 2, 3, 50, 1)]
    h, first = X._joined(texts)
    pool, where = net.pooled(h, first, places=True)
    for d, t in enumerate(texts):
        x = net.e[X.buckets(t)].sum(axis=1)
        col = 0
        for k, span in enumerate(X.SPANS):
            for f in range(X.FILTERS):
                vals = [sum(float(x[a + p] @ net.w[:, col + p * X.FILTERS + f]) for p in range(span)) for a in range(len(t) - span + 1)]
                n = k * X.FILTERS + f
                want = max(0, max(vals) + net.b[n]) if vals else 0
                assert abs(pool[d, n] - want) < 1e-4
                assert where[d, n] == (first[d] + int(np.argmax(vals)) if vals else -1)
            col += span * X.FILTERS


def test_edges(spark):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 12)] + [(None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    rows = EDGE + [(1, "bad"), (3, "bad bad"), (2, "fine"), (6, "fine")]
    net = X.train(table(spark, rows), labels)
    got = X.score(table(spark, rows), net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.shard == "x" for r in got)
    assert X.score(table(spark, []), net).count() == 0
    assert X.train(table(spark, rows), labels.limit(0)) is None
    assert {r.score for r in X.score(table(spark, rows), None).collect()} == {0.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in X.query(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    pos, neg = np.array([g.score for g, y in held if y]), np.array([g.score for g, y in held if not y])
    auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    hit, false = (pos >= 0.7).mean(), (neg >= 0.7).mean()
    print("auc", auc, "recall", hit, "false", false, len(pos), len(neg))
    assert auc > 0.95 and hit > 0.7 and false < 0.02
