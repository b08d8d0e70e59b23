"""BM25 against its formula, and what it moves: only the best documents of each question and task."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieve as R


def moved(spark, run):
    """Rows that are written for shuffles while ``run`` runs, by stage."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seq = store.stageList(None, False, False, none, None)
        return {seq.apply(i).stageId(): seq.apply(i).shuffleWriteRecords() for i in range(seq.size())}

    before = stages()
    run()
    return {k: v for k, v in stages().items() if k not in before and v}


def plain(docs, questions, k):
    """(qid, id, score, rank) by the formula over rows (id, tokens): rows of one id are one document, but each counts for the mean length."""
    full = [(i, t) for i, t in docs if t]
    n, mean = len(full), sum(len(t) for _, t in full) / max(len(full), 1)
    tf, size = {}, {}
    for i, t in full:
        tf.setdefault(i, Counter()).update(t)
        for w in t:
            size[i, w] = max(size.get((i, w), 0), len(t))
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, asked in questions:
        scores = []
        for i, c in tf.items():
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[i, w] / mean)) for w, m in Counter(asked).items() if w in c)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), i is not None, i, q))
        out += [(q, i, -s, n + 1) for n, (s, _, i, q) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] if x[1] else 0))[:k])]
    return out


@pytest.mark.parametrize("block", [16_384, 3])
@pytest.mark.parametrize("named", [False, True])
def test_against_the_formula(spark, block, named):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    some = lambda n: [words[min(int(rnd.expovariate(0.15)), 39)] for _ in range(rnd.randrange(n))]
    docs = [(i, some(30)) for i in range(300)] + [(i, ["w0", "w1"]) for i in (900, 800, 700)]
    docs += [(5, docs[5][1]), (6, [*docs[6][1], "w0", "w1"]), (None, ["w0", "w39", "w39"]), (None, ["w0", "w39", "w39"]), (-4, None)]
    if named:
        docs = [(i if i is None else f"é{i}", t) for i, t in docs]
    questions = [(q, some(9) + ["nowhere"]) for q in range(20)] + [(20, [])]
    corpus = spark.createDataFrame(docs, f"id {'string' if named else 'int'}, tokens array<string>").repartition(3)
    asked = spark.createDataFrame(questions, "qid long, tokens array<string>")
    got = sorted((tuple(r) for r in R.bm25_top(corpus, asked, 7, block=block).select("qid", "id", "bm25_score", "rank").collect()), key=lambda r: (r[0], r[3]))
    want = plain([(i, t or []) for i, t in docs], questions, 7)
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want] and len(got) > 100
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_empty(spark):
    corpus = spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a"])], "qid long, tokens array<string>")
    assert R.bm25_top(corpus, asked, 3).count() == 1
    assert R.bm25_top(corpus.limit(0), asked, 3).count() == R.bm25_top(corpus, asked.limit(0), 3).count() == 0


def test_only_the_best_are_moved(spark):
    """A word that all have pairs all questions with all documents; none of these pairs is shuffled."""
    docs = spark.range(4000).select("id", F.array(F.lit("common"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("tokens"))
    asked = spark.range(50).select(F.col("id").alias("qid"), F.array(F.lit("common"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("tokens"))
    rows = moved(spark, lambda: R.bm25_top(docs, asked, 5).count())
    assert rows and max(rows.values()) <= 50 * 5 * spark.sparkContext.defaultParallelism + 4100
