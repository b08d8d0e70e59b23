import re

import numpy as np

from tessera.llm import quality as Q

from .helpers import EDGE, SF, lower_az, table


def test_ordinal_fit_finds_order_and_shares():
    rng = np.random.default_rng(3)
    x = (rng.random((3000, Q.DIM)) < 0.01).astype(np.float32) / 9
    w = np.zeros(Q.DIM)
    x[:, :40] = (rng.random((3000, 40)) < 0.4) / 9
    w[:40] = rng.standard_normal(40) * 20
    z = x @ w + rng.logistic(size=3000)
    cuts = np.quantile(z, [0.3, 0.6, 0.9])
    y = np.searchsorted(cuts, z)
    m = Q.fit(x, y, np.bincount(y) / len(y))
    assert len(m.thetas) == 3 and (np.diff(m.thetas) > 0).all()
    p = m.tails(x)
    assert (np.diff(p, axis=1) <= 0).all() and abs(p.mean(axis=0) - [0.7, 0.4, 0.1]).max() < 0.03
    assert np.corrcoef(p.sum(axis=1), x @ w)[0, 1] > 0.9


def plain_features(text):
    """Features of one text by loops over its bytes and words."""
    data, out = text.encode(), [0.0] * Q.DIM
    for n in (1, 2, 3):
        for at in range(len(data) - n + 1):
            v = int.from_bytes(data[at : at + n], "big")
            out[(((v * (2 * n + 1)) % 2**32) * 0x9E3779B1 % 2**32) >> (32 - Q.BITS)] += 1
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_az(text))
    out[Q.DIM - 1] += 8 * sum(a == b for a, b in zip(words, words[1:]))
    total = max(1, sum(out))
    return np.sqrt(np.array(out) / total)


def test_features_against_loops():
    texts = ["", "a", "the the THE cat cat", "Ünï ☃ ☃\t☃ x", "na " * 50, "\x00\n b"] + [t for _, t in EDGE if t and len(t) < 100]
    raw = [t.encode() for t in texts]
    got = Q.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, x in zip(texts, got):
        assert np.abs(x - plain_features(t)).max() < 1e-6, t


def test_first_step_follows_the_gradient_by_differences():
    """Adam's first step moves each parameter by ``rate`` against the sign of its gradient, which differences give."""
    rng = np.random.default_rng(8)
    x = np.zeros((60, Q.DIM), np.float32)
    x[:, :6] = rng.random((60, 6)) / 5
    y = rng.integers(0, 3, 60)
    rate = 1e-4
    start, step = Q.fit(x, y, rounds=0, ridge=0), Q.fit(x, y, rounds=1, rate=rate, ridge=0)

    def like(w, thetas):
        m = Q.Ordinal(w, thetas)
        p = np.hstack([np.ones((60, 1)), m.tails(x.astype(np.float64)), np.zeros((60, 1))])
        return np.log((p[:, :-1] - p[:, 1:])[np.arange(60), y]).mean()

    w0, t0 = start.weights.astype(np.float64), start.thetas
    for k in range(6):
        e = np.zeros(Q.DIM)
        e[k] = 1e-4
        slope = (like(w0 + e, t0) - like(w0 - e, t0)) / 2e-4
        if abs(slope) > 1e-5:
            assert np.sign(step.weights[k] - w0[k]) == np.sign(slope)
    both = (like(w0, t0 + 1e-5) - like(w0, t0 - 1e-5)) / 2e-5
    if abs(both) > 1e-5:
        assert np.sign(step.thetas[0] - t0[0]) == np.sign(both)
    gap = (like(w0, t0 + [0, 1e-5]) - like(w0, t0 - [0, 1e-5])) / 2e-5
    if abs(gap) > 1e-5:
        assert np.sign(np.diff(step.thetas)[0] - np.diff(t0)[0]) == np.sign(gap)
    assert like(step.weights.astype(np.float64), step.thetas) > like(w0, t0)


def test_edges(spark):
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1, 12)] + [(None, 1), (4, None)], "doc_id long, grade int")
    m = Q.train(table(spark, EDGE), ratings)
    got = Q.grade(table(spark, EDGE), m).collect()
    assert len(got) == len(EDGE) and all(0 <= r.expected_grade <= 2 and len(r.tails) == 2 and r.shard == "x" for r in got)
    assert Q.grade(table(spark, []), m).count() == 0
    assert Q.train(table(spark, EDGE), ratings.limit(0)) is None
    assert all(r.kept and r.expected_grade is None for r in Q.grade(table(spark, EDGE), None).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.query(spark, sf).collect()}
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, poor = [g.kept for g, q in held if q], [g.kept for g, q in held if not q]
    print("sound kept", np.mean(good), len(good), "poor kept", np.mean(poor), len(poor))
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.2
