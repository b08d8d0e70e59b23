"""The sketches that the prefix join of passages carries in place of sets."""

import random

from pyspark.sql import functions as F

from tessera.llm import neardup as N, passages as P


def sets_of(n=240, size=20, seed=5):
    rng, out = random.Random(seed), []
    for i in range(n):
        base = out[rng.randrange(len(out))][1] if out and rng.random() < 0.6 else [rng.randrange(-(2**31), 2**31) for _ in range(rng.choice((size, 3 * size, 20 * size)))]
        s = list(base)
        for _ in range(rng.randrange(len(s) // 5 + 1)):
            s[rng.randrange(len(s))] = rng.randrange(-(2**31), 2**31)
        out.append((i, s))
    return out


def close(a, b):
    return 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b))


def test_sketches_rule_out_no_close_pair(spark):
    rows = sets_of()
    df = spark.createDataFrame(rows, "id long, set array<int>").withColumn("sig", N.sketch("set"))
    sketches = {r.id: [x & (2**64 - 1) for x in r.sig] for r in df.collect()}
    for i, a in rows[:60]:
        want = [0, 0]
        for x in set(a):
            want[x >> 6 & 1] ^= 1 << (x & 63)
        assert sketches[i] == want
    both = df.select(F.col("id").alias("a"), F.size("set").alias("na"), F.col("sig").alias("ga")).crossJoin(df.select(F.col("id").alias("b"), F.size("set").alias("nb"), F.col("sig").alias("gb"))).where("a < b")
    kept = {(r.a, r.b) for r in both.where(N.may_reach("ga", "gb", 75)).select("a", "b").collect()}
    true = {(i, j) for i, a in rows for j, b in rows if i < j and close(a, b)}
    assert len(true) > 30 and true <= kept and len(kept) < len(rows) * (len(rows) - 1) // 4


def test_sketched_links_are_those_of_all_pairs(spark):
    rows = sets_of(seed=9)
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and close(a, b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    # One bucket holds all, so stars leave much to the prefix join.
    classes = spark.createDataFrame([(i, [1], s) for i, s in rows], "id long, bands array<long>, sig array<int>")
    got = P.link(classes, P.close, lambda ids: classes.join(ids, "id").select("id", "sig", F.col("sig").alias("set")), sketched=True)
    components = {r.node: r.component for r in got.collect()}
    assert {i: components.get(i, i) for i, _ in rows} == {i: top(i) for i, _ in rows}
