import random
import re

from pyspark.sql import functions as F

from tessera.llm import neardup as N

from .helpers import EDGE, SF, lower_az, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = WORD.findall(lower_az(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if 4 * min(len(s), len(t)) >= 3 * max(len(s), len(t)):
                n = len(s & t)
                if 100 * n >= 75 * (len(s) + len(t) - n):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted([(d, len(s), None if d is None else find(d), d is None or d == find(d)) for d, s in sets], key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


def test_edges_and_chains(spark):
    rnd = random.Random(3)
    rows, n = list(EDGE), 100
    for _ in range(12):  # chains in which neighbours are near copies and the ends are not
        w = [f"v{rnd.randrange(500)}" for _ in range(80)]
        for _ in range(15):
            rows.append((n, " ".join(w)))
            n += 1
            w = list(w)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
    base = [f"b{i}" for i in range(60)]
    for _ in range(80):  # one large group around one text
        w = list(base)
        w[rnd.randrange(60)] = f"q{rnd.randrange(10**6)}"
        rows.append((n, " ".join(w).upper() if n % 2 else "\t".join(w)))
        n += 1
    rnd.shuffle(rows)
    want = brute(rows)
    assert rows_of(N.near_duplicates(table(spark, rows))) == want
    assert rows_of(N.near_duplicates(table(spark, rows), block=3)) == want
    assert N.near_duplicates(table(spark, [])).count() == 0


def test_prefix_join_is_exact_and_spares_templates(spark):
    rnd = random.Random(9)
    template = rnd.sample(range(10**6), 60)
    sets = [(i, sorted({*template, *(rnd.randrange(2 * 10**6, 3 * 10**6) for _ in range(40))})) for i in range(300)]  # similarity about 0.43
    for i in range(300, 420):  # around a few, some at the threshold
        base = set(sets[i % 7][1])
        out = rnd.sample(sorted(base), rnd.randrange(0, 18))
        sets.append((i, sorted((base - {*out}) | {4 * 10**6 + 100 * i + k for k in range(len(out) // 2)})))
    rows = spark.createDataFrame([(i, i if i % 5 else 0, s, s) for i, s in sets], "id long, label long, sig array<long>, set array<long>")
    close = {(a, b) for a, s in sets for b, t in sets if a < b and (a if a % 5 else 0) != (b if b % 5 else 0) and 100 * len({*s} & {*t}) >= 75 * len({*s} | {*t})}
    for block in (3, 512):
        got = {(r.a, r.b) for r in N.prefix_pairs(rows, 75, block, lambda x, y: F.size(x) > 0).collect()}
        assert close <= got and len(close) > 50 and len(got) < 3 * len(close)
        assert not any(a < 300 and 7 <= a and b < 300 for a, b in got)


def test_prefix_join_passes_over_sets_with_few_shared_elements(spark):
    rows = [(i, [7, 8, 9, *(100 * i + k for k in range(40))]) for i in range(10)] + [(i, [7, 8, 9]) for i in range(10, 14)]
    sets = spark.createDataFrame([(i, i, [0], s) for i, s in rows], "id long, label long, sig array<long>, set array<long>")
    want = {(a, b) for a in range(10, 14) for b in range(a + 1, 14)}
    for cut in (False, True):
        assert {(r.a, r.b) for r in N.prefix_pairs(sets, 75, 512, lambda x, y: F.size(x) > 0, cut=cut).collect()} == want


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(N.query(spark, SF)) == brute(docs)
