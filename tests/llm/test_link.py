import random

from pyspark.sql import functions as F

from tessera.llm import components as C, neardup as N, store as S

ALWAYS = lambda a, b: F.size(a) > 0


def smallest(pairs):
    """Each node of the pairs and the smallest node that it reaches."""
    low = {x: x for p in pairs for x in p}
    while True:
        after = dict(low)
        for a, b in pairs:
            after[a] = after[b] = min(after[a], after[b])
        if after == low:
            return low
        low = after


def got(linked):
    rows = linked.collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "materialize", lambda df, label: written.append(label) or S.materialize(df, label))
    stars = [(10 * k, 10 * k + i) for k in range(1, 5) for i in range(1, 4)]
    assert got(C.components(spark.createDataFrame(stars, "a long, b long"), "a", "b")) == smallest(stars)
    assert len(written) == 1  # the edges themselves


def test_random_graphs(spark):
    rnd = random.Random(4)
    for n in (0, 5, 60):
        pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(n)]
        assert got(C.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b")) == smallest([p for p in pairs if p[0] != p[1]])


def test_later_rounds_take_components_as_nodes(spark, monkeypatch):
    """Links of the first bands make groups of ten; one bucket of a later band joins the first ids of two groups each, and adds nodes."""
    groups = [list(range(100 * g, 100 * g + 10)) for g in range(1, 9)]
    bands = {i: [g[0], *(10**6 + 40 * i + k for k in range(7))] for g in groups for i in g}
    later = [(100, 200), (300, 400), (401, 7)]
    bands[7] = [10**7 + k for k in range(8)]
    for n, (a, b) in enumerate(later):
        bands[a][5 + n % 3] = bands[b][5 + n % 3] = 10**8 + n
    classes = spark.createDataFrame([(i, b, [1]) for i, b in bands.items()], "id long, bands array<long>, sig array<long>")
    edges = []
    monkeypatch.setattr(N, "components", lambda e, a, b: edges.append(e.count()) or C.components(e, a, b))
    linked = N.link(classes, ALWAYS, lambda ids: classes.join(ids, "id").select("id", "sig", F.col("bands").alias("set")))
    assert got(linked) == smallest([(g[0], i) for g in groups for i in g[1:]] + later)
    assert edges[0] == 72 and len(edges) > 1 and max(edges[1:]) <= len(later)
