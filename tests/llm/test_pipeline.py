import random

import corpus_pipeline as P

from . import test_bpe_codec as bpe, test_decontaminate as dec, test_neardup as near, test_passages as pas
from .helpers import EDGE, SF, table


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "substrings", "benchmark", "encode"]
    for k, (name, stage) in enumerate(P.STAGES):
        before = pairs(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        if name == "language":
            assert sorted(pairs(out)) == sorted((d, t) for d, t in before if any(c.isalpha() for c in t or ""))
        elif name == "near_duplicates":
            assert sorted(pairs(out)) == sorted((d, t) for (d, t) in before if d in {r[0] for r in near.brute(before) if r[3]})
        elif name == "substrings":
            where = {}
            for d, t in before:
                for w in pas.windows(t, 20):
                    where.setdefault(w, set()).add(d)
            shared = {d for v in where.values() if len(v) > 1 for d in v}
            after = dict(pairs(out))
            assert all(after[d] == t for d, t in before if d not in shared)
            assert all(r.n_chars == len(r.text) for r in out.collect())
            left = {}
            for d, t in after.items():
                for w in pas.windows(t, 51):
                    left.setdefault(w, set()).add(d)
            assert all(len(v) == 1 for v in left.values())
        elif name == "benchmark":
            clean = {r[0] for r in dec.brute(before, items) if not r[2]}
            assert sorted(pairs(out)) == sorted((d, t) for d, t in before if d in clean) and len(clean) < len(before)
        else:
            assert bpe.rows_of(out) == bpe.expected(before)
        docs = out
    assert bpe.rows_of(P.run(spark, SF)) == bpe.rows_of(docs)


def test_edges(spark):
    docs = table(spark, EDGE).select("doc_id", "text", "lang", "source", "n_chars")
    left = P.near_duplicates(spark, docs, SF)
    assert sorted((d for d, _ in pairs(left) if d is not None)) == [1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert P.language(spark, docs, SF).count() == 0  # nothing to learn from, so nothing is recognised
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_copies_that_stars_leave_apart(spark):
    rnd, base, rows = random.Random(1), [f"b{i}" for i in range(100)], []
    for k in range(60):  # every other one is a part of the text with words of its own, most of whose shingles no other has
        w = list(base)
        w[rnd.randrange(100)] = f"q{k}"
        rows.append((k, " ".join(w[: rnd.randrange(28, 50)] + [f"t{k}x{i}" for i in range(rnd.randrange(10, 40))] if k % 2 else w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0] for r in near.brute(rows) if r[3]}
    assert sorted(pairs(P.near_duplicates(spark, docs, SF))) == [(d, t) for d, t in rows if d in kept]
