import zlib

import numpy as np

from tessera.llm import langid as L

from .helpers import EDGE, SF, table


def test_presence_and_kernel_against_plain_sets():
    texts = ["Hello, World", "", "a", "héllo wörld", "zz zz"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    p = L.presence(np.frombuffer(b"".join(raw), np.uint8), offsets)

    def grams(b):
        b = [c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b]
        out = {n: set() for n in L.WIDTHS}
        for n, bits in L.WIDTHS.items():
            for i in range(len(b) - n + 1):
                v = int.from_bytes(bytes(b[i : i + n]), "big")
                out[n].add(v if n == 1 else (v * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits))
        return out

    sets = [grams(b) for b in raw]
    for d, g in enumerate(sets):
        assert set(np.flatnonzero(p[d])) == {L._STARTS[n] + x for n in g for x in g[n]}
    k = L.normalized(p) @ L.normalized(p).T
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = sum(L.BLEND[n] * len(a[n] & b[n]) / (len(a[n]) * len(b[n])) ** 0.5 for n in a if a[n] and b[n])
            assert abs(k[i, j] - want) < 1e-4


def test_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs)
    rows = EDGE + [(30, "12 34 !!"), (31, "日本"), (32, "é")]
    got = {(r.doc_id, r.text): r for r in L.identify(table(spark, rows), model).collect()}
    assert len(got) == len(set(rows))
    for (d, t), r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= r.score <= 1
        assert r.shard == "x" and (r.lang_pred == "und" or r.lang_pred in model.languages)
    assert L.identify(table(spark, []), model).count() == 0
    assert L.train(table(spark, EDGE)) is None
    assert {r.lang_pred for r in L.identify(table(spark, EDGE), None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = L.query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
