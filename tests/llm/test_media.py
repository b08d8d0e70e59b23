import hashlib
import zlib

import numpy as np

from tessera.llm import media as M, webp as W

from .helpers import EDGE, SF, table


def payload(t):
    b = (t or "").encode()
    return b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))


def check(rows, stored, got):
    media = {}
    for r in stored:
        media.setdefault((r.doc_id, r.n_bytes), []).append(bytes(r.media))
    want = sorted([(d, len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for d, t in rows], key=str)
    assert sorted([tuple(r)[:5] for r in got], key=str) == want
    for r in got:
        m = media[r.doc_id, r.n_bytes]
        assert (r.media_bytes, r.media_sha256) in [(len(x), hashlib.sha256(x).hexdigest()) for x in m]
    for d, t in rows:
        p = payload(t)
        assert any(len(p) <= W.decode(x).size // 4 and W.decode_bytes(x, len(p)).tobytes() == p for x in media[d, len((t or "").encode())])
        assert M.features(np.frombuffer(p, np.uint8)) in {r.feature for r in got if r.doc_id == d}


def test_edges(spark):
    rows = EDGE + [(50, "abcdefghij" * 130_000)]
    s = M.store(table(spark, rows))
    check(rows, s.collect(), M.read(s).collect())
    assert M.read(M.store(table(spark, []))).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(docs, M.store(spark.read.parquet(f"{SF}/documents.parquet")).collect(), M.query(spark, SF).collect())
