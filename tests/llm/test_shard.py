import zlib
from collections import defaultdict

from tessera.llm import shard as S

from .helpers import EDGE, SF, table


def expected(rows, n=24, overhead=8):
    key = [(d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + overhead) for d, t in rows]
    key.sort()
    total, at, slots, out = sum(k[3] for k in key), 0, defaultdict(int), []
    for has, d, crc, size in key:
        s = min(n - 1, (2 * at + size) * n // (2 * total))
        out.append((d if has else None, size, crc, s, slots[s]))
        slots[s] += 1
        at += size
    return out


def rows_of(df):
    return sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()], key=str)


def test_edges(spark):
    assert rows_of(S.shard_by_bytes(table(spark, EDGE))) == sorted(expected(EDGE), key=str)
    assert S.shard_by_bytes(table(spark, [])).count() == 0


def test_query(spark):
    got = S.query(spark, SF)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(got) == sorted(expected(docs), key=str)
    per = defaultdict(int)
    for r in got.collect():
        per[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert max(per.values()) - min(per.values()) <= 2 * max(r["size"] for r in got.collect())
