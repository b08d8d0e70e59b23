import hashlib
import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tessera.llm import bpe_codec as B

from .helpers import EDGE, SF, table

TOK = Tokenizer.from_file(P.path("word_bpe_49k.json"))


def expected(rows):
    out = []
    for d, x in rows:
        ids = TOK.encode(x or "", add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_edges(spark):
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 12))) for _ in range(900))
    odd = [(100 + i, passage[rnd.randrange(300) :] + rnd.choice([" ", "", "x", "é", "<|endoftext|>"]) + passage[: rnd.randrange(5000)]) for i in range(40)]
    odd += [(300 + i, "".join(chr(rnd.choice([rnd.randrange(1, 0x370), rnd.randrange(1, 0xD7FF), 32, 39, 10, 97])) for _ in range(700))) for i in range(60)]
    odd += [(500, "<|startoftext|>" * 900), (501, "é ́x" * 2000), (502, "ΑΣ ΑΣ. Σ " * 300), (503, "日本" * 5000), (504, "\x85\xa0 " * 700)]
    got = B.encode_decode(table(spark, EDGE + odd))
    assert sum(r.n_reused for r in got.collect()) > 100
    assert rows_of(B.digests(table(spark, EDGE + odd))) == expected(EDGE + odd)
    assert B.digests(table(spark, [])).count() == 0


def test_small_dictionary_gives_the_same(spark):
    rows = [(i, ("shared words in a passage " * 60) + str(i)) for i in range(20)]
    a, b = (B.encode_decode(table(spark, rows), dictionary_bytes=n).select("doc_id", "ids", "decoded") for n in (0, 1 << 20))
    assert rows_of(a) == rows_of(b)


def test_chunks_are_defined_by_content():
    a = np.frombuffer(("unrelated start of some length " * 20 + (t := "".join(f"w{i * 7919 % 10007} " for i in range(2000)))).encode(), np.uint8)
    b = np.frombuffer(t.encode(), np.uint8)
    cut = lambda x: {x[s:e].tobytes() for y in B.chunk_ends(x, np.array([0, len(x)])) for s, e in zip([0, *y], y)}
    assert len(cut(a) & cut(b)) > 0.8 * len(cut(b))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(B.query(spark, SF)) == expected(docs)
