import random

import public_tokenizers as P
from tokenizers import Tokenizer

from tessera.llm import bpe_count as B

from .helpers import EDGE, SF, table


def expected(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return sorted([(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for d, x in rows], key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_edges(spark):
    rnd = random.Random(1)
    odd = [(100 + i, "".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(1, 0xD7FF), 32, 39, 10, 97])) for _ in range(60))) for i in range(300)]
    odd += [(500, "a<|endoftext|><|endoftext|> b <|endoftext"), (501, "aaaaaaa" * 3000), (502, "\x1c \x1d\x1e \x85   x"), (503, " " * 999)]
    assert rows_of(B.count_tokens(table(spark, EDGE + odd))) == expected(EDGE + odd)
    assert B.count_tokens(table(spark, [])).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(B.query(spark, SF)) == expected(docs)
