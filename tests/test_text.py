import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import clean, text as T


def values(spark, inputs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def tokens(s):
    s = (s or "").lower()
    han = re.findall("[一-鿿]", s)
    return re.findall("[a-z0-9_]+", s) + han + [a + b for a, b in zip(han, han[1:])]


def test_tokenizer_fixtures(spark):
    cases = ["新员工入职ABC_1 测试", "中", "abc", "Ünïté 12", "", None, "a，中。文b"]
    assert values(spark, cases, T.tokenize) == [tokens(c) for c in cases]
    assert tokens(cases[0])[:3] == ["abc_1", "新", "员"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ_9 中文测,\n　é"), max_size=30), min_size=1, max_size=20))
def test_tokenizer_on_random_text(spark, texts):
    assert values(spark, texts, T.tokenize) == [tokens(t) for t in texts]


def test_scores(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, 2.0), (2, 2.0), (2, None), (3, None)], "g int, x double")
    got = sorted((r.g, -1 if r.x is None else r.x, r.y) for r in df.select("g", "x", T.min_max("x", ["g"]).alias("y")).collect())
    assert got == [(1, -1, 0.0), (1, 1.0, 0.0), (1, 3.0, 1.0), (2, -1, 0.0), (2, 2.0, 1.0), (2, 2.0, 1.0), (3, -1, 0.0)]
    a = spark.createDataFrame([(["a", "b"], ["b", "c"], [1.0, 0.0], [0.0, 0.0]), ([], ["a"], [3.0, 4.0], [6.0, 8.0])], "a array<string>, b array<string>, u array<double>, v array<double>")
    assert [(round(r.j, 6), round(r.c, 6)) for r in a.select(T.jaccard("a", "b").alias("j"), T.cosine("u", "v").alias("c")).collect()] == [(0.333333, 0.0), (0.0, 1.0)]


def test_truncation_and_lists(spark):
    assert values(spark, ["abcdef", "abc", None], lambda x: T.truncate(x, 3)) == ["abc...[TRUNCATED 3 chars]", "abc", None]
    assert values(spark, [" abcdef ", "abc"], lambda x: T.truncate_block(x, 3)) == ["abc\n...[TRUNCATED 3 chars]", "abc"]
    assert values(spark, ["- a\n-b\n - c \n- 无声明\n- "], T.bullets) == [["a", "c"]]
    assert values(spark, ['so {"verdict": "Yes"} ok', "yes indeed", "no", "broken {"], T.verdict) == ["yes", "yes", "no", "no"]
    assert values(spark, ["价格表", "weather"], T.table_intent) == [True, False]
    assert values(spark, [' a<b>:c. ', "...", "ok"], T.safe_name) == ["a_b__c", "document", "ok"]
    assert values(spark, ["x_0123456789ab", "x_1"], T.document_name) == ["x", "x_1"]


def test_cleaning_fixture(spark):
    text = "\n".join(["###标题", "* a", "+ b", "1.内容", "第 3 页", "- 12 -", "| | |", "x   y", "x   y"])
    assert values(spark, [text], clean.markdown) == ["### 标题\n- a\n- b\n1. 内容\nx y\n"]


def test_cleaning_cases(spark):
    code = "a\n```\n* x\n\n\n\ny   z\n```\nb"
    table = "t\n<table>\n<tr> <td>1</td>\n</tr></table>\nu"
    toc = "# 目录\nanything\n- [a](#b)\n\n# One\ntext"
    front = "---\ntitle: x\n---\nbody\n---\nnot: front\n---\nend"
    assert values(spark, [code, table, toc, "a<img src=x>b<pre>c", "", None, "-\n-\n-"], clean.markdown) == [
        "a\n```\n* x\n\n\n\ny   z\n```\nb\n".replace("\n\n\n\n", "\n\n"), "t\n<table><tr><td>1</td></tr></table>\nu\n", "# One\ntext\n", "abc\n", "\n", "\n", "\n",
    ]


def test_table_separator(spark):
    assert values(spark, ["|:--|---:|:---:|---|", "a|b", "| - | - |"], clean.table_separator) == ["| :--- | ---: | :---: | --- |", "a|b", "| --- | --- |"]


def test_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("",), (None,), ("{bad",)], "x string")
    got = [r.y for r in df.select(T.parse_json("x", "a int", F.struct(F.lit(0).alias("a"))).alias("y")).collect()]
    assert [g.a for g in got] == [1, 0, 0, 0]
