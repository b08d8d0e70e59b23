"""Services over an injected transport, parse cache, stage log, configuration, state snapshots, sinks, and the enhanced run."""

import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, text as T
from tessera.operators import access, chunk, enrich, index as I, retrieve as R
from tessera.plans import config, pipelines as P
from tessera.plans.log import StageLog
from tessera.plans.store import keeper, release, root
from tessera.sources import parsing, readers, remote


class Wire:
    """Answers in order; an int is an error status."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, method, url, headers=None, body=None, timeout=60):
        self.asked.append((method, url, json.loads(body) if body and body[:1] == b"{" else body))
        a = self.answers.pop(0)
        if isinstance(a, int):
            raise remote.ServiceError("no", a)
        return a if isinstance(a, bytes) else json.dumps(a).encode()


def test_embedding_service():
    wire = Wire(503, {"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}, {"data": [{"index": 0, "embedding": [5, 6]}]})
    e = remote.HttpEmbedder("http://e", "k", "m", width=2, batch=2, transport=wire, sleep=lambda s: None)
    assert e.embed(["a", "b", "c"]).tolist() == [[1, 2], [3, 4], [5, 6]] and len(wire.asked) == 3
    with pytest.raises(remote.ServiceError):
        remote.HttpEmbedder("http://e", width=2, transport=Wire({"data": [{"index": 0, "embedding": [1, 2]}]})).embed(["a", "b"])
    with pytest.raises(remote.ServiceError):
        remote.HttpEmbedder("http://e", width=2, transport=Wire(400), sleep=lambda s: None).embed(["a"])


def test_chat_service():
    said = lambda t: {"choices": [{"message": {"content": t}}]}
    wire = Wire(said("hi"), said('well: {"a": 1} so'), said("[1]"), {"choices": []})
    c = remote.HttpChat("http://c", transport=wire, prompts={"route": "long text"})
    assert c.chat("task: route", ["q"]) == ["hi"] and wire.asked[0][2]["messages"][0]["content"] == "long text"
    assert c.json("s", "u") == {"a": 1} and wire.asked[1][2]["response_format"] == {"type": "json_object"}
    for _ in range(2):
        with pytest.raises(remote.ServiceError):
            c.json("s", "u")


def test_parser_service():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x/full.md", "# T")
    task = {"data": {"task_id": "7", "upload_url": "http://up"}}
    wire = Wire(task, b"", {"data": {"state": "running"}}, 429, {"data": {"state": "done", "zip_url": "http://zip"}}, packed.getvalue())
    p = remote.RemoteParser("http://p", transport=wire, sleep=lambda s: None)
    assert p.parse("a.PDF", b"%PDF") == "# T" and [a[0] for a in wire.asked] == ["POST", "PUT", "GET", "GET", "GET", "GET"]
    with pytest.raises(remote.ServiceError, match="bad page"):
        remote.RemoteParser("http://p", transport=Wire(task, b"", {"data": {"state": "failed", "error": "bad page"}})).parse("a.pdf", b"")
    with pytest.raises(TimeoutError):
        remote.RemoteParser("http://p", transport=Wire(task, b"", *[{"data": {"state": "running"}}] * 9), sleep=lambda s: None, patience=10).parse("a.pdf", b"")
    with pytest.raises(ValueError):
        p.parse("a.doc", b"")


def test_parse_cache(spark, tmp_path):
    for name, text in (("a.pdf", "<h1>One</h1><p>x &amp; y</p>"), ("b.pdf", "<h1>One</h1><p>x &amp; y</p>"), ("c.PDF", "plain")):
        (tmp_path / name).write_text(text)
    cache = str(tmp_path / "cache")
    got = {r.name: r for r in parsing.parse_dir(spark, str(tmp_path), parsing.TextParser(), cache).collect()}
    assert got["a.pdf"].markdown == got["b.pdf"].markdown == "# One\n\nx & y" and got["c.PDF"].markdown == "plain"
    assert got["a.pdf"].document_dir.startswith("a_") and got["a.pdf"].document_dir[2:] == got["b.pdf"].document_dir[2:]
    assert spark.read.parquet(cache).count() == 2
    parsing.parse_dir(spark, str(tmp_path), parsing.TextParser(), cache)
    assert spark.read.parquet(cache).count() == 2
    inputs, known = readers.files(spark, str(tmp_path)).select("name", "content"), spark.read.parquet(cache)
    assert parsing.parse_files(inputs, parsing.TextParser(), known)[1].count() == 0
    assert parsing.parse_files(inputs, parsing.TextParser(), known, force=True)[1].count() == 2
    again = known.where("markdown = 'plain'").select("cache_key")
    docs, fresh = parsing.parse_files(inputs, parsing.TextParser(), known, reparse=again)
    assert fresh.count() == 1 and {r.name for r in docs.where("not restored").collect()} == {"c.PDF"}
    with pytest.raises(FileNotFoundError):
        parsing.parse_dir(spark, str(tmp_path), parsing.TextParser(), cache, ".docx")


def test_ingest_of_files(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"# 1 Pay\nOne hundred crowns.\n")), ("b.pdf", bytearray(b"# 2 Leave\nThirty days."))], "name string, content binary")
    log, keep = StageLog("ingest"), keeper(spark)
    out = P.ingest_files(files, parsing.TextParser(), keep, log=log)
    assert set(out) == {"inputs", "parsed_new", "parse", "clean", "chunk", "index"} and out["index"].count() == 2
    assert [e[3] for e in log.events if e[2] == "stage_end"] == list(P.STAGES)
    assert set(P.ingest_files(files, parsing.TextParser(), keep, dry_run=True)) == {"inputs"}
    again = P.ingest_files(files, parsing.TextParser(), keep, before=out, skip=("parse", "clean"), cache=out["parsed_new"])
    assert again["chunk"].count() == out["chunk"].count() and "parsed_new" not in again
    assert P.ingest_files(files, parsing.TextParser(), keep, cache=out["parsed_new"])["parsed_new"].count() == 0
    assert set(P.ingest_files(files, parsing.TextParser(), keep, skip=("parse",))) == {"inputs"}
    for bad in ({"skip": ("nap",)}, {}):
        with pytest.raises(ValueError):
            P.ingest_files(files if bad else files.limit(0), parsing.TextParser(), keep, **bad)


def test_stage_log(spark, tmp_path):
    times = iter(range(100))
    log = StageLog("p", "t", clock=lambda: float(next(times)))
    with log.stage("a", given=1) as counted:
        counted["hits"] = 3
    with pytest.raises(KeyError):
        with log.stage("b"):
            raise KeyError("x")
    rows = log.frame(spark).collect()
    assert [(r.event, r.stage, r.status) for r in rows] == [("stage_start", "a", None), ("stage_end", "a", "ok"), ("stage_start", "b", None), ("stage_error", "b", "error")]
    assert json.loads(rows[1].metrics) == {"given": 1, "hits": 3} and rows[1].elapsed_ms > 0 and rows[3].error_type == "KeyError"
    log.append(spark, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("pipeline = 'p'").count() == 4


def test_configuration(tmp_path):
    base = {"a": {"b": 1, "c": {"d": 2}}, "e": [1]}
    assert config.deep_merge(base, {"a": {"c": {"f": 3}}, "e": [2], "g": 4}) == {"a": {"b": 1, "c": {"d": 2, "f": 3}}, "e": [2], "g": 4}
    assert base == {"a": {"b": 1, "c": {"d": 2}}, "e": [1]} and config.deep_merge(base, None) == base
    (tmp_path / "r.json").write_text('{"weights": {"bm25": 0.5}, "table_aware": false}')
    made, whole = config.rerank_config(str(tmp_path / "r.json"), {"final_top_k": 3})
    assert (made.bm25, made.vector, made.table, made.top) == (0.5, 0.44, 0.0, 3) and whole["bonuses"]["table_chunk"] == 0.12


def test_state_snapshots(spark, tmp_path):
    path = str(tmp_path / "state")
    docs, size = I.load_state(spark, path)
    assert docs.count() == 0 and I.state_stats(docs, size).first().avg_len == 1.0
    I.save_state(*I.state_of(spark.createDataFrame([("a b",), ("b",)], "text string")), path)
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks" / "x.json").write_text('[{"content": "c c"}, {"text": "d"}, {"content": ""}]')
    (tmp_path / "chunks" / "y.json").write_text('{"document": "e"}')
    (tmp_path / "chunks" / "z.json").write_text("broken")
    I.save_state(*I.add_directory(*I.load_state(spark, path), str(tmp_path / "chunks")), path)
    s = I.state_stats(*I.load_state(spark, path)).first()
    assert (s.docs, s.len, s.vocabulary) == (5, 7, 5)
    half = sorted((tmp_path / "state").iterdir())[-1]
    (half / "_CURRENT").unlink()  # a save that died
    assert I.state_stats(*I.load_state(spark, path)).first().docs == 2
    I.reset_state(spark, path)
    assert I.state_stats(*I.load_state(spark, path)).first().docs == 0


def test_named_index(spark, tmp_path):
    schema = "id string, n int"
    assert I.open_index(spark, str(tmp_path), schema).count() == 0
    I.write_index(spark.createDataFrame([("a", 1)], schema), str(tmp_path))
    I.write_index(spark.createDataFrame([("a", 2), ("b", 3)], schema), str(tmp_path))
    assert I.open_index(spark, str(tmp_path), schema).count() == 2
    with pytest.raises(ValueError):
        I.write_index(spark.createDataFrame([], schema), str(tmp_path))
    assert I.open_index(spark, str(tmp_path), schema).count() == 2
    same = spark.createDataFrame([("x", "d", 2), ("x", "d", 1), ("x", "d", 2)], "id string, document_id string, n int")
    assert [r.n for r in I.sync(same.limit(0), same).collect()] == [1]


def test_sinks_and_cases(spark, tmp_path):
    readers.write_clean(spark.createDataFrame([("d1", "a\nb\n"), ("d2", "")], "document_id string, text string"), str(tmp_path / "clean"))
    assert spark.read.text(str(tmp_path / "clean")).where("document_id = 'd1'").count() >= 2
    hybrid = enrich.enrich(chunk.chunks(spark.createDataFrame([("d", "# t\nx\n\n| a | b |\n|---|---|\n| 1 | 2 |")], "document_id string, text string")))
    assert readers.write_hybrid(hybrid, str(tmp_path / "h")).first().asDict() == {"document_id": "d", "chunk_count": 4, "section_chunk": 1, "text_chunk": 2, "table_chunk": 1, "image_chunk": 0, "embed_count": 3}
    assert readers.chunk_files(spark, str(tmp_path / "h"), hybrid.schema, "*.json", lines=True).count() == 3
    assert readers.write_json_result(spark.createDataFrame([(1, None, "ü")], "a int, b string, c string"), str(tmp_path / "r" / "x.json")) == 1
    assert json.loads((tmp_path / "r" / "x.json").read_text(encoding="utf-8")) == [{"a": 1, "b": None, "c": "ü"}]
    with pytest.raises(ValueError):
        readers.write_json_result(spark.range(3), str(tmp_path / "y.json"), 2)
    (tmp_path / "c.jsonl").write_text('{"id": "1"}\n\n{"id": 2\n')
    with pytest.raises(ValueError, match="line 3"):
        readers.cases(spark, str(tmp_path / "c.jsonl"))


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    nested = F.lit('{"A": "x, \\"Y\\": {z}", "b": [1.5, true, null, "C:d"], "e": {}}')
    assert one(T.normalize_json_text(nested)) == 'a x, "y": {z} b 1.5 true  c:d e'
    assert one(T.normalize_json_text(F.lit(json.dumps(["q" * 200000])))) == "q" * 200000
    assert one(T.distance_score(F.lit(0.25))) == 0.75 and one(T.distance_score(F.lit(None).cast("double"))) is None
    assert one(T.line_range(F.array(F.lit(1), F.lit(2)))) == [1, 2] and one(T.line_range(F.array(F.lit(1)))) == []
    assert one(T.normalize_list(F.array(F.lit("a"), F.lit(" "), F.lit(None)))) == ["a"]
    assert one(T.truncate_block(F.lit("abcdef"), 3)) == "abc\n...[TRUNCATED 3 chars]"
    assert [one(access.level(F.lit(x))) for x in ("3", "l4", " ", None)] == ["L3", "L4", "L1", "L1"]


def plain_markdown(t):
    """The cleaning chain in plain Python, for texts without code fences and tables."""
    t = re.sub("[​‌‍﻿\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub("\r\n?", "\n", t or ""))
    t, out, inside = re.sub("[ 　]", " ", t), [], False
    for x in t.split("\n"):
        if re.fullmatch(r"#{1,6}\s*(目录|table of contents|toc)\s*", x.strip(), re.I):
            inside = True
        elif re.match(r"#{1,6}\s+", x.strip()):
            inside = False
        out += [] if inside else [x]
    t = re.sub(r"\A\s*---\n.*?\n---\s*\n", "", "\n".join(out), flags=re.S)
    t = re.sub(r"<!--.*?-->", "", t, flags=re.S)
    t = re.sub(r"</?(div|span|font|center|p|br|strong|em|b|i|u|section|article)[^>]*>", "", t, flags=re.I)
    t = re.sub(r"^\s*([-*_])\s*(\1\s*){2,}$", "", t, flags=re.M)
    number = r"[-–—]?\s*\d{1,4}\s*[-–—]?|(第\s*)?\d{1,4}\s*(页|/\s*\d{1,4}|of\s+\d{1,4})|Page\s+\d{1,4}(\s*/\s*\d{1,4})?"
    kept = []
    for x in t.split("\n"):
        if re.fullmatch(number, x.strip(), re.I) or re.fullmatch(r"\s*\|(\s*\|)+\s*", x):
            continue
        x = x.strip()
        if re.fullmatch(r"[·•\-\s]{3,}", x) or re.fullmatch(r"[.。·•]{4,}", x):
            continue
        x = re.sub(r"^(\d+)\.(\S)", r"\1. \2", re.sub(r"^\s*[*+]\s+", "- ", re.sub(r"^(#{1,6})([^\s#])", r"\1 \2", x)))
        x = x if x[:1] in ("|", " ") else re.sub(r"[ \t]{2,}", " ", x)
        if not kept or kept[-1] != x:
            kept.append(x)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip() + "\n"


def test_markdown_chain_against_plain_python(spark):
    rnd = random.Random(3)
    bits = ["# Head", "#目录", "## TOC ", "1 a 2", "", "", "dup", "dup", "* x", "+ y", "3.z", "Page 4", "- 5 -", "| | |", "····", "....", "a   b", "---", "* * *", "<b>c</b>", "<!-- d", "e -->", " f​", "####### g", "#", "第 3 页", "_ _ _"]
    texts = ["\n".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))) for _ in range(400)] + ["line\n" * 50000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", clean.markdown("t").alias("m")).collect()
    wrong = [(texts[r.i], r.m) for r in rows if r.m != plain_markdown(texts[r.i])]
    assert not wrong, wrong[0]


@pytest.mark.parametrize("names", ["int", "str"])
def test_nearest_vectors_against_all_pairs(spark, names):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((9000, 4)).round(1)
    x[5000:6000] = x[17]  # one very common vector
    ident = (lambda i: i) if names == "int" else (lambda i: f"v{i}")
    kind = "long" if names == "int" else "string"
    index = spark.createDataFrame([(ident(i), v.tolist()) for i, v in enumerate(x)], f"id {kind}, embedding array<double>").repartition(5)
    asked = index.where(F.col("id").isin([ident(i) for i in (0, 17, 5500, 8999)])).withColumnRenamed("id", "qid")
    got = {}
    for r in R.vector_top(index, asked, 7).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in (0, 17, 5500, 8999):
        d = np.round(1 - unit @ unit[i], 9) + 0.0
        best = sorted((dist, ident(j)) for j, dist in enumerate(d.tolist()))[:7]
        assert [j for _, j in sorted(got[ident(i)])] == [j for _, j in best]


def test_enhanced_run(spark):
    pay = "# 1 Pay\n## 1.1 Grades\nThe salary of grade nine is one hundred crowns.\n\n" + "The salary of grade ten is two hundred crowns. " * 30 + "\n\n## 1.2 Leave\nThere are thirty days of leave."
    docs = spark.createDataFrame([("pay_0123456789ab", pay), ("trip_0123456789ab", "# Trips\nTrains are booked by the office.")], "document_id string, text string")
    keep = keeper(spark)
    chunks = keep(P.hybrid_chunks(P.cleaned(docs)), "c")
    index = keep(P.to_index(chunks, P.Settings()), "i")
    questions = spark.createDataFrame([(1, "salary of grade nine and grade ten"), (2, "hello"), (3, "which comet comes")], "qid int, question string")
    log = StageLog("enhanced")
    state = I.state_of(index, "document")
    got = {r.qid: r for r in P.ask_enhanced(index, chunks, questions, keep, state=state, log=log).collect()}
    assert (got[1].status, got[1].grade, got[1].attempt) == ("answered", "yes", 0) and got[1].merged_hits >= 1 and got[1].rescored_hits >= 1
    assert got[1].faithfulness is not None and got[1].relevancy is not None and got[2].status == "direct" and got[2].grade is None
    assert got[3].grade == "no" and got[3].attempt == 2 and got[3].status == "answered"
    assert {e[3] for e in log.events} >= {"understand", "evaluate"}
    none = P.ask_enhanced(index, chunks, questions.where("qid = 1"), keep, judged=spark.createDataFrame([("pay", False)], "document_name string, allowed boolean")).first()
    assert none.status == "denied" and none.answer == P.REFUSED
    prepared = P.understood(questions, P.Settings())
    rows = {r.qid: r for r in P.results(spark.createDataFrame([(1, "answered", ["C1"]), (2, "direct", [])], "qid int, status string, citations array<string>"), prepared, "t", "standard").collect()}
    assert rows[1].citations == ["C1"] and rows[1].rewrite is not None and rows[2].rewrite is None and not rows[2].needs_retrieval
    release(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root(spark))
    assert len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)) == 0
