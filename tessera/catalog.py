"""Every query of the library over the driver's tables, with the same question in DuckDB SQL where SQL can ask it.

``documents`` stand for the corpus (``source`` as document name, ``lang`` as chunk type), ``benchmark`` for questions,
``embeddings`` for the vector index, ``conversations`` for ordered chunks, ``events`` for the log, and
customer, orders, lineitem for parents, children and leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import clean, text as tx
from .operators import access, chunk, context, enrich, evaluate, index as ix, retrieve, understand
from .plans import pipelines, schema
from .plans.log import StageLog, hit_metrics
from .plans.store import keeper, root
from .sources import readers
from .sources.providers import HashedEmbedder, RuleChat
from .streaming.ingest import event_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    han = rf"regexp_extract_all({t}, '[\x{{4e00}}-\x{{9fff}}]')"
    return f"list_concat(list_concat(regexp_extract_all({t}, '[a-z0-9_]+'), {han}), list_transform(range(1, len({han})), lambda i: {han}[i] || {han}[i + 1]))"


# ---------------------------------------------------------------- functions


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def fn_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokenize("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, list_distinct({sql_tokens('text')}) AS t FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0e0 ELSE len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) END, 6) AS similarity
FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def fn_jaccard(spark, d):
    s = table(spark, d, "documents").select("doc_id", tx.token_set("text").alias("t"))
    n = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return s.join(n, "doc_id").select("doc_id", F.round(tx.jaccard("t", "u"), 6).alias("similarity"))


@query("""SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def fn_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select("vec_id", F.round(tx.cosine("embedding", "other"), 6).alias("cosine"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 0e0 WHEN hi = lo THEN 1e0 ELSE (p_retailprice - lo) / (hi - lo) END, 6) AS score FROM
(SELECT *, min(CASE WHEN p_size % 5 <> 0 THEN p_retailprice END) OVER (PARTITION BY p_brand) AS lo, max(CASE WHEN p_size % 5 <> 0 THEN p_retailprice END) OVER (PARTITION BY p_brand) AS hi FROM part)""")
def fn_minmax(spark, d):
    p = table(spark, d, "part").withColumn("x", F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice")))
    return p.select("p_partkey", F.round(tx.min_max("x", ["p_brand"]), 6).alias("score"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...[TRUNCATED ' || (length(text) - 120) || ' chars]' ELSE text END AS short FROM documents")
def fn_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate("text", 120).alias("short"))


_ASKED = "list_extract(['', '表', '格', '价格', '金 额', '金额', '预算', '薪酬', '等级', '比例', '字段', '清单', '模板', '表格'], CAST(item_id % 14 + 1 AS BIGINT))"


@query(f"SELECT item_id, regexp_matches(text || {_ASKED}, '表|表格|价格|金额|预算|薪酬|等级|比例|字段|清单|模板') AS wants_table FROM benchmark")
def fn_table_intent(spark, d):
    said = F.array(*[F.lit(x) for x in ("", "表", "格", "价格", "金 额", "金额", "预算", "薪酬", "等级", "比例", "字段", "清单", "模板", "表格")])
    q = F.concat("text", F.element_at(said, (F.col("item_id") % 14 + 1).cast("int")))
    return table(spark, d, "benchmark").select("item_id", tx.table_intent(q).alias("wants_table"))


@query("SELECT c_custkey, array_to_string(list_filter([trim(c_mktsegment), trim(lower(c_mktsegment)), ' '], lambda x: trim(x) <> ''), '|') AS names FROM customer")
def fn_unique_keep_order(spark, d):
    v = F.array("c_mktsegment", F.lower("c_mktsegment"), F.lit(" "), F.concat(F.lit(" "), F.col("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(tx.unique_keep_order(v), "|").alias("names"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.' || json_keys(props)[1]) AS VARCHAR) AS first_value FROM events")
def fn_parse_json(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get(F.json_object_keys("props"), F.lit(0))).withColumn("m", tx.parse_json("props", "map<string,string>"))
    return e.select("event_id", F.try_element_at("m", F.col("k")).alias("first_value"))


@query("""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url, '[.][^.]*$', ''), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'document') || '_' || substr(sha256(html), 1, 12) AS name FROM pages""")
def src_result_dir(spark, d):
    return table(spark, d, "pages").select("page_id", readers.result_dir(F.col("url"), F.col("html").cast("binary")).alias("name"))


@query("SELECT doc_id, sha256(text) AS content_hash, CAST(doc_id AS VARCHAR) || '::' || lang || '::' || 1 || '-' || n_chars || '::' || substr(sha256(text), 1, 16) AS index_id FROM documents")
def fn_chroma_id(spark, d):
    h = tx.content_hash("text")
    return table(spark, d, "documents").select("doc_id", h.alias("content_hash"), tx.index_id(F.col("doc_id").cast("string"), F.col("lang"), F.lit(1), F.col("n_chars"), h).alias("index_id"))


# ---------------------------------------------------------------- cleaning

#: Documents with lines for every rule before their own.
_NOISE = ["---", "Page 3", "第 4 页", "| | |", "#Head", "+ item", "1.x", "····", "a  b\t\tc", "|a|b|", "|:--|---:|", "* * *", "- 12 -", "---", "dup", "dup", "", "", "#目录", "1 a 2", "\u200b ## TOC", "\u00a0x", "  # Body", "## "]
_SQL_NOISY = "'" + "' || chr(10) || '".join(_NOISE) + "' || chr(13) || chr(10) || '<b>bold</b><!-- gone -->' || chr(10) || text"


def noisy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("\n".join(_NOISE) + "\r\n<b>bold</b><!-- gone -->\n"), "text").alias("text"))


def _lines_sql(keep: str | None = None, each: str = "s") -> str:
    x = "string_split(t, chr(10))"
    if keep:
        x = f"list_filter({x}, lambda s: {keep})"
    return f"array_to_string(list_transform({x}, lambda s: {each}), chr(10))"


_PY_STRIP = r"regexp_replace(s, '^[\s\p{Z}\x0b\x1c-\x1f\x85]+|[\s\p{Z}\x0b\x1c-\x1f\x85]+$', '', 'g')"
_SQL_LINES = "FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM n)"
#: Rules that look at other lines: queries over table n (doc_id, t) that give (doc_id, out).
_CLEAN_LINES_SQL = {
    "clean_toc": rf"""l AS (SELECT doc_id, s, i, {_PY_STRIP} AS u {_SQL_LINES}), m AS (SELECT *, CASE WHEN regexp_full_match(u, '(?i)#{{1,6}}\s*(目录|Table of Contents|TOC)\s*') THEN 1 WHEN regexp_matches(u, '^#{{1,6}}\s+') THEN 0 END AS mark FROM l),
k AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 0) AS inside FROM m) SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (inside = 0), '') AS out FROM k GROUP BY doc_id""",
    "clean_line_pass": rf"""l AS (SELECT doc_id, i, {_PY_STRIP} AS u {_SQL_LINES}), k AS (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(u, '^(#{{1,6}})([^\s#])', '\1 \2'), '^\s*[*+]\s+', '- '), '^([0-9]+)\.([^\s])', '\1. \2') AS v
FROM l WHERE NOT (regexp_full_match(u, '[·•\-\s]{{3,}}') OR regexp_full_match(u, '[.。·•]{{4,}}'))), q AS (SELECT doc_id, i, CASE WHEN v LIKE '|%' OR v LIKE ' %' THEN v ELSE regexp_replace(v, '[ \t]{{2,}}', ' ', 'g') END AS v FROM k),
d AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM q) SELECT doc_id, coalesce(string_agg(v, chr(10) ORDER BY i) FILTER (before IS NULL OR v <> before), '') AS out FROM d GROUP BY doc_id""",
}
_SEPARATOR_CELLS = "list_transform(string_split(trim(trim(s), '|'), '|'), lambda c: CASE WHEN trim(c) LIKE ':%' AND trim(c) LIKE '%:' THEN ':---:' WHEN trim(c) LIKE '%:' THEN '---:' WHEN trim(c) LIKE ':%' THEN ':---' ELSE '---' END)"
_CLEAN_SQL = {
    "clean_invisible": r"regexp_replace(regexp_replace(t, '[\x{200b}\x{200c}\x{200d}\x{feff}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[\x{00a0}\x{3000}]', ' ', 'g')",
    "clean_front_matter": r"regexp_replace(t, '(?s)\A\s*---\n.*?\n---\s*\n', '')",
    "clean_rules": r"regexp_replace(t, '(?m)^\s*(?:-\s*(?:-\s*){2,}|\*\s*(?:\*\s*){2,}|_\s*(?:_\s*){2,})$', '', 'g')",
    "clean_table_sep": _lines_sql(None, rf"CASE WHEN regexp_full_match(s, '\|?[\s:.\-]+\|[\s|:.\-]+') THEN '| ' || array_to_string({_SEPARATOR_CELLS}, ' | ') || ' |' ELSE s END"),
    "clean_newlines": r"regexp_replace(t, '\r\n?', chr(10), 'g')",
    "clean_html_comment": r"regexp_replace(t, '(?s)<!--.*?-->', '', 'g')",
    "clean_html_tags": r"regexp_replace(t, '(?i)</?(div|span|font|center|p|br|strong|em|b|i|u|section|article)[^>]*>', '', 'g')",
    "clean_page_no": _lines_sql(rf"NOT (regexp_matches({_PY_STRIP}, '^[-–—]?\s*[0-9]{{1,4}}\s*[-–—]?$') OR regexp_matches({_PY_STRIP}, '(?i)^(第\s*)?[0-9]{{1,4}}\s*(页|/\s*[0-9]{{1,4}}|of\s+[0-9]{{1,4}})$') OR regexp_matches({_PY_STRIP}, '(?i)^Page\s+[0-9]{{1,4}}(\s*/\s*[0-9]{{1,4}})?$'))"),
    "clean_empty_row": _lines_sql(r"NOT regexp_matches(s, '^\s*\|(\s*\|)+\s*$')"),
    "clean_noise": _lines_sql(rf"NOT (regexp_full_match({_PY_STRIP}, '[·•\-\s]{{3,}}') OR regexp_full_match({_PY_STRIP}, '[.。·•]{{4,}}'))"),
    "clean_heading": _lines_sql(None, r"regexp_replace(s, '^(#{1,6})([^\s#])', '\1 \2')"),
    "clean_ul": _lines_sql(None, r"regexp_replace(s, '^\s*[*+]\s+', '- ')"),
    "clean_ol": _lines_sql(None, r"regexp_replace(s, '^([0-9]+)\.([^\s])', '\1. \2')"),
    "clean_squeeze": _lines_sql(None, r"CASE WHEN s LIKE '|%' OR s LIKE ' %' THEN s ELSE regexp_replace(s, '[ \t]{2,}', ' ', 'g') END"),
}


def _clean_query(rule):
    return lambda spark, d: noisy(spark, d).select("doc_id", F.md5(rule("text")).alias("digest"))


for _name, _rule in clean.RULES.items():
    _sql = None
    if _name in _CLEAN_SQL:
        _sql = f"SELECT doc_id, md5({_CLEAN_SQL[_name]}) AS digest FROM (SELECT doc_id, {_SQL_NOISY} AS t FROM documents)"
    elif _name in _CLEAN_LINES_SQL:
        _sql = f"WITH n AS (SELECT doc_id, {_SQL_NOISY} AS t FROM documents), r AS (WITH {_CLEAN_LINES_SQL[_name]}) SELECT doc_id, md5(out) AS digest FROM r"
    query(_sql, _name)(_clean_query(_rule))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)</?(div|span|font|center|p|br|strong|em|b|i|u|section|article)[^>]*>', '', 'g')) AS digest FROM pages")
def html_tags_of_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(clean.html_tags(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", ""))).alias("digest"))


# ---------------------------------------------------------------- chunks


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i, len(string_split(t, chr(10))) AS n FROM (SELECT doc_id, regexp_replace(text, '\n\z', '') AS t FROM documents WHERE text <> '')),
b AS (SELECT *, {_PY_STRIP} = '' AS blank, count(*) FILTER ({_PY_STRIP} = '') OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
p AS (SELECT doc_id, CAST(min(i) AS INTEGER) AS first, CAST(least(max(i) + 1, max(n)) AS INTEGER) AS last, string_agg(s, chr(10) ORDER BY i) AS s FROM b WHERE NOT blank GROUP BY doc_id, g)
SELECT doc_id, first, last, md5({_PY_STRIP}) AS digest FROM p""")
def chunk_text_units(spark, d):
    return chunk.text_units(table(spark, d, "documents"), "doc_id").select("doc_id", "first", "last", F.md5("text").alias("digest"))


def page_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("document_id"), clean.markdown(readers.parsed_html("html")).alias("text"))


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(page_documents(spark, d))


@query()
def chunk_markdown(spark, d):
    return page_chunks(spark, d).select("id", "type", "document_id", "order_index", "line_range", "parent_id", "child_ids", "title_path", "content_hash")


@query()
def enrich_build(spark, d):
    e = schema.require(enrich.enrich(page_chunks(spark, d)), "hybrid_chunk")
    return e.select("id", "document_id", "retrieval_role", "should_embed", "neighbor_chunk_ids", "related_ref_chunk_ids", "small_to_big_context_ids", F.md5("embedding_text").alias("digest"))


@query()
def chunk_type_counts(spark, d):
    return chunk.type_counts(page_chunks(spark, d))


@query()
def con_validate(spark, d):
    return schema.violations(enrich.enrich(page_chunks(spark, d)))


def table_documents(rows: DataFrame, document: Column, order: str, columns: list[str]) -> DataFrame:
    """(document_id, text): a Markdown table of the rows of each document, in order."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    one = rows.select(document.cast("string").alias("document_id"), order, line([F.col(c).cast("string") for c in columns]).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda r: r["line"]), "\n")
    head = F.concat(line([F.lit(c) for c in columns]), F.lit("\n"), line([F.lit("---")] * len(columns)), F.lit("\n"))
    return one.groupBy("document_id").agg(F.concat(head, body, F.lit("\n")).alias("text"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS name, string_agg('Row ' || n || ': n_nationkey: ' || n_nationkey || '; n_name: ' || n_name || '; n_regionkey: ' || n_regionkey, chr(10) ORDER BY n_nationkey) AS table_text
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation) GROUP BY n_regionkey""")
def chunk_md_table_text(spark, d):
    docs = table_documents(table(spark, d, "nation"), F.col("n_regionkey"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])
    return chunk.chunks(docs).where("type = 'table_chunk'").select(F.col("document_id").alias("name"), "table_text")


@query("""SELECT CAST(doc AS VARCHAR) AS document_id, CAST(part AS INTEGER) AS part, count(*) AS data_rows, CAST(min(s_suppkey) AS BIGINT) AS first_key, CAST(max(s_suppkey) AS BIGINT) AS last_key,
'Markdown table with ' || max(total) || ' data rows and 3 columns. Columns: s_suppkey, s_name, s_nationkey.' || CASE WHEN max(parts) > 1 THEN ' This is part ' || part || ' of ' || max(parts) || ', with ' || count(*) || ' data rows in this part.' ELSE '' END AS description
FROM (SELECT s_suppkey, s_suppkey // 100 AS doc, (row_number() OVER w - 1) // 30 + 1 AS part, count(*) OVER (PARTITION BY s_suppkey // 100) AS total, CAST(ceil(count(*) OVER (PARTITION BY s_suppkey // 100) / 30e0) AS BIGINT) AS parts FROM supplier WINDOW w AS (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey)) GROUP BY doc, part""")
def chunk_md_table_split(spark, d):
    docs = table_documents(table(spark, d, "supplier"), F.expr("s_suppkey div 100"), "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"])
    keys = F.transform(F.regexp_extract_all("table_text", F.lit(r"Row \d+: s_suppkey: (\d+);"), F.lit(1)), lambda k: k.cast("long"))
    t = chunk.chunks(docs).where("type = 'table_chunk'").withColumn("keys", keys)
    return t.select("document_id", F.col("table_part_index").alias("part"), F.size("keys").cast("long").alias("data_rows"), F.array_min("keys").alias("first_key"), F.array_max("keys").alias("last_key"), F.col("table_description").alias("description"))


@query()
def chunk_long_text(spark, d):
    """Windows of long texts: their number and the digest of the joined parts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parts = [chunk.split_long(t.as_py() or "") for t in b.column(1)]
            packed = [chunk.pack([(1, 1, p) for p in x]) for x in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in parts], pa.int64()), pa.array([max(map(len, p), default=0) for p in parts], pa.int64()), pa.array([len(p) for p in packed], pa.int64())], names=["doc_id", "parts", "longest", "packed"])

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, parts long, longest long, packed long")


@query("""SELECT conv_id, turn, coalesce(CAST(lag(turn) OVER w AS VARCHAR), '') AS previous, coalesce(CAST(lead(turn) OVER w AS VARCHAR), '') AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def enrich_neighbors(spark, d):
    n = enrich.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "turn")
    s = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), ",").alias(c)
    return n.select("conv_id", "turn", s("previous"), s("next"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter([conv_id || '-' || lag(turn) OVER w, conv_id || '-' || lead(turn) OVER w, 'conv-' || conv_id, CASE WHEN turn > 0 THEN conv_id || '-0' END], lambda x: x IS NOT NULL))), ',') AS context_ids FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def enrich_small_to_big(spark, d):
    """Turns as text chunks of a conversation, each with a reference to the first."""
    at = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    c = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.lit("").alias("document_version"), F.col("turn").alias("order_index"), at(F.col("turn")).alias("id"),
        F.lit("text_chunk").alias("type"), F.lit("chat").alias("document_name"), F.col("text").alias("content"), F.array("role").alias("title_path"), "conv_id", "turn",
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("parent_id"), F.when(F.col("turn") > 0, F.array(at(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("ref_target_ids"),
        F.array().cast("array<string>").alias("referenced_by_text_chunk_ids"), F.lit(None).cast("struct<parent_section_title_path:array<string>>").alias("parent_context"),
        *[F.lit(None).cast("string").alias(x) for x in ("title", "table_text", "table_description", "alt_text", "image_path")],
    )
    return enrich.enrich(c).select("conv_id", "turn", F.array_join("small_to_big_context_ids", ",").alias("context_ids"))


# ---------------------------------------------------------------- filters and access


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source = 'src1'")
def flt_where(spark, d):
    return table(spark, d, "documents").where(access.where(lang=["en", "de"], source=["src1"], doc_id=[])).select("doc_id")


_CONFIG = {
    "default_access": "deny", "levels": {"L1": 1, "L2": 2, "L3": 3, "L4": 4, "L5": 5},
    "knowledge_bases": [
        {"knowledge_base": "open", "required_level": "L1", "permission_code": "KB.OPEN", "document_names": ["src0", "src1", "src2"], "document_patterns": []},
        {"knowledge_base": "tens", "required_level": "L3", "permission_code": "KB.TENS", "document_names": [], "document_patterns": ["src1[0-4]"]},
        {"knowledge_base": "secret", "required_level": "L5", "permission_code": "KB.SECRET", "document_names": ["src5"], "document_patterns": ["src1*"]},
    ],
}
_JUDGED = """SELECT source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'open' WHEN regexp_full_match(source, 'src1[0-4]') THEN 'tens' WHEN source = 'src5' OR source LIKE 'src1%' THEN 'secret' END AS knowledge_base,
coalesce(source IN ('src0', 'src1', 'src2') OR regexp_full_match(source, 'src1[0-4]'), false) AS allowed FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    rules, levels, allow = access.load_rules(spark, _CONFIG)
    return access.judge(table(spark, d, "documents").select("source"), rules, levels, "3", allow, "source")


@query(_JUDGED)
def perm_find(spark, d):
    return judged(spark, d).select("source", "knowledge_base", "allowed")


@query(f"SELECT d.doc_id FROM documents d JOIN ({_JUDGED}) j USING (source) WHERE j.allowed AND d.lang = 'en'")
def perm_prefilter(spark, d):
    docs = table(spark, d, "documents")
    return access.prefilter(docs.where("lang = 'en'"), judged(spark, d), name="source").select("doc_id")


# ---------------------------------------------------------------- retrieval


def corpus(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    docs = docs.where(F.col("lang") == lang) if lang else docs
    return docs.select(F.col("doc_id").alias("id"), "source", "lang", "text", tx.tokenize("text").alias("tokens"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), tx.tokenize("text").alias("tokens"))


def sql_bm25(where: str = "true", top: int = 20) -> str:
    """CTEs that end in ``bm25(qid, id, bm25_score, rank)``."""
    return f"""c AS (SELECT doc_id AS id, {sql_tokens('text')} AS t FROM documents WHERE {where}), c1 AS (SELECT * FROM c WHERE len(t) > 0),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(t) AS DOUBLE)) AS al FROM c1), tok AS (SELECT id, len(t) AS l, unnest(t) AS token FROM c1),
tf AS (SELECT id, token, count(*) AS tf, any_value(l) AS l FROM tok GROUP BY id, token), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
qt AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({sql_tokens('text')}) AS token FROM benchmark) GROUP BY qid, token),
sc AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * l / al))), 6) AS bm25_score FROM qt JOIN tf USING (token) JOIN df USING (token), st GROUP BY qid, id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, id) AS rank FROM sc WHERE bm25_score > 0) WHERE rank <= {top})"""


def bm25(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    return retrieve.bm25_top(corpus(spark, d, lang), questions(spark, d))


def hit_texts(spark: SparkSession, d: str) -> DataFrame:
    """The BM25 hits of all questions with their texts and columns."""
    return retrieve.fetch(bm25(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang"))


@query(f"WITH {sql_bm25()} SELECT qid, id, bm25_score, rank FROM bm25")
def ret_bm25(spark, d):
    return bm25(spark, d).select("qid", "id", "bm25_score", "rank")


@query(f"WITH {sql_bm25()}, j AS ({_JUDGED}), h AS (SELECT b.qid, b.id, d.source, coalesce(j.allowed, false) AS allowed FROM bm25 b JOIN documents d ON d.doc_id = b.id LEFT JOIN j USING (source)) SELECT 'hit' AS kind, qid, id, source FROM h WHERE allowed UNION ALL SELECT DISTINCT 'denied', NULL, NULL, source FROM h WHERE NOT allowed")
def perm_postfilter(spark, d):
    """Hits that survive, and the names of the documents that were denied."""
    hits = retrieve.fetch(bm25(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"))
    kept, denied = access.postfilter(hits, judged(spark, d), "source")
    none = F.lit(None).cast("long")
    return kept.select(F.lit("hit").alias("kind"), "qid", "id", "source").union(denied.select(F.lit("denied"), none, none, "source"))


@query("WITH " + sql_bm25("lang = 'en'") + " SELECT qid, id, bm25_score, rank FROM bm25")
def ret_bm25_filtered(spark, d):
    return bm25(spark, d, "en").select("qid", "id", "bm25_score", "rank")


def sql_vector(where: str = "true", top: int = 12) -> str:
    return f"""vec AS (SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id AS id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9), e.vec_id) AS rank
FROM embeddings q, (SELECT * FROM embeddings WHERE {where}) e WHERE q.vec_id % 20 = 0) WHERE rank <= {top})"""


def near(spark: SparkSession, d: str, keep=None) -> DataFrame:
    """The queries are every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return retrieve.vector_top((e.where(keep) if keep is not None else e).select(F.col("vec_id").alias("id"), "embedding"), q)


# Distances of 0 come out as tiny numbers of either sign: + 0.0 and 6 digits make them equal.
_DIST = "round(distance, 6) + 0e0 AS distance"


@query(f"WITH {sql_vector()} SELECT qid, id, {_DIST}, rank FROM vec")
def ret_vector(spark, d):
    return near(spark, d).select("qid", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query("WITH " + sql_vector("label IN (1, 2, 3)") + f" SELECT qid, id, {_DIST}, rank FROM vec")
def ret_vector_filtered(spark, d):
    return near(spark, d, access.where(label=[1, 2, 3])).select("qid", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


_MERGED = f"""{sql_bm25()}, {sql_vector()}, m AS (SELECT coalesce(v.qid, b.qid) AS qid, coalesce(v.id, b.id) AS id, v.distance, CASE WHEN v.id IS NOT NULL THEN 1 - v.distance END AS vector_score, b.bm25_score,
CASE WHEN v.id IS NULL THEN 'bm25' WHEN b.id IS NULL THEN 'vector' ELSE 'vector,bm25' END AS sources FROM vec v FULL JOIN bm25 b ON v.qid = b.qid AND v.id = b.id),
merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance NULLS LAST, CASE WHEN sources LIKE 'vector%' THEN 0 ELSE 1 END, bm25_score DESC NULLS LAST, id) AS rank FROM m)"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.merge_hits(near(spark, d), bm25(spark, d))


@query(f"WITH {_MERGED} SELECT qid, id, {_DIST}, bm25_score, sources, rank FROM merged")
def ret_merge(spark, d):
    return merged(spark, d).select("qid", "id", (F.round("distance", 6) + 0.0).alias("distance"), "bm25_score", F.array_join("sources", ",").alias("sources"), "rank")


def _ranked_sql(pool: str = "true") -> str:
    """CTEs from ``merged`` to ``ranked``: features, score and new rank of the hits for which ``pool`` holds."""
    return f"""{_MERGED}, q AS (SELECT item_id AS qid, list_distinct({sql_tokens('text')}) AS qt FROM benchmark),
x AS (SELECT m.*, list_distinct({sql_tokens('d.text')}) AS tt, list_distinct({sql_tokens("d.source || ' ' || d.lang")}) AS ht, d.lang, q.qt FROM (SELECT * FROM merged WHERE {pool}) m JOIN documents d ON d.doc_id = m.id JOIN q ON q.qid = m.qid),
y AS (SELECT *, min(vector_score) OVER w AS vlo, max(vector_score) OVER w AS vhi, min(bm25_score) OVER w AS blo, max(bm25_score) OVER w AS bhi FROM x WINDOW w AS (PARTITION BY qid)),
z AS (SELECT *, CASE WHEN vector_score IS NULL THEN 0e0 WHEN vhi - vlo <= 1e-9 * greatest(abs(vhi), abs(vlo)) THEN 1e0 ELSE (vector_score - vlo) / (vhi - vlo) END AS vn,
CASE WHEN bm25_score IS NULL THEN 0e0 WHEN bhi - blo <= 1e-9 * greatest(abs(bhi), abs(blo)) THEN 1e0 ELSE (bm25_score - blo) / (bhi - blo) END AS bn FROM y),
f AS (SELECT *, vn * 44e-2 AS f1, bn * 26e-2 AS f2, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, tt)) / CAST(len(qt) AS DOUBLE) ELSE 0e0 END * 16e-2 AS f3, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ht)) / CAST(len(qt) AS DOUBLE) ELSE 0e0 END * 14e-2 AS f4, CASE WHEN sources LIKE '%,%' THEN 8e-2 ELSE 0e0 END AS f5 FROM z),
r AS (SELECT *, round(f1 + f2 + f3 + f4 + f5, 6) AS rerank_score FROM f),
ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank, id) AS rank FROM r)"""


_RANKED = _ranked_sql()


def _mmr_sql(k: int = 8) -> str:
    """CTEs that end in ``mmr(qid, id, mmr_rank, mmr_score)`` over ``ranked`` with rank <= 24: k greedy choices, one after the other."""
    out = """pool AS (SELECT qid, id, rank, rerank_score, tt FROM ranked WHERE rank <= 24),
sim AS (SELECT a.qid, a.rank, b.rank AS other, CASE WHEN len(a.tt) = 0 OR len(b.tt) = 0 THEN 0e0 ELSE len(list_intersect(a.tt, b.tt)) / CAST(len(a.tt) + len(b.tt) - len(list_intersect(a.tt, b.tt)) AS DOUBLE) END AS sim FROM pool a JOIN pool b ON a.qid = b.qid),
g0 AS (SELECT qid, rank, 0 AS n, 0e0 AS score FROM pool WHERE false)"""
    for n in range(1, k + 1):
        out += f""", g{n} AS (SELECT * FROM g{n - 1} UNION ALL SELECT qid, rank, {n}, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS p FROM
(SELECT p.qid, p.rank, round(72e-2 * p.rerank_score - (1e0 - 72e-2) * coalesce(max(s.sim), 0e0), 9) AS score FROM pool p LEFT JOIN (sim s JOIN g{n - 1} c ON c.qid = s.qid AND c.rank = s.other) ON s.qid = p.qid AND s.rank = p.rank
WHERE (p.qid, p.rank) NOT IN (SELECT (qid, rank) FROM g{n - 1}) GROUP BY p.qid, p.rank, p.rerank_score)) WHERE p = 1)"""
    return out + f", mmr AS (SELECT p.qid, p.id, CAST(c.n AS BIGINT) AS mmr_rank, round(c.score, 6) AS mmr_score FROM g{k} c JOIN pool p ON p.qid = c.qid AND p.rank = c.rank)"


def full_hits(spark: SparkSession, d: str) -> DataFrame:
    """The fused hits of all questions with the texts of the hits only, tokenised."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("kind"))
    q = questions(spark, d).select("qid", F.col("question").alias("query"), F.array_distinct("tokens").alias("query_tokens"))
    h = retrieve.fetch(merged(spark, d).join(q, "qid"), docs)
    return h.withColumn("tokens", tx.tokenize("text")).withColumn("title_tokens", tx.tokenize(F.concat_ws(" ", "source", "kind")))


@query(f"WITH {_RANKED} SELECT qid, id, rerank_score, rank FROM ranked")
def rank_rule(spark, d):
    return retrieve.rule_rerank(full_hits(spark, d)).select("qid", "id", "rerank_score", "rank")


@query(f"WITH {_RANKED}, {_mmr_sql()} SELECT * FROM mmr")
def rank_mmr(spark, d):
    r = retrieve.rule_rerank(full_hits(spark, d)).where(F.col("rank") <= 24).withColumn("token_set", F.array_distinct("tokens"))
    return retrieve.mmr(r)


_FEATURES = "[{'v': f1, 'i': -1, 'n': 'vector'}, {'v': f2, 'i': -2, 'n': 'bm25'}, {'v': f3, 'i': -3, 'n': 'lexical'}, {'v': f4, 'i': -4, 'n': 'title_path'}, {'v': f5, 'i': -5, 'n': 'multi_source'}]"
_REASON = f"array_to_string(list_transform(list_slice(list_reverse_sort(list_filter({_FEATURES}, lambda s: s.v > 0)), 1, 3), lambda s: s.n || '=' || printf('%.3f', s.v)), '；')"


@query(f"WITH {_ranked_sql('rank <= 24')}, {_mmr_sql()} SELECT m.qid, m.id, m.mmr_rank AS rank, r.rerank_score, {_REASON} AS rerank_reason, m.mmr_score FROM mmr m JOIN ranked r ON r.qid = m.qid AND r.id = m.id")
def rank_second_stage(spark, d):
    return retrieve.second_stage(full_hits(spark, d)).select("qid", "id", "rank", "rerank_score", "rerank_reason", "mmr_score")


_HITS = "SELECT l_orderkey // 100 AS qid, 'l' || l_orderkey || '-' || l_linenumber AS id, 3 AS level, 'o' || l_orderkey AS parent_id, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem"


def leaf_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every leaf as a hit, a question for each hundred order keys, and the parents."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    li = table(spark, d, "lineitem").withColumn("qid", F.expr("l_orderkey div 100"))
    w = Window.partitionBy("qid").orderBy("l_orderkey", "l_linenumber")
    hits = li.select("qid", F.concat(key("l", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), F.lit(3).alias("level"), key("o", "l_orderkey").alias("parent_id"), F.col("l_extendedprice").alias("score"), F.row_number().over(w).cast("long").alias("rank"))
    o = table(spark, d, "orders").select(key("o", "o_orderkey").alias("id"), F.lit(2).alias("level"), key("c", "o_custkey").alias("parent_id"))
    c = table(spark, d, "customer").select(key("c", "c_custkey").alias("id"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"))
    return hits, o.union(c)


def _merge_sql(hits: str, parents: str, level: int) -> str:
    """One step of merging: hits (qid, id, level, parent_id, score, rank, merged_children), parents (own, grand)."""
    up = f"h.level = {level + 1} AND n >= 2 AND p.own IS NOT NULL"
    return f"""SELECT qid, id, level, any_value(parent_id) AS parent_id, max(score) AS score, min(rank) AS rank, max(mc) AS merged_children FROM (SELECT h.qid, CASE WHEN {up} THEN h.parent_id ELSE h.id END AS id, CASE WHEN {up} THEN {level} ELSE h.level END AS level,
CASE WHEN {up} THEN p.grand ELSE h.parent_id END AS parent_id, score, rank, CASE WHEN {up} THEN n ELSE merged_children END AS mc FROM (SELECT *, count(*) FILTER (level = {level + 1}) OVER (PARTITION BY qid, parent_id) AS n FROM {hits}) h LEFT JOIN ({parents}) p ON p.own = h.parent_id) GROUP BY qid, id, level"""


_STEP2 = _merge_sql(f"(SELECT *, 0 AS merged_children FROM ({_HITS}))", "SELECT 'o' || o_orderkey AS own, 'c' || o_custkey AS grand FROM orders", 2)
_STEP1 = _merge_sql("s2", "SELECT 'c' || c_custkey AS own, CAST(NULL AS VARCHAR) AS grand FROM customer", 1)
_MERGED_COLUMNS = "qid, id, CAST(level AS INTEGER) AS level, score, rank, CAST(merged_children AS BIGINT) AS merged_children"


@query(f"SELECT {_MERGED_COLUMNS} FROM ({_STEP2})")
def ret_automerge_step(spark, d):
    hits, parents = leaf_hits(spark, d)
    return retrieve.merge_to_parents(hits, parents, 2).select("qid", "id", "level", "score", "rank", "merged_children")


@query(f"WITH s2 AS ({_STEP2}), s1 AS ({_STEP1}) SELECT {_MERGED_COLUMNS} FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, level, id) AS rank FROM s1) WHERE rank <= 8")
def ret_automerge(spark, d):
    hits, parents = leaf_hits(spark, d)
    return retrieve.auto_merge(hits, parents).select("qid", "id", "level", "score", "rank", "merged_children")


# ---------------------------------------------------------------- index and BM25 state

_OLD = "SELECT doc_id, source, md5(text) AS v FROM documents WHERE doc_id % 10 <> 3"
_NEW = "SELECT doc_id, source, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS v FROM documents WHERE doc_id % 2 = 0 AND source <> 'src0'"
_IDX = f"o AS (SELECT CAST(doc_id AS VARCHAR) || '::' || v AS id, source AS document_id FROM ({_OLD})), r AS (SELECT CAST(doc_id AS VARCHAR) || '::' || v AS id, source AS document_id FROM ({_NEW}))"
_UNTOUCHED = "SELECT id, document_id, 'kept' AS change FROM o WHERE document_id NOT IN (SELECT document_id FROM r)"
_REPLACED = f"WITH {_IDX} {_UNTOUCHED} UNION ALL SELECT id, document_id, CASE WHEN id IN (SELECT id FROM o) THEN 'replaced' ELSE 'inserted' END FROM r"
_SYNC_SQL = {
    "chunk": f"WITH {_IDX} {_UNTOUCHED} UNION ALL SELECT id, document_id, 'kept' FROM o WHERE id IN (SELECT id FROM r) UNION ALL SELECT id, document_id, 'inserted' FROM r WHERE id NOT IN (SELECT id FROM o)",
    "incremental": f"WITH {_IDX} SELECT id, document_id, 'kept' AS change FROM o UNION ALL SELECT id, document_id, 'inserted' FROM r WHERE id NOT IN (SELECT id FROM o)",
    "strict": _REPLACED, "force": _REPLACED,
}


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    rows = lambda f, t: f.select(F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.md5(t)).alias("id"), F.col("source").alias("document_id"))
    new = docs.where("doc_id % 2 = 0 and source <> 'src0'")
    return rows(docs.where("doc_id % 10 <> 3"), F.col("text")), rows(new, F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


for _mode, _sql in _SYNC_SQL.items():
    query(_sql, f"idx_upsert_{_mode}")(lambda spark, d, m=_mode: ix.sync(*versions(spark, d), m))


@query(f"WITH {_IDX} SELECT id, document_id FROM o WHERE document_id IN (SELECT document_id FROM r)")
def idx_prune(spark, d):
    old, new = versions(spark, d)
    return ix.prune(old, new)


@query(f"WITH {_IDX} SELECT id, document_id FROM o WHERE document_id NOT IN ('src3', 'src4')")
def idx_delete_by(spark, d):
    return ix.delete(versions(spark, d)[0], ids=["src3", "src4"])


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def src_parse_cache(spark, d):
    docs = table(spark, d, "documents")
    parsed = docs.where("doc_id % 3 = 0").select(tx.content_hash("text").alias("cache_key"))
    return ix.new_inputs(docs.where("doc_id % 3 <> 0"), parsed, "text").select("doc_id")


_STATE = f"d AS (SELECT doc_id, lang, {sql_tokens('text')} AS t FROM documents)"


def half(spark: SparkSession, d: str, rest: int) -> DataFrame:
    """One of two complementary parts of the documents."""
    return table(spark, d, "documents").where(F.col("doc_id") % 2 == rest)


@query(f"WITH {_STATE}, x AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM d) GROUP BY token) SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx, df FROM x")
def bm25_state(spark, d):
    return ix.state_of(table(spark, d, "documents"))[0]


@query(f"""WITH {_STATE}, x AS (SELECT k, token, count(*) AS df FROM (SELECT doc_id % 2 AS k, unnest(list_distinct(t)) AS token FROM d) GROUP BY k, token),
a AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx, df FROM x WHERE k = 0), b AS (SELECT token, df FROM x WHERE k = 1), n AS (SELECT token, df, (SELECT max(idx) FROM a) + row_number() OVER (ORDER BY token) AS idx FROM b WHERE token NOT IN (SELECT token FROM a))
SELECT a.token, a.idx, CAST(a.df + coalesce(b.df, 0) AS BIGINT) AS df FROM a LEFT JOIN b USING (token) UNION ALL SELECT token, idx, df FROM n""")
def bm25_add(spark, d):
    return ix.state_add(*ix.state_of(half(spark, d, 0)), half(spark, d, 1))[0]


@query(f"""WITH {_STATE}, x AS (SELECT token, count(*) AS df, count(*) FILTER (doc_id % 2 = 0) AS gone FROM (SELECT doc_id, unnest(list_distinct(t)) AS token FROM d) GROUP BY token)
SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx, df - gone AS df FROM x""")
def bm25_remove(spark, d):
    return ix.state_add(*ix.state_of(table(spark, d, "documents")), half(spark, d, 0), sign=-1)[0]


@query(f"""WITH {_STATE}, n AS (SELECT count(*) AS docs, coalesce(sum(len(t)), 0) AS len FROM d)
SELECT 1 AS version, docs, CAST(len AS BIGINT) AS len, round(CASE WHEN docs > 0 THEN len / CAST(docs AS DOUBLE) ELSE 1e0 END, 2) AS avg_len, (SELECT count(DISTINCT token) FROM (SELECT unnest(t) AS token FROM d)) AS vocabulary, (SELECT count(DISTINCT token) FROM (SELECT unnest(t) AS token FROM d)) AS seen FROM n""")
def bm25_persist(spark, d):
    """The state of all documents saved, loaded again and summed up."""
    path = f"{root(spark)}/bm25-state"
    ix.save_state(*ix.state_of(table(spark, d, "documents")), path)
    return ix.state_stats(*ix.load_state(spark, path))


_WEIGHTS = f"""{_STATE}, wst AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(t)) AS DOUBLE) / count(*) AS al FROM d),
wdf AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS idx, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM d) GROUP BY token),
wtf AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM d) GROUP BY doc_id, token),
w AS (SELECT doc_id, token, idx, round(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * l / al)), 6) AS weight FROM wtf JOIN wdf USING (token), wst)"""


@query(f"WITH {_WEIGHTS} SELECT doc_id, idx, weight FROM w WHERE weight > 0")
def ret_sparse_vec(spark, d):
    docs = table(spark, d, "documents")
    return ix.sparse_vectors(docs, *ix.state_of(docs), item="doc_id").select("doc_id", F.explode("vector").alias("idx", "weight"))


@query(f"""WITH {sql_bm25()}, {_WEIGHTS}, q AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({sql_tokens('text')}) AS token FROM benchmark) GROUP BY qid, token)
SELECT p.qid, p.id, coalesce(CAST(sum(CAST(qtf AS DECIMAL(9,0)) * CAST(weight AS DECIMAL(18,6))) AS DOUBLE), 0e0) AS state_score FROM bm25 p JOIN q ON q.qid = p.qid LEFT JOIN w ON w.doc_id = p.id AND w.weight > 0 AND w.token = q.token GROUP BY p.qid, p.id""")
def ret_rescore(spark, d):
    """The BM25 hits of all questions, scored again by the statistics of the state."""
    docs = table(spark, d, "documents")
    hits = retrieve.fetch(bm25(spark, d), docs.select(F.col("doc_id").alias("id"), "text")).select("qid", "id", "text")
    return ix.rescore(hits, questions(spark, d), *ix.state_of(docs))


# ---------------------------------------------------------------- evaluation

_EXPECTED = "ex AS (SELECT b.item_id AS qid, 'c' || b.item_id % 4 AS category, d.doc_id FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text))"


def expected(spark: SparkSession, d: str) -> DataFrame:
    """Cases: the documents that hold the question's text.

    A word with white space or punctuation on both sides inside the question is a word of every text that holds it: the
    longest such word joins, and the whole question is looked for in what it finds. Questions without such a word, short by
    nature, are looked for in every document.
    """
    cut = r"[ \n.,]+"
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    pieces = F.split("q", cut)
    inner = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = b.where("q is not null").withColumn("w", longest)
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", cut))).alias("w")).join(retrieve.checked_broadcast(keyed.where("w is not null").select("w").distinct()), "w", "left_semi").join(keyed, "w")
    found = retrieve.fetch(found.select("doc_id", "qid", "q"), docs, "doc_id").where(F.contains("text", F.col("q"))).select("qid", "doc_id")
    short = retrieve.checked_broadcast(keyed.where("w is null").select("qid", "q"))
    found = found.union(docs.join(short, F.contains("text", F.col("q"))).select("qid", "doc_id")).distinct()
    g = found.groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("documents"))
    return b.join(g, "qid", "left").select("qid", F.concat(F.lit("c"), (F.col("qid") % 4).cast("string")).alias("category"), F.coalesce("documents", F.array().cast("array<bigint>")).alias("documents"))


def _per_k(expr: str) -> str:
    return ", ".join(expr.format(k=k) for k in evaluate.K_VALUES)


_CASES = f"""{sql_bm25()}, {_EXPECTED}, f AS (SELECT ex.qid, any_value(category) AS category, count(DISTINCT ex.doc_id) AS n, min(rank) AS first_rank, {_per_k('count(*) FILTER (rank <= {k}) AS n_{k}')}
FROM ex LEFT JOIN bm25 b ON b.qid = ex.qid AND b.id = ex.doc_id GROUP BY ex.qid),
cases AS (SELECT qid, category, first_rank, round(coalesce(1e0 / first_rank, 0e0), 6) AS mrr, {_per_k('n_{k} > 0 AS doc_hit_{k}, round(CASE WHEN n > 0 THEN n_{k} / CAST(n AS DOUBLE) ELSE 0e0 END, 6) AS doc_recall_{k}')} FROM f)"""


def case_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cases(bm25(spark, d).select("qid", "rank", F.col("id").alias("document")), expected(spark, d))


@query(f"WITH {_CASES} SELECT * FROM cases")
def ev_case(spark, d):
    return case_rows(spark, d)


_MEANS = "round(avg(mrr), 6) AS mrr, " + _per_k("round(avg(CAST(doc_hit_{k} AS INTEGER)), 6) AS doc_hit_{k}, round(avg(doc_recall_{k}), 6) AS doc_recall_{k}")


@query(f"WITH {_CASES} SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS cases, {_MEANS} FROM cases GROUP BY GROUPING SETS ((), (category))")
def eval_by_category(spark, d):
    return evaluate.by_category(case_rows(spark, d))


@query(f"""WITH {sql_bm25()}, k AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 6))) AS w FROM benchmark),
r AS (SELECT k.qid, k.w, min(b.rank) AS rank FROM k JOIN bm25 b USING (qid) JOIN documents d ON d.doc_id = b.id WHERE contains(lower(d.text), k.w) GROUP BY k.qid, k.w),
n AS (SELECT qid, count(*) AS n FROM k GROUP BY qid) SELECT b.item_id AS qid, {_per_k('round(CASE WHEN coalesce(n.n, 0) > 0 THEN (SELECT count(*) FROM r WHERE r.qid = b.item_id AND r.rank <= {k}) / CAST(n.n AS DOUBLE) ELSE 0e0 END, 6) AS keyword_recall_{k}')} FROM benchmark b LEFT JOIN n ON n.qid = b.item_id""")
def ev_kw_recall(spark, d):
    ex = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) > 6).alias("keywords"))
    return evaluate.keyword_recall(hit_texts(spark, d), ex)


@query(f"WITH {_CASES} SELECT m AS metric, round(avg(v), 4) AS mean, round(min(v), 4) AS min, round(max(v), 4) AS max, count(v) AS count, count(*) - count(v) AS errors FROM (SELECT 'mrr' AS m, mrr AS v FROM cases UNION ALL SELECT 'doc_recall_5', doc_recall_5 FROM cases UNION ALL SELECT 'first_rank', CAST(first_rank AS DOUBLE) FROM cases) GROUP BY m")
def ev_batch(spark, d):
    return evaluate.summary(case_rows(spark, d), ["mrr", "doc_recall_5", "first_rank"])


@query(f"WITH {_RANKED} SELECT qid, count(*) FILTER (rerank_score > 3e-1 OR coalesce(bm25_score, 0) > 0) AS relevant, count(*) AS hits FROM ranked GROUP BY qid")
def ev_grade_count(spark, d):
    return evaluate.relevant_count(retrieve.rule_rerank(full_hits(spark, d)))


@query("SELECT l.quality, l.toxic, count(*) AS docs, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality, l.toxic")
def label_counts(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT DISTINCT source AS document_name FROM documents WHERE source IS NOT NULL")
def src_docs_available(spark, d):
    return readers.document_names(table(spark, d, "documents").withColumnRenamed("source", "document_name"))


_KINDS = {"section_chunk": "es", "text_chunk": "en", "table_chunk": "de", "image_chunk": "fr"}
_KIND_COUNTS = ", ".join(f"count(*) FILTER (lang = '{v}') AS {k}" for k, v in _KINDS.items())


@query(f"SELECT source AS document_id, count(*) AS chunk_count, {_KIND_COUNTS}, count(*) FILTER (lang <> 'es') AS embed_count FROM documents GROUP BY source")
def snk_hybrid(spark, d):
    """The summary of hybrid chunks; documents stand for chunks whose type depends on the language."""
    kind = F.coalesce(*[F.when(F.col("lang") == v, F.lit(k)) for k, v in _KINDS.items()])
    docs = table(spark, d, "documents").select(F.col("source").alias("document_id"), kind.alias("type"))
    return chunk.summary(docs.withColumn("should_embed", F.col("type") != "section_chunk"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS d, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%g+08:00') AS ts FROM events")
def snk_log(spark, d):
    return readers.log_rows(table(spark, d, "events"), "events").select("event_id", "d", "ts")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def log_windows(spark, d):
    return event_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast(table(spark, d, "events").schema["ts"].dataType))


# ---------------------------------------------------------------- context, prompts, understanding, whole runs


def small_run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    keep = keeper(spark)
    chunks = keep(enrich.enrich(page_chunks(spark, d)), "chunks")
    return keep(pipelines.to_index(chunks, pipelines.Settings()), "index"), chunks


def page_questions(spark: SparkSession, d: str) -> DataFrame:
    p = page_documents(spark, d).select(F.col("document_id").alias("qid"), F.element_at(F.filter(F.split("text", "\n"), lambda s: F.length(s) > 10), 1).alias("question"))
    return p.where("question is not null")


def _strip_sql(x: str) -> str:
    return _PY_STRIP.replace("(s,", f"({x},", 1)


_BLOCKS = rf"""{sql_bm25()}, b AS (SELECT qid, id, rank, bm25_score + 12e-2 AS score, u, CASE WHEN length(u) > 1800 THEN regexp_replace(substr(u, 1, 1800), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '') || chr(10) || '...[TRUNCATED ' || (length(u) - 1800) || ' chars]' ELSE u END AS block
FROM (SELECT b.qid, b.id, b.rank, b.bm25_score, {_strip_sql('d.text')} AS u FROM bm25 b JOIN documents d ON d.doc_id = b.id) WHERE u <> ''),
o AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(block)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b WINDOW w AS (PARTITION BY qid ORDER BY round(score, 9) DESC, rank, CAST(id AS VARCHAR))),
fit AS (SELECT *, CASE WHEN length(block) <= 12000 - used THEN length(block) ELSE length(regexp_replace(substr(block, 1, CAST(12000 - used AS BIGINT)), '[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '') || chr(10) || '...[TRUNCATED ' || (length(block) - CAST(12000 - used AS BIGINT)) || ' chars]') END AS chars FROM o WHERE n <= 12 AND (used + length(block) <= 12000 OR 12000 - used > 200))"""


@query(f"WITH {_BLOCKS} SELECT qid, n AS citation_no, 'C' || n AS citation_id, CAST(id AS VARCHAR) AS id, round(score, 6) AS score, CAST(chars AS INTEGER) AS chars FROM fit")
def ctx_compress(spark, d):
    item = F.struct(F.lit(1).alias("place"), F.col("id").cast("string").alias("id"), F.lit("text_chunk").alias("type"), F.lit("hit").alias("role"), F.col("text").alias("content"), F.array("lang").alias("title_path"), F.struct(F.lit(1).alias("start"), F.lit(1).alias("end")).alias("line_range"), F.lit("").alias("table_text"), F.lit("").alias("table_description"), F.col("id").cast("string").alias("document_id"), F.col("source").alias("document_name"))
    blocks = context.compress(context.candidates(hit_texts(spark, d).select("qid", "rank", F.col("bm25_score").alias("score"), F.array(item).alias("context"))))
    return blocks.select("qid", "citation_no", "citation_id", "id", F.round("score", 6).alias("score"), F.length("content").alias("chars"))


@query(f"""WITH {sql_bm25(top=3)}, x AS (SELECT b.qid, string_agg('[C' || b.rank || '] 文档: ' || coalesce(d.source, '') || '; 章节: ' || coalesce(d.lang, '') || '; 类型: text_chunk; 行号: [1, 1]' || chr(10) || d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY b.rank) AS context FROM bm25 b JOIN documents d ON d.doc_id = b.id GROUP BY b.qid)
SELECT item_id AS qid, '【用户问题】' || chr(10) || text || chr(10) || chr(10) || '【检索上下文】' || chr(10) || coalesce(context, '未检索到可用上下文。') || chr(10) || chr(10) ||
'【输出要求】' || chr(10) || '- 先给出直接答案。' || chr(10) || '- 再列出依据，引用 [C1] 这样的证据编号。' || chr(10) || '- 如果依据不足，说明缺失哪些资料。' AS prompt FROM benchmark LEFT JOIN x ON x.qid = item_id""")
def prm_build(spark, d):
    """Prompts with the whole texts of the first three hits of each question."""
    blocks = hit_texts(spark, d).where("rank <= 3").select("qid", F.col("rank").alias("citation_no"), F.concat(F.lit("C"), F.col("rank").cast("string")).alias("citation_id"), F.lit("text_chunk").alias("chunk_type"), F.col("id").alias("document_id"), "id", F.col("source").alias("document_name"), F.array("lang").alias("title_path"), F.struct(F.lit(1).alias("start"), F.lit(1).alias("end")).alias("line_range"), F.col("text").alias("content"))
    return context.prompts(questions(spark, d).select("qid", "question"), blocks).select("qid", F.col("messages")[1]["content"].alias("prompt"))


@query()
def qu_prepare(spark, d):
    q = questions(spark, d).select("qid", "question")
    return pipelines.understood(q, pipelines.Settings()).select("qid", "query_texts", "keyword_texts", "want_documents", "want_types", "route.needs_retrieval")


@query()
def qu_grade(spark, d):
    return understand.grade(questions(spark, d).select("qid", "question"), hit_texts(spark, d), RuleChat())


@query()
def qu_expand(spark, d):
    return understand.expand_queries(questions(spark, d).select("qid", "question"), RuleChat())


@query()
def ev_faithfulness(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("question"), F.max_by("text", "turn").alias("answer"), F.collect_list("text").alias("contexts"))
    return understand.faithfulness(c, RuleChat()).join(understand.relevancy(c, RuleChat(), HashedEmbedder()), "qid", "left")


@query()
def pl_standard(spark, d):
    index, chunks = small_run(spark, d)
    return pipelines.ask(index, chunks, page_questions(spark, d), keep=keeper(spark), messages=False).select("qid", "question", "status", "answer", "citations")


@query()
def pl_enhanced(spark, d):
    """The enhanced run over all pages: up to two more rounds, rescoring, merging, answers and their evaluation."""
    keep = keeper(spark)
    index, chunks = small_run(spark, d)
    state, corpus = ix.state_of(index, "document")
    state = keep(state, "state"), keep(corpus, "corpus")
    return pipelines.ask_enhanced(index, chunks, page_questions(spark, d), keep, state=state)


@query("SELECT stage, event, status FROM (VALUES ('one', 'stage_start', NULL), ('one', 'stage_end', 'ok'), ('two', 'stage_start', NULL), ('two', 'stage_error', 'error')) t(stage, event, status)")
def pl_log(spark, d):
    """Events of a stage that ends and one that fails."""
    log = StageLog("demo")
    with log.stage("one") as counted:
        counted["documents"] = table(spark, d, "documents").count()
    try:
        with log.stage("two"):
            raise ValueError("planned")
    except ValueError:
        pass
    return log.frame(spark).select("stage", "event", "status")


@query(f"WITH {_MERGED} SELECT qid, count(*) AS hit_count, count(*) FILTER (sources LIKE 'vector%') AS vector_hits, count(*) FILTER (sources LIKE '%bm25') AS bm25_hits, CAST(0 AS BIGINT) AS merged_hits, CAST(0 AS BIGINT) AS rescored_hits FROM merged GROUP BY qid")
def rep_stage_metrics(spark, d):
    return hit_metrics(merged(spark, d))


@query("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(lang, '') AS chunk_type, coalesce(source, '') AS document_name, '[\"' || coalesce(lang, '') || '\",\"x\"]' AS title_path, sha256(text) AS content_hash, 'markdown_hybrid' AS chunk_strategy FROM documents")
def fn_build_metadata(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("type"), F.col("source").alias("document_name"), F.array(F.coalesce("lang", F.lit("")), F.lit("x")).alias("title_path"), tx.content_hash("text").alias("content_hash"))
    return ix.metadata(docs).select("chunk_id", "chunk_type", "document_name", "title_path", "content_hash", "chunk_strategy")


@query("SELECT event_id, lower(array_to_string(list_transform(json_keys(props), lambda k: k || ' ' || json_extract_string(props, '$.' || k)), ' ')) AS said FROM events")
def fn_normalize_text(spark, d):
    return table(spark, d, "events").select("event_id", tx.normalize_json_text("props").alias("said"))


@query(f"WITH j AS ({_JUDGED}), r AS (SELECT doc_id, unnest([source, 'src5', source, 'nowhere']) AS s, unnest([1, 2, 3, 4]) AS p FROM documents), o AS (SELECT doc_id, s, min(p) AS p FROM r WHERE s IS NOT NULL GROUP BY doc_id, s), k AS (SELECT o.*, coalesce(j.allowed, false) AS allowed FROM o LEFT JOIN j ON j.source = o.s) SELECT doc_id, coalesce(string_agg(s, ',' ORDER BY p) FILTER (allowed), '') AS allowed, coalesce(string_agg(s, ',' ORDER BY p) FILTER (NOT allowed), '') AS denied FROM k GROUP BY doc_id")
def perm_split(spark, d):
    asked = table(spark, d, "documents").select("doc_id", F.array_compact(F.array("source", F.lit("src5"), "source", F.lit("nowhere"))).alias("names"))
    s = access.split_names(asked, judged(spark, d), qid="doc_id", names="names", name="source")
    return s.select("doc_id", F.array_join("allowed", ",").alias("allowed"), F.array_join("denied", ",").alias("denied"))


@query("SELECT 'L3' AS permission_level, 3 AS permission_rank, 'open,tens' AS allowed_bases, 'secret' AS denied_bases, 'KB.OPEN,KB.TENS' AS codes, 'src0,src1,src2' AS names")
def perm_context(spark, d):
    rules, levels, allow = access.load_rules(spark, _CONFIG)
    c = access.context(rules, levels, "3", allow)
    j = lambda c, n: F.array_join(c, ",").alias(n)
    return c.select("permission_level", "permission_rank", j("allowed_knowledge_bases", "allowed_bases"), j("denied_knowledge_bases", "denied_bases"), j("allowed_permission_codes", "codes"), j("allowed_document_names", "names"))


@query(f"WITH {sql_bm25()}, w AS (SELECT item_id AS qid, item_id * 7 % 50 AS id FROM benchmark WHERE item_id % 3 > 0), h AS (SELECT w.qid, min(b.rank) AS r FROM w LEFT JOIN bm25 b ON b.qid = w.qid AND b.id = w.id GROUP BY w.qid) SELECT b.item_id AS qid, {{ks}} FROM benchmark b LEFT JOIN h ON h.qid = b.item_id LEFT JOIN w ON w.qid = b.item_id".replace("{ks}", ", ".join(f"CASE WHEN w.qid IS NOT NULL THEN coalesce(h.r <= {k}, false) END AS chunk_hit_{k}" for k in evaluate.K_VALUES)))
def ev_chunk_hit(spark, d):
    labelled = questions(spark, d).select("qid", F.when(F.col("qid") % 3 > 0, F.array((F.col("qid") * 7 % 50))).otherwise(F.array().cast("array<bigint>")).alias("chunks"))
    return evaluate.chunk_hit(bm25(spark, d).withColumnRenamed("id", "chunk_id"), labelled)


@query("SELECT source AS document_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source")
def idx_ids_by_doc(spark, d):
    g = ix.ids_by_document(table(spark, d, "documents"), "doc_id", "source")
    return g.select(F.col("source").alias("document_id"), F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"))


@query(f"WITH {_IDX} SELECT r.id FROM r WHERE r.id IN (SELECT id FROM o)")
def idx_existing(spark, d):
    return ix.existing(*versions(spark, d)).select("id")


@query()
def pl_ingest(spark, d):
    return small_run(spark, d)[0].select("id", "chunk_id", "document_id", "kind", F.size("tokens").alias("n_tokens"), F.size("embedding").alias("width"))
