"""Text, array, score and JSON functions as Column expressions: they stay inside code generation and need no Python workers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, Window, functions as F

#: The words of a question that show an interest in tables.
TABLE_TERMS = ("表", "表格", "价格", "金额", "预算", "薪酬", "等级", "比例", "字段", "清单", "模板")
#: Fixed value: the bullet that stands for no claim at all.
NO_CLAIM = "无声明"


#: Fixed value: the characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any script at both ends (``trim`` alone knows only the space)."""
    return F.trim(_c(x), F.lit(WHITE))


def tokenize(x: Column | str) -> Column:
    """Lower-cased ASCII words, then the CJK characters, then the bigrams of the CJK characters run together."""
    t = F.lower(F.coalesce(_c(x), F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"([a-z0-9_]+)"), F.lit(1))
    han = F.regexp_extract_all(t, F.lit(r"([\x{4e00}-\x{9fff}])"), F.lit(1))
    n = F.greatest(F.size(han) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(han, F.lit(1), n), F.slice(han, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.when(t.rlike(r"[\x{4e00}-\x{9fff}]"), F.concat(words, han, pairs)).otherwise(words)  # most texts have no CJK: one pass less each


def token_set(x: Column | str) -> Column:
    return F.array_distinct(tokenize(x))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all elements of two arrays seen as sets; 0 if either is empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    some = (F.size(_c(a)) > 0) & (F.size(_c(b)) > 0)
    return F.when(some, F.size(F.array_intersect(_c(a), _c(b))) / union).otherwise(F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    a, b = _c(a), _c(b)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))


def distance_score(distance: Column | str) -> Column:
    return F.lit(1.0) - _c(distance)


def min_max(x: Column | str, by: Sequence[str]) -> Column:
    """Scaled to 0..1 within each group; null counts as 0, a group of one value as 1."""
    w = Window.partitionBy(*by)
    x = _c(x)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    same = F.abs(hi - lo) <= F.lit(1e-9) * F.greatest(F.abs(hi), F.abs(lo))
    return F.when(x.isNull(), F.lit(0.0)).when(same, F.lit(1.0)).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))


def unique_keep_order(values: Column | str) -> Column:
    """Trimmed, without empty strings; of equal ones the first stays."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(_c(values), F.array().cast("array<string>")), strip), lambda v: v != ""))


def normalize_list(value: Column | str) -> Column:
    """Non-blank strings of an array; null gives an empty array."""
    return F.filter(F.coalesce(_c(value), F.array().cast("array<string>")), lambda v: v.isNotNull() & (strip(v) != ""))


def parse_json(x: Column | str, schema: str, default: Column | None = None) -> Column:
    """A typed value from JSON text; null, empty and malformed text give the default (null if there is none)."""
    sound = F.when(F.try_parse_json(_c(x)).isNotNull(), _c(x))
    parsed = F.when(sound.isNotNull(), F.from_json(sound, schema, {"mode": "PERMISSIVE"}))
    return parsed if default is None else F.coalesce(parsed, default)


def first_json_object(x: Column | str) -> Column:
    """The widest brace-enclosed part of a reply, null if there is none."""
    return F.nullif(F.regexp_extract(_c(x), r"(?s)\{.*\}", 0), F.lit(""))


def hit_text(name: Column | str, title_path: Column | str, document: Column | str) -> Column:
    """Name, title path and text, each on a line."""
    return F.concat_ws("\n", F.coalesce(_c(name), F.lit("")), F.concat_ws(" ", _c(title_path)), F.coalesce(_c(document), F.lit("")))


def _marked(n: Column) -> Column:
    return F.concat(F.lit("...[TRUNCATED "), n.cast("string"), F.lit(" chars]"))


def truncate(x: Column | str, limit: int) -> Column:
    """Cut after ``limit`` characters with a note of how many are gone."""
    x = _c(x)
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), _marked(F.length(x) - limit))).otherwise(x)


def truncate_block(x: Column | str, limit: Column | int) -> Column:
    """Stripped, cut, and the note on a line of its own."""
    x = strip(_c(x))
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.regexp_replace(F.substring(x, F.lit(1), limit), r"(?U)\s+$", "")
    return F.when(F.length(x) > limit, F.concat(cut, F.lit("\n"), _marked(F.length(x) - limit))).otherwise(x)


def table_intent(x: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_c(x), F.lit(t)) for t in TABLE_TERMS])


def line_range(x: Column | str) -> Column:
    """Arrays of two as they are, anything else empty."""
    return F.when(F.size(_c(x)) == 2, _c(x)).otherwise(F.array().cast("array<int>"))


def content_hash(x: Column | str) -> Column:
    return F.sha2(F.coalesce(_c(x), F.lit("")).cast("binary"), 256)


def index_id(document_id: Column, kind: Column, start: Column, end: Column, digest: Column) -> Column:
    """A stable id of a chunk: document, kind, lines and the start of its digest."""
    return F.concat_ws("::", document_id, kind, F.concat_ws("-", start.cast("string"), end.cast("string")), F.substring(digest, 1, 16))


def safe_name(x: Column | str) -> Column:
    """A file name without characters that paths can't have; ``document`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(_c(x), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit("document"))


def document_name(directory: Column | str) -> Column:
    return F.regexp_replace(_c(directory), r"_[0-9a-f]{12}$", "")


def bullets(x: Column | str) -> Column:
    """Texts of lines that start with ``- ``, but for the no-claim bullet."""
    lines = F.transform(F.split(F.coalesce(_c(x), F.lit("")), "\n"), strip)
    found = F.transform(F.filter(lines, lambda s: s.startswith("- ")), lambda s: strip(F.substring(s, F.lit(3), F.length(s))))
    return F.filter(found, lambda s: (s != "") & (s != NO_CLAIM))


def verdict(x: Column | str) -> Column:
    """yes or no of a judge's reply: the JSON field if there is one, else whether it says yes."""
    field = F.lower(F.get_json_object(first_json_object(x), "$.verdict"))
    return F.coalesce(field, F.when(F.lower(_c(x)).rlike(r"\byes\b|是"), F.lit("yes")).otherwise(F.lit("no")))


def normalize_json_text(x: Column | str) -> Column:
    """Lower-cased text of JSON text, or of a struct, map or array: keys and values in order, with spaces between; null is empty.

    Values keep their own punctuation: the JSON is taken apart into strings and bare values, and each is read by itself.
    """
    atoms = F.regexp_extract_all(_c(x), F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[-+.\w]+)'), F.lit(1))
    return F.lower(F.array_join(F.transform(atoms, lambda a: F.coalesce(F.from_json(F.concat(F.lit("["), a, F.lit("]")), "array<string>")[0], F.lit(""))), " "))


def meta_value(x: Column | str, kind: str) -> Column:
    """A metadata value that can be filtered on: null is the empty text, scalars stay, everything else is its JSON text."""
    x = _c(x)
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(x, F.lit("")) if kind == "string" else x
