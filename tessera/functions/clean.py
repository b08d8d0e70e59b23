r"""Markdown cleaning as Column rules, one for each kind of noise, and their fixed order.

Patterns are Java's; ``(?U)`` gives Unicode classes, ``(?d)`` lets only \n end a line. A document is one row from beginning to
end; rules that look at neighbouring lines compare places of its array of lines or cut it into sections, in linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import _c, strip

CODE = r"(?s)(?:```.*?```|~~~.*?~~~)"
TABLE = r"(?is)<table\b.*?</table>"
#: Headings that open a table of contents, tags that go while their text stays, and page-number lines.
TOC = r"(?iU)^#{1,6}\s*(目录|Table of Contents|TOC)\s*$"
TAGS = r"(?i)</?(div|span|font|center|p|br|strong|em|b|i|u|section|article)[^>]*>"
#: Front matter, lines that are drawn rules, list items, and rows of a table that hold only rules.
FRONT_MATTER = r"(?sU)\A\s*---\n.*?\n---\s*\n"
RULE_LINES = r"(?mdU)^\s*([-*_])\s*(\1\s*){2,}$"
BULLET, NUMBER = r"(?U)^\s*[*+]\s+", r"(?U)^(\d+)\.([^\s])"
#: Characters that make a line noise, alone (four or more) or with white space (three or more).
DOTS, BARS = ".。·•", "·•-"
SEPARATOR = r"(?U)\A\|?[\s:.\-]+\|[\s|:.\-]+\z"
PAGE_NUMBERS = (r"(?U)^[-–—]?\s*\d{1,4}\s*[-–—]?$", r"(?iU)^(第\s*)?\d{1,4}\s*(页|/\s*\d{1,4}|of\s+\d{1,4})$", r"(?iU)^Page\s+\d{1,4}(\s*/\s*\d{1,4})?$")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(x), body), 1)


def lines(x: Column | str) -> Column:
    return F.split(_c(x), "\n", -1)


def unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def newlines(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "\r\n?", "\n")


def invisible(x: Column | str) -> Column:
    """Zero-width and control characters go; no-break and ideographic spaces become spaces."""
    t = F.regexp_replace(_c(x), "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    return F.translate(t, "\u00a0\u3000", "  ")


def front_matter(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), FRONT_MATTER, "")


def html_comments(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?s)<!--.*?-->", "")


def html_tags(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), TAGS, "")


def rules(x: Column | str) -> Column:
    """Lines of three or more equal dashes, stars or underscores; white space of the pattern may cross lines."""
    return F.regexp_replace(_c(x), RULE_LINES, "")


def page_numbers(x: Column | str) -> Column:
    return unlines(F.filter(lines(x), lambda s: ~is_page_number(strip(s))))


def is_page_number(s: Column) -> Column:
    return s.rlike(PAGE_NUMBERS[0]) | s.rlike(PAGE_NUMBERS[1]) | s.rlike(PAGE_NUMBERS[2])


def _dense(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\s+", "")


def _only(s: Column, characters: str) -> Column:
    return F.translate(s, characters, "") == ""


def empty_rows(x: Column | str) -> Column:
    """Without rows of a table that have two bars or more and nothing between them."""
    return unlines(F.filter(lines(x), lambda s: ~(s.contains("|") & (F.length(_dense(s)) >= 2) & _only(_dense(s), "|"))))


def is_noise(s: Column) -> Column:
    return ((F.length(s) >= 3) & s.rlike(rf"(?U)\A[\s{BARS}]*+\z")) | ((F.length(s) >= 4) & _only(s, DOTS))


def noise(x: Column | str) -> Column:
    return unlines(F.filter(lines(x), lambda s: ~is_noise(strip(s))))


def heading(s: Column | str) -> Column:
    """One to six hashes right before a title get a blank after them."""
    s = _c(s)
    title = F.ltrim(s, F.lit("#"))
    hashes = F.length(s) - F.length(title)
    tight = hashes.between(1, 6) & (title != "") & ~title.rlike(r"(?U)\A\s")
    return F.when(tight, F.concat(F.substring(s, F.lit(1), hashes), F.lit(" "), title)).otherwise(s)


def unordered(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), BULLET, "- ")


def ordered(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), NUMBER, "$1. $2")


def squeeze(s: Column | str) -> Column:
    """Runs of blanks to one, but in table rows and indented lines."""
    s = _c(s)
    return F.when(s.startswith("|") | s.startswith(" "), s).otherwise(F.regexp_replace(s, r"[ \t]{2,}", " "))


def table_separator(s: Column | str) -> Column:
    """A separator row of a table in its plainest form; other lines as they are."""
    s = _c(s)
    cells = F.split(F.regexp_replace(strip(s), r"^\|+|\|+$", ""), r"\|")

    def cell(c: Column) -> Column:
        c = strip(c)
        return (
            F.when(c.startswith(":") & c.endswith(":"), F.lit(":---:")).when(c.endswith(":"), F.lit("---:")).when(c.startswith(":"), F.lit(":---")).otherwise(F.lit("---"))
        )

    rebuilt = F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
    return F.when(s.rlike(SEPARATOR), rebuilt).otherwise(s)


def table_separators(x: Column | str) -> Column:
    return unlines(F.transform(lines(x), table_separator))


#: Before a heading, or a contents heading without a blank after its hashes.
_SECTION = r"(?mdiU)^(?=[\s&&[^\n]]*#{1,6}(?:[\s&&[^\n]]+[^\s]|(?:目录|Table of Contents|TOC)[\s&&[^\n]]*$))"


def toc(x: Column | str) -> Column:
    """Everything from a contents heading up to the next heading goes: sections are cut at headings, and those of contents dropped."""
    sections = F.split(F.concat(_c(x), F.lit("\n")), _SECTION, -1)
    kept = F.filter(sections, lambda s: ~strip(F.substring_index(s, "\n", 1)).rlike(TOC))
    return F.regexp_replace(F.array_join(kept, ""), r"\n\z", "")


def line_pass(x: Column | str, tidy: Callable[[Column], Column] | None = None) -> Column:
    """Each line stripped and tidied; noise goes, and then each line, blank or not, that equals the one before it.

    The steps of tidying are passes over all lines, since a step inside another would be worked out wherever that reads its line.
    """
    plain = F.filter(F.transform(lines(x), strip), lambda s: ~is_noise(s))
    for step in (tidy,) if tidy else (heading, unordered, ordered, squeeze):
        plain = F.transform(plain, step)
    return unlines(let(plain, lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.coalesce(F.get(a, i - 1), F.lit(""))))))


def html_table(x: Column) -> Column:
    """A table on one line, without white space between tags."""
    t = F.regexp_replace(F.regexp_replace(x, "\n", ""), r"(?U)>\s+<", "><")
    return strip(F.regexp_replace(t, r"(?U)\s{2,}", " "))


def _protected(x: Column, pattern: str, signs: tuple[str, ...], mark: str, inner: Callable[[Column], Column], restore: Callable[[Column], Column]) -> Column:
    """``inner`` on the text with the pattern's parts set aside as marked tokens, which come back through ``restore``; the text is worked out once.

    The pattern is tried only on texts that have one of its ``signs``.
    """

    def body(t: Column) -> Column:
        some = reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signs])
        parts = F.when(some, F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        cleaned = F.split(inner(F.when(some, F.regexp_replace(t, pattern, mark)).otherwise(t)), mark, -1)
        woven = F.zip_with(cleaned, F.transform(parts, restore), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.array_join(woven, "")

    return let(x, body)


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"\n{3,}", "\n\n")


def markdown(x: Column | str) -> Column:
    """The whole chain: code and HTML tables set aside, rules in order, lines tidied, blanks collapsed, one final newline."""

    def body(t: Column) -> Column:
        for rule in (toc, front_matter, html_comments, html_tags, rules, page_numbers, empty_rows, line_pass, table_separators, collapse):
            t = rule(t)
        return t

    t = invisible(newlines(F.coalesce(_c(x), F.lit(""))))
    # Marks are private-use characters, which no rule touches.
    t = _protected(t, CODE, ("```", "~~~"), "\ue000", lambda u: _protected(u, TABLE, ("<",), "\ue001", body, html_table), lambda c: c)
    return F.concat(strip(collapse(newlines(t))), F.lit("\n"))


RULES: dict[str, Callable[[Column | str], Column]] = {
    "clean_newlines": newlines, "clean_invisible": invisible, "clean_front_matter": front_matter, "clean_html_comment": html_comments,
    "clean_html_tags": html_tags, "clean_rules": rules, "clean_page_no": page_numbers, "clean_empty_row": empty_rows, "clean_noise": noise,
    "clean_toc": toc, "clean_line_pass": line_pass, "clean_table_sep": table_separators, "clean_markdown": markdown,
    "clean_heading": lambda x: unlines(F.transform(lines(x), heading)), "clean_ul": lambda x: unlines(F.transform(lines(x), unordered)),
    "clean_ol": lambda x: unlines(F.transform(lines(x), ordered)), "clean_squeeze": lambda x: unlines(F.transform(lines(x), squeeze)),
}
