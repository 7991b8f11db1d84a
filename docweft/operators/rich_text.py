"""Plain text as typed blocks (headings, labels, lists, paragraphs) and as HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .briefing import escape_html

_WORDS = r"[A-Z][A-Za-z0-9/&(),'\- ]"
HEADING, LABEL, ITEM, MARKED = rf"^{_WORDS}+:?$", rf"^({_WORDS}{{1,42}}):\s+(.+)$", r"^[-*•]\s+(.+)$", r"^#{1,6}\s+(.+)$"
EMPTY = "No readable content available yet."
_BLOCK = "struct<kind:string,label:string,text:string>"


def tidy(c: Column) -> Column:
    """Text without carriage returns, no-break spaces and blanks at line ends, with at most one empty line in a row."""
    x = F.replace(F.replace(T.some(c), F.lit("\r"), F.lit("")), F.lit(" "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def heading(line: Column) -> Column:
    """Title-like lines of up to 72 characters: with a colon at the end, or up to seven words."""
    words = F.size(F.split(line, r"\s+"))
    return (F.char_length(line) <= 72) & line.rlike(HEADING) & (line.endswith(":") | (words <= 7))


def _typed(raw: Column) -> Column:
    line = F.trim(raw)
    block = lambda kind, text, label="": F.struct(F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"), text.alias("text"))
    return (
        F.when((line == "") | T.is_page_marker(line), block("gap", F.lit("")))
        .when(line.rlike(ITEM), block("list", F.regexp_extract(line, ITEM, 1)))
        .when(line.rlike(MARKED), block("heading", F.trim(F.regexp_extract(line, MARKED, 1))))
        .when(heading(line), block("heading", F.regexp_replace(line, ":$", "")))
        .when(line.rlike(LABEL), block("label", F.regexp_extract(line, LABEL, 2), F.regexp_extract(line, LABEL, 1)))
        .otherwise(block("paragraph", line))
    )


def blocks(c: Column) -> Column:
    """array<struct<kind, label, text>>: neighbouring items are one list (a line each), neighbouring plain lines one paragraph."""

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & F.try_element_at(done, F.lit(-1))["kind"].eqNullSafe(b["kind"]) & b["kind"].isin("list", "paragraph")
        longer = F.struct(b["kind"].alias("kind"), b["label"].alias("label"), F.concat(last["text"], F.when(b["kind"] == "list", "\n").otherwise(" "), b["text"]).alias("text"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(b)))

    every = F.aggregate(F.transform(T.lines(tidy(c)), _typed), F.array().cast(f"array<{_BLOCK}>"), step)
    return F.filter(every, lambda b: b["kind"] != "gap")


def html(c: Column) -> Column:
    """A text as HTML."""
    return html_of(blocks(c))


def html_of(found: Column) -> Column:
    """The blocks as HTML, all text escaped."""
    text, items = (lambda b: escape_html(b["text"])), (lambda b: F.array_join(F.transform(F.split(b["text"], "\n"), lambda x: F.concat(F.lit("<li>"), escape_html(x), F.lit("</li>"))), ""))
    made = lambda b: F.when(b["kind"] == "heading", F.concat(F.lit("<h3>"), text(b), F.lit("</h3>"))).when(b["kind"] == "list", F.concat(F.lit("<ul>"), items(b), F.lit("</ul>"))).when(b["kind"] == "label", F.concat(F.lit("<p><strong>"), escape_html(b["label"]), F.lit(":</strong> "), text(b), F.lit("</p>"))).otherwise(F.concat(F.lit("<p>"), text(b), F.lit("</p>")))
    return T.bound(F.array_join(F.transform(found, made), "\n"), lambda body: F.when(body == "", f"<p>{EMPTY}</p>").otherwise(body))
