r"""Chat formatting by grammar round trip.

Grammar of the rendered text::

    conversation := turn*
    turn         := "### " role ": " text " </turn>\n"

A role ends at the first ": ", a text at the first " </turn>\n"; the parser
undoes backslash escapes in both, and takes no role or text that holds a control string
("### " or "</turn>") without an escape. A turn is first rendered as it is and parsed
again. Where the parser doesn't give the turn back, its controls are escaped
(backslash, "### ", "</turn>", and the blank of ": " in roles), and it is parsed once more. A
conversation whose parse still differs is escaped in every turn. So no control string of
a text stays bare, and the texts come back as they were.

Nulls: a null role or text counts as empty. Ties: rows of equal turn are ordered
by role, then text; repeated rows are repeated turns; a null turn comes first. A
null conv_id is a conversation of its own; ids are carried exactly beside it. An empty table
gives an empty result. A conversation of any length is one row, so it has to fit into
a task; Arrow batches are bounded by bytes as well as by rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import carried, restored

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPED = re.compile(r"\\(.)", re.S)

FORMATTED = "formatted string, spans array<struct<start:int,stop:int>>, escaped_turns int, turns array<struct<role:string,text:string>>, loss_text string"


def escape(s: str, role: bool = False) -> str:
    # a "###" at the end meets the blank that follows it
    s = (s.replace("\\", "\\\\") + " ").replace("### ", "\\### ").replace("</turn>", "\\</turn>")[:-1]
    return s.replace(": ", ":\\ ") if role else s


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def _bare(s: str) -> bool:
    """Whether a control string stands in s without an escape."""
    plain = _ESCAPED.sub("\0", s) + " "
    return "### " in plain or "</turn>" in plain


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{OPEN}{role}{MIDDLE}{text}{CLOSE}" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, stop) by turn, with the span of the escaped text; None if the grammar doesn't hold."""
    found, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            return None
        middle = rendered.find(MIDDLE, at + len(OPEN))
        close = rendered.find(CLOSE, middle + len(MIDDLE)) if middle >= 0 else -1
        if close < 0:
            return None
        start = middle + len(MIDDLE)
        if _bare(rendered[at + len(OPEN) : middle]) or _bare(rendered[start:close]):
            return None
        found.append((unescape(rendered[at + len(OPEN) : middle]), unescape(rendered[start:close]), start, close))
        at = close + len(CLOSE)
    return found


def _same(parsed, turns) -> bool:
    return parsed is not None and [(r, t) for r, t, _, _ in parsed] == turns


def format_turns(turns: list[tuple[str, str]]):
    """(rendered text, its parse, number of escaped turns) of one conversation."""
    safe, escaped = [], 0
    for role, text in turns:
        if not _same(parse(render([(role, text)])), [(role, text)]):
            role, text, escaped = escape(role, True), escape(text), escaped + 1
        safe.append((role, text))
    parsed = parse(out := render(safe))
    if not _same(parsed, turns):
        escaped = len(turns)
        parsed = parse(out := render([(escape(r, True), escape(t)) for r, t in turns]))
        if not _same(parsed, turns):
            raise ValueError("the rendered conversation can't be read back")
    return out, parsed, escaped


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans under the loss mask, escaped_turns, and what the parser reads back (turns, loss_text)."""
    kind = df.schema[conv].dataType
    rows = df.select(carried(F.col(conv), kind).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    # one row in the result is one whole conversation, so its turns have to meet; the sort is inside the row
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for roles, texts in zip(b["roles"], b["texts"], strict=True):
                formatted, parsed, escaped = format_turns(list(zip(roles, texts, strict=True)))
                under = [(s, e) for r, _, s, e in parsed if r == loss_role]
                out.append((formatted, [{"start": s, "stop": e} for s, e in under], escaped, [{"role": r, "text": x} for r, x, _, _ in parsed], "".join(unescape(formatted[s:e]) for s, e in under)))
            yield pd.DataFrame(out, columns=["formatted", "spans", "escaped_turns", "turns", "loss_text"]).assign(conv_id=b["conv_id"].to_numpy())[["conv_id", "formatted", "spans", "escaped_turns", "turns", "loss_text"]]

    out = grouped.mapInPandas(run, f"conv_id {grouped.schema['conv_id'].dataType.simpleString()}, {FORMATTED}")
    return out.withColumn("conv_id", restored(F.col("conv_id"), kind))


def turns_digest(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
