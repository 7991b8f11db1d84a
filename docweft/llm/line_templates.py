r"""Line deduplication by a log-template tree.

A line's tokens are its words (``str.split``); a token with a digit is the wildcard
``<*>``. The tree has fixed depth: its first level is the number of tokens, the next
``DEPTH`` levels are the leading tokens, wildcards included. In a leaf the distinct
lines come in order of falling number of documents, then by text; each joins the
template with which it agrees in the largest share of places (wildcards don't count as
agreement; ties go to the older template) if that share is at least ``ALIKE``, and the
places where they differ become wildcards; otherwise it begins a template.

A template that occurs in at least ``min_docs`` rows of documents is recurring, and all
its lines are dropped. Leaves in fewer documents can't hold one and are left alone.
Size changes no result. A line joins a template only if it agrees in at least ``ALIKE``
of the places with every line that is in it. With d places where two such lines may
differ, one at least of d + 1 blocks of places is equal and without wildcards in both:

* inside a leaf, templates are looked up by their blocks;
* a leaf with more than ``LEAF`` distinct lines is taken apart into sets of lines linked
  by equal blocks, found by passing on the smallest number along equi-joins on blocks.
  Templates never reach over two sets. A leaf whose sets are not settled after ``ROUNDS``
  rounds, and a set of any size, stay whole in one task.

Lines end at "\n". Blank lines are never dropped. A null text counts as empty, has no
lines and stays null. Repeated rows count as documents each. Nulls in doc_id don't
matter, as rows are told apart by their text. An empty table gives an empty result. Columns
of any name stay; n_lines and n_dropped are added, with an underscore behind where a column has that name. A text is
read whole, and a line of any length is one value: a very long one takes memory in proportion to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import fresh
from .workspace import Workspace

DEPTH, ALIKE, LEAF, ROUNDS, ANY = 2, 0.8, 4000, 12, "<*>"
NEAR = 64  # up to so many templates are all compared with a line; beyond that they are looked up by blocks
BROADCAST = 500_000  # so many leaves, 8 bytes each, are broadcast at most; beyond that they are joined by a shuffle
_DIGIT = re.compile(r"\S*[0-9]\S*")


def masked(line: str) -> list[str]:
    return (_DIGIT.sub(ANY, line) if _DIGIT.search(line) else line).split()


def leaf_of(tokens: list[str]) -> str:
    return " ".join([str(len(tokens)), *tokens[:DEPTH]])


def blocks(width: int, alike: float = ALIKE) -> list[tuple[int, int]]:
    """Places (start, end) after the leading tokens, one block more than two lines that are alike can differ in; empty if there are too few places."""
    spare = max(d for d in range(width + 1) if d == 0 or (width - d) / width >= alike)
    ends = np.linspace(min(DEPTH, width), width, spare + 2).astype(int)
    return list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if width - DEPTH > spare else []


def templates(lines: list[tuple[str, int]], alike: float = ALIKE) -> list[int]:
    """The template (its number) of each of the lines of one leaf, given as (masked line, documents); all have one token count."""
    order = sorted(range(len(lines)), key=lambda i: (-lines[i][1], lines[i][0]))
    names: dict[str, int] = {ANY: 0}
    width = len(lines[0][0].split(" ")) if lines else 0
    parts = blocks(width, alike) if len(lines) > NEAR else []
    index: dict[tuple[int, bytes], list[int]] = {}
    known = np.zeros((16, width), np.int64)
    count, out = 0, [0] * len(lines)
    for i in order:
        code = np.array([names.setdefault(t, len(names)) for t in lines[i][0].split(" ")], np.int64)
        keys = [(a, code[a:b].tobytes()) for a, b in parts if code[a:b].all()]
        # a template stays under the blocks of its first line; the comparison decides
        if parts and count > NEAR:
            near = np.array(sorted({t for k in keys for t in index.get(k, ())}), np.int64)
            held = known[near]
        else:
            near, held = np.arange(count), known[:count]
        share = ((held == code) & (code != 0)).sum(1) / width
        top = int(share.argmax()) if len(near) else -1
        if top >= 0 and share[top] >= alike:
            best = int(near[top])
            known[best][known[best] != code] = 0
        else:
            if count == len(known):
                known = np.concatenate([known, np.zeros_like(known)])
            best, count = count, count + 1
            known[best] = code
            for k in keys:
                index.setdefault(k, []).append(best)
        out[i] = best
    return out


LINES = "tid string, row bigint, place int, leaf bigint, line string, first_leaf int, first_line int"


def _lines(docs: DataFrame) -> DataFrame:
    """The lines that have tokens: text's name, row, place in the text, leaf, masked line, and whether the row has leaf or line here for the first time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out, size = [], 0
            for tid, text in zip(b["tid"], b["text"], strict=True):
                row += 1
                leaves, seen = set(), set()
                for place, line in enumerate((text or "").split("\n")):
                    tokens = masked(line)
                    if not tokens:
                        continue
                    leaf = xxhash.xxh64_intdigest(leaf_of(tokens).encode("utf-8", "surrogatepass")) - (1 << 63)
                    plain = " ".join(tokens)
                    out.append((tid, row, place, leaf, plain, int(leaf not in leaves), int(plain not in seen)))
                    leaves.add(leaf)
                    seen.add(plain)
                    size += len(plain)
                if size > 8 << 20:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])

    return docs.mapInPandas(run, LINES)


def _links(lines: DataFrame) -> DataFrame:
    """(leaf, node, block): a number for each line and each of its blocks without wildcards. Equal numbers by chance only make sets larger."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for leaf, line, node in zip(b["leaf"], b["line"], b["node"], strict=True):
                tokens = line.split(" ")
                for start, end in blocks(len(tokens)):
                    if ANY not in tokens[start:end]:
                        key = " ".join([str(leaf), str(start), *tokens[start:end]])
                        out.append((leaf, node, xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)))
            yield pd.DataFrame(out, columns=["leaf", "node", "block"])

    return lines.mapInPandas(run, "leaf bigint, node bigint, block bigint")


def _sets(work: Workspace, distinct: DataFrame) -> DataFrame:
    """distinct with the column part: leaves with more than LEAF lines by sets of linked lines, others whole (0)."""
    full = work.keep(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF).select("leaf"), "full")
    if not full.limit(1).count():
        return distinct.withColumn("part", F.lit(0).cast("bigint"))
    node = F.xxhash64("leaf", "line")
    links = work.keep(_links(distinct.join(full, "leaf", "left_semi").select("leaf", "line", node.alias("node"))), "links")
    label = work.keep(links.select("leaf", "node", F.col("node").alias("part"), F.lit(True).alias("moved")).distinct(), "label0")
    for step in range(ROUNDS):
        low = work.keep(links.join(label.select("node", "part"), "node").groupBy("block").agg(F.min("part").alias("low")), f"low{step}")
        new = links.join(low, "block").groupBy("leaf", "node").agg(F.min("low").alias("part"))
        new = new.join(label.select("leaf", "node", F.col("part").alias("old")), ["leaf", "node"])
        label = work.keep(new.select("leaf", "node", "part", (F.col("part") < F.col("old")).alias("moved")), f"label{step + 1}")
        work.drop(f"low{step}", f"label{step}")
        if not label.filter("moved").limit(1).count():
            break
    work.drop("links")
    moving = label.filter("moved").select("leaf").distinct()
    settled = label.join(moving, "leaf", "left_anti").select("leaf", "node", "part")
    # a line of a settled leaf without any block is alone
    alone = full.join(moving, "leaf", "left_anti").select("leaf", F.lit(True).alias("apart"))
    out = distinct.withColumn("node", node).join(settled, ["leaf", "node"], "left").join(alone, "leaf", "left")
    part = F.coalesce("part", F.when(F.col("apart"), F.col("node")), F.lit(0).cast("bigint"))
    return work.keep(out.select("leaf", "line", "docs", part.alias("part")), "parted")


def recurring(work: Workspace, docs: DataFrame, min_docs: int) -> DataFrame:
    """(tid, places): the lines to drop from each text."""
    lines = work.keep(_lines(docs), "lines")
    hot = work.keep(lines.groupBy("leaf").agg(F.sum("first_leaf").alias("docs")).filter(F.col("docs") >= min_docs).select("leaf"), "leaves")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST else hot
    held = work.keep(lines.join(hot, "leaf", "left_semi"), "held")
    work.drop("lines")
    # a common line has one row per task before it moves
    distinct = work.keep(held.groupBy("leaf", "line").agg(F.sum("first_line").alias("docs")), "distinct")
    distinct = _sets(work, distinct)

    def grow(df: pd.DataFrame) -> pd.DataFrame:
        return df[["leaf", "part", "line"]].assign(template=np.array(templates(list(zip(df["line"], df["docs"], strict=True))), np.int64))

    # sets whose lines together are in too few documents are not grown
    size = distinct.groupBy("leaf", "part").agg(F.sum("docs").alias("all")).filter(F.col("all") >= min_docs).select("leaf", "part")
    grown = distinct.join(size, ["leaf", "part"], "left_semi").groupBy("leaf", "part").applyInPandas(grow, "leaf bigint, part bigint, line string, template bigint")
    grown = work.keep(grown, "grown")
    template = ["leaf", "part", "template"]
    placed = work.keep(held.join(grown, ["leaf", "line"]).select("tid", "row", "place", *template), "placed")
    work.drop("held")
    often = placed.select(*template, "row").distinct().groupBy(*template).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select(*template)
    drop = placed.join(work.keep(often, "often"), template, "left_semi").select("tid", "place").distinct()
    drop = work.keep(drop.groupBy("tid").agg(F.collect_set("place").alias("places")), "drop")
    work.drop("placed")
    return drop


def drop_recurring(docs: DataFrame, text: str = "text", min_docs: int = 10) -> DataFrame:
    """docs with its text free of recurring lines, and the columns n_lines and n_dropped (lines that are not blank)."""
    work = Workspace(docs.sparkSession, "line_templates")
    tid, places, lines, dropped = fresh(docs, "tid", "places", "n_lines", "n_dropped")
    named = docs.withColumn(tid, F.md5(F.coalesce(F.col(text), F.lit(""))))
    drop = recurring(work, named.select(F.col(tid).alias("tid"), F.col(text).alias("text")), min_docs)
    out = named.join(drop.select(F.col("tid").alias(tid), F.col("places").alias(places)), tid, "left")
    every = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(every, lambda x, i: ~F.array_contains(places, i)), "\n")
    n_lines = F.size(F.filter(every, lambda x: x.rlike(r"(?U)\S")))
    return out.select(
        *[F.when(F.col(places).isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(n_lines, F.lit(0)).cast("bigint").alias(lines),
        F.coalesce(F.size(places), F.lit(0)).cast("bigint").alias(dropped),
    )
