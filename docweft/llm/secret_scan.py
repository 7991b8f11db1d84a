r"""Secret scans: all rules compiled to one minimised automaton, one pass over the bytes of a text.

A rule is head and tail, both patterns; a match is the leftmost longest one of head + tail, and matches of one
rule don't overlap. Matches whose tail has fewer than ``least`` characters are dropped after they
were found, so they hide what begins inside them, as the rule says. Rules are of ASCII
characters, so a text's bytes are scanned as they are, and only found places are turned into code points.

The automaton is built on the driver, once a call, and goes to the tasks with the function (some 100 kB). Each text is scanned
whole, in the task that reads it; there is no shuffle. Nulls: a null text counts as empty and
has no spans; a null id is carried along. Repeated rows are rows of their own. Spans of different kinds may overlap; they
come by start, then kind in the order of the rules. An empty table gives an empty result.
Very long texts take memory in proportion to their length; an Arrow batch is bounded by bytes as well as by rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton


class Rule(NamedTuple):
    kind: str
    head: str
    tail: str
    least: int  # characters of the tail
    any_case: bool = False


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", "", r"[0-9a-f]+", 32),
]
#: Beside the base kinds: tokens of code hosts, signed web tokens, and the first line of private keys.
MORE = [
    Rule("host_token", r"gh[opsru]_", r"[A-Za-z0-9]+", 36),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("private_key", "", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", 27),
]
SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


class Scanner:
    """The compiled rules; spans() is (rule, start, end) in code points."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.automaton = automaton.build([automaton.compiled(r.head + r.tail, r.any_case) for r in rules], [r.least for r in rules])
        self.heads = [automaton.compiled(r.head, r.any_case) for r in rules]
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        if self._table is None:
            self._table = self.automaton.table.tolist()
        found = []
        for k, start, end in automaton.scan(self.automaton, self._table, data):
            if end - start >= self.rules[k].least and end - start - max(0, automaton.longest(self.heads[k], data[start:end])) >= self.rules[k].least:
                found.append((k, start, end))
        if found and not data.isascii():
            # bytes that begin a character, counted before each place
            before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            found = [(k, int(before[s]), int(before[e])) for k, s, e in found]
        return sorted(found, key=lambda m: (m[1], m[0]))


def find(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans: kind, start and stop in code points, stop exclusive."""
    scanner, kinds = Scanner(rules or BASE + MORE), [r.kind for r in rules or BASE + MORE]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": kinds[k], "start": s, "stop": e} for k, s, e in scanner.spans(x.as_py())] for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, span)], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:stop of each, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
