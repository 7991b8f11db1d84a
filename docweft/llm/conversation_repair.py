"""Conversation structure repair by error-correcting Earley parsing over roles.

The grammar says which roles a conversation may have, ``(s? (u a)+)?`` by their initials, with productions for
mistakes beside those for what is right, each with a weight and a letter::

    Z -> nothing | Z delete                  nothing said yet
    S -> Z keep-s | S delete                 the system has spoken
    U -> X user   | U delete     X = Z, S, A the user has
    A -> U assistant | A delete              the assistant has
    C -> Z | A                               a whole conversation
    user, assistant -> keep | rerole | insert

Keep costs 0, rerole 1, delete 2, insert 5; a row that ends in mid-sentence costs 5 more unless it is deleted; blank rows and
repeats can only be deleted. Chart items have the least (cost, audit), the audit being the letters
(D, I, K, R) in order. A set's items are taken from a heap in rising order, so each is final when it is taken, loops of
inserts included. Two different audits of one cost, state and place never begin with one another (that would take inserts of
no cost), so the least audit of a prefix is part of the least audit of the whole.

Productions are left-linear, so all items begin in set 0; only that and the last set are kept. Items that can't be part of
a best parse any more (another costs less by more than the edits that lead from it to the same end) are
dropped, and letters that all others share are settled: rows are written, or hashed, as
soon as they are settled. So a task mostly holds few rows of a conversation. Only where two readings stay equally good to the end (roles that
alternate, one out of step) does it hold all rows since they parted. The digest of a conversation is made of
all its rows in order, so they go through one task, sorted by Spark on disk.

Rows are ordered by turn (null first), then role, then text. Nulls in role or text count as one space. A role that is
empty has no initial: its row is reroled or deleted. A null conv_id is a conversation of its own. Repeated rows: the first is
kept, the others are duplicates. A conversation without rows has costs of 0, an empty audit and the digest of
the empty text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
CUT_OFF = 5
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


class Production(NamedTuple):
    left: str
    right: tuple[str, ...]  # nonterminals, then letter + role


GRAMMAR = [Production("C", ("Z",)), Production("C", ("A",)), Production("Z", ()), Production("S", ("Z", KEEP + "s"))]
GRAMMAR += [Production(x, (x, DELETE)) for x in "ZSUA"]
GRAMMAR += [Production(to.upper(), (x, edit + to)) for to, before in (("u", "ZSA"), ("a", "U")) for x in before for edit in (KEEP, REROLE, INSERT)]
NONTERMINALS = frozenset(p.left for p in GRAMMAR)
#: What it can cost more to go on from the second state than from the first, at most.
DETOUR = {("Z", "S"): 12, ("Z", "U"): 7, ("Z", "A"): 2, ("S", "Z"): 0, ("S", "U"): 5, ("S", "A"): 0, ("U", "Z"): 5, ("U", "S"): 5, ("U", "A"): 5, ("A", "Z"): 0, ("A", "S"): 10, ("A", "U"): 5}


class Row(NamedTuple):
    role: str
    text: str
    wrong: bool = False  # blank or a repeat
    cut: bool = False


#: An audit is the rank of its beginning among the live ones' and the letters after that, so that audits of one length of beginning compare as texts do.
Audit = tuple[int, str]


class Chart:
    """Earley's sets for one conversation, row by row."""

    def __init__(self):
        self.waiting: dict[str, list[int]] = {}  # set 0: productions by the nonterminal at their dot
        self.open: list[tuple[int, int, Audit]] = []  # last set: (production, cost, audit) with the dot before an edit of a row
        self.whole: dict[str, tuple[int, Audit]] = {}  # last set: nonterminals that are complete
        self.begins: list[tuple | None] = [None]  # beginnings by rank: (what is before, letters)
        todo, predicted = ["C"], set()
        while todo:
            if (x := todo.pop()) in predicted:
                continue
            predicted.add(x)
            for k, p in enumerate(GRAMMAR):
                if p.left == x and p.right:
                    self.waiting.setdefault(p.right[0], []).append(k)
                    todo.append(p.right[0])
        self._fill([(0, (0, ""), k, 0) for k, p in enumerate(GRAMMAR) if p.left in predicted and not p.right])

    def _fill(self, heap: list[tuple[int, Audit, int, int]]) -> None:
        """A set from its first items (cost, audit, production, dot)."""
        heapq.heapify(heap)
        self.open, self.whole, done = [], {}, set()
        while heap:
            cost, audit, k, dot = heapq.heappop(heap)
            if (k, dot) in done:
                continue
            done.add((k, dot))
            left, right = GRAMMAR[k]
            if dot == len(right):
                if left not in self.whole:  # the first is the least
                    self.whole[left] = cost, audit
                    for other in self.waiting.get(left, ()):
                        heapq.heappush(heap, (cost, audit, other, 1))
            elif right[dot][0] == INSERT:
                heapq.heappush(heap, (cost + COST[INSERT], (audit[0], audit[1] + INSERT), k, dot + 1))
            else:
                self.open.append((k, cost, audit))
        live = {x: v for x, v in self.whole.items() if x != "C"}
        lost = {x for x, (cost, _) in live.items() if any(cost > other + DETOUR[x, y] for y, (other, _) in live.items() if y != x)}
        if lost:
            self.open = [o for o in self.open if GRAMMAR[o[0]].right[0] not in lost]

    def read(self, row: Row) -> None:
        found = []
        for k, cost, (rank, letters) in self.open:
            edit, role = GRAMMAR[k].right[1][0], GRAMMAR[k].right[1][1:]
            if edit == DELETE:
                found.append((cost + COST[DELETE], (rank, letters + DELETE), k, 2))
            elif not row.wrong and (edit == REROLE or row.role[:1] == role):
                found.append((cost + COST[edit] + CUT_OFF * row.cut, (rank, letters + edit), k, 2))
        self._fill(found)

    @staticmethod
    def _spelt(begin: tuple | None) -> str:
        out = []
        while begin is not None:
            begin, letters = begin
            out.append(letters)
        return "".join(reversed(out))

    def settled(self) -> str:
        """Letters that all audits have in common and that are taken off; what differs becomes a ranked beginning."""
        live = {audit for _, _, audit in self.open}
        n = min(len(letters) for _, letters in live)
        cuts = sorted({(rank, letters[:n]) for rank, letters in live})
        new = {cut: i for i, cut in enumerate(cuts)}
        moved = lambda audit: (new.get((audit[0], audit[1][:n]), -1), audit[1][n:])  # noqa: E731  -1: dropped before
        self.open = [(k, cost, moved(audit)) for k, cost, audit in self.open]
        self.whole = {x: (cost, moved(audit)) for x, (cost, audit) in self.whole.items()}
        before = self.begins[cuts[0][0]]
        if len(cuts) == 1:
            self.begins = [None]
            return self._spelt((before, cuts[0][1]))
        if all(self.begins[rank] is before for rank, _ in cuts):
            self.begins = [(None, letters) for _, letters in cuts]
            return self._spelt(before)
        self.begins = [(self.begins[rank], letters) for rank, letters in cuts]
        return ""

    def best(self) -> tuple[int, str]:
        cost, (rank, letters) = self.whole["C"]
        return cost, self._spelt((self.begins[rank], letters))


class Repair:
    """One conversation: rows in, edits out as they are settled."""

    #: Letters that are waited for before some are settled.
    WAIT = 32

    def __init__(self, tell: Callable[[str, str, str], None] | None = None):
        self.chart, self.rows, self.tell, self.letters, self.out, self.first = Chart(), deque(), tell, [], 0, 0
        self.digest, self.last = hashlib.sha256(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.since = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, repeat: bool) -> None:
        said = text.rstrip(BLANKS)
        blank, cut = not said, said[-1:] not in (".", "!", "?")
        self.blank += blank
        self.duplicate += repeat and not blank
        self.truncated += cut and not repeat and not blank
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        row = Row(role, text, blank or repeat, cut)
        self.rows.append(row)
        self.chart.read(row)
        self.since += 1
        if self.since >= self.WAIT:
            self.since = 0
            self._write(self.chart.settled())

    def _write(self, letters: str) -> None:
        self.letters.append(letters)
        for edit in letters:
            row = self.rows.popleft() if edit != INSERT else Row("", "")
            if edit == DELETE:
                if self.tell:
                    self.tell(edit, row.role, row.text)
                continue
            if edit == KEEP:
                role = row.role
                self.first = self.first or int(not self.out and role[:1] == "s")
            else:
                role = ROLES["ua"[(self.out - self.first) % 2]]
            self.digest.update((("\n" if self.out else "") + role + ":" + row.text).encode("utf-8", "surrogatepass"))
            self.out += 1
            if self.tell:
                self.tell(edit, role, row.text)

    def end(self) -> dict[str, Any]:
        cost, letters = self.chart.best()
        self._write(letters)
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.letters), "repaired_sha256": self.digest.hexdigest()}


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "place bigint, edit string, role string, text string"
_KINDS = {"bigint": pa.int64(), "string": pa.string()}


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """A conversation's rows side by side in order, and whether a row is a repeat of an earlier one."""
    text_or = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), text_or(role).alias("role"), text_or(text).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    # one shuffle: rows of a conversation are equal in less than what the window asks for
    same = Window.partitionBy("conv", "present", "role", "text").orderBy("turn")
    return rows.repartition("conv").withColumn("repeat", F.row_number().over(same) > 1).sortWithinPartitions("conv", "turn", "role", "text", "repeat")


def _parsed(df: DataFrame, named: str, fields: str, finish: Callable) -> DataFrame:
    """Runs of rows of one conversation, whatever batches they come in; ``finish`` makes (start, end) functions of a list of results."""
    kinds = [f.split() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, own, current = None, [], None, None
        begin, end = finish(out)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return batch

        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field("conv").type), *((n, _KINDS[k]) for n, k in kinds)])
            for conv, turn, role, text, present, repeat in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "present", "repeat")), strict=True):
                if own is None or conv != current:
                    if own is not None:
                        end(current, own)
                    own, current = begin(conv), conv
                if present:
                    own.add(turn, role, text, repeat)
                if len(out) >= 1000:
                    yield flush()
        if own is not None:
            end(current, own)
        if out:
            yield flush()

    return df.mapInArrow(run, f"conv_id {named}, {fields}")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and the letters of its repair, and the digest of what is repaired.

    Rows for which ``present`` doesn't hold only name their conversation.
    """

    def finish(out: list):
        return lambda _: Repair(), lambda conv_id, own: out.append({"conv_id": conv_id} | own.end())

    return _parsed(_ordered(df, conv, turn, role, text, present), df.schema[conv].dataType.simpleString(), SUMMARY, finish)


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row per edit: place in the repaired conversation (from 0, null for deleted rows), letter, role and text."""

    def finish(out: list):
        def begin(conv_id) -> Repair:
            at = iter(range(1 << 62))
            return Repair(lambda edit, role, text: out.append({"conv_id": conv_id, "place": None if edit == DELETE else next(at), "edit": edit, "role": role, "text": text}))

        return begin, lambda _, own: own.end()

    return _parsed(_ordered(df, conv, turn, role, text, present), df.schema[conv].dataType.simpleString(), TURNS, finish)
