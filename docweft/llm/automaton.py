"""One deterministic automaton for many patterns, that knows where each match begins.

Patterns are made of ASCII characters: literals, escapes, [classes] without ^, groups, |, ?, *, +, {m,n}.
A match is the leftmost one and of those the longest; matches of one pattern don't overlap, those of
different patterns may.

Subset construction: a state has, for every pattern, its attempts in the order of their
beginnings. An attempt is a set of positions in the pattern and a phase: not yet matched, matched earlier, matching
now, or over with a match while an older attempt is still open. A position that an older attempt has as well is
of no use to a younger one, so attempts are few. An attempt that matches ends all younger ones, as they overlap
with it; one that dies after a match reports it as soon as no older one is open.

An attempt's age, the bytes since its beginning, belongs to the state as long as it is at most ``YOUNG``; older
ones keep beginning and end in registers. So short attempts, which are nearly all, cost nothing but the step, and those that
die with a match below the pattern's shortest length of interest aren't reported. What a step does to
registers (an attempt gets one, ends, moves up, reports) is the step's action. Most steps have
none. Minimisation is Moore's refinement over states with their actions.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

OPEN, MATCHED, MATCHING, OVER = range(4)
YOUNG = 4
DIGITS, WORD, SPACE = frozenset(range(48, 58)), frozenset([*range(48, 58), *range(65, 91), 95, *range(97, 123)]), frozenset([32, *range(9, 14)])
SETS, CONTROLS = {"d": DIGITS, "w": WORD, "s": SPACE}, {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


class Pattern(NamedTuple):
    """Steps by position: (bytes, next position), and moves without a byte."""

    steps: list[list[tuple[frozenset[int], int]]]
    free: list[list[int]]
    start: int
    accept: int

    def closed(self, at: Iterable[int]) -> frozenset[int]:
        todo, seen = list(at), set()
        while todo:
            if (p := todo.pop()) not in seen:
                seen.add(p)
                todo += self.free[p]
        return frozenset(seen)

    def moved(self, at: Iterable[int], byte: int) -> frozenset[int]:
        return self.closed(to for p in at for own, to in self.steps[p] if byte in own)


def compiled(pattern: str, any_case: bool = False) -> Pattern:
    """Positions of one pattern, by recursive descent."""
    if not pattern.isascii():
        raise ValueError(f"a pattern has ASCII characters only: {pattern!r}")
    steps, free, at = [], [], 0

    def position() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    def fail(why: str):
        raise ValueError(f"{why} at {at} of {pattern!r}")

    def char() -> frozenset[int]:
        """A character or the set of an escape."""
        nonlocal at
        if at >= len(pattern):
            fail("a character is missing")
        c, at = pattern[at], at + 1
        if c != "\\":
            return frozenset([ord(c)])
        if at >= len(pattern):
            fail("an escape is missing")
        c, at = pattern[at], at + 1
        if c == "x":
            at += 2
            return frozenset([int(pattern[at - 2 : at], 16)])
        if c in SETS:
            return SETS[c]
        if c.isalnum() and c not in CONTROLS:
            fail("an unknown escape")
        return frozenset([CONTROLS.get(c, ord(c))])

    def cased(own: frozenset[int]) -> frozenset[int]:
        return own | {b ^ 32 for b in own if chr(b).isalpha()} if any_case else own

    def members() -> frozenset[int]:
        nonlocal at
        if pattern.startswith("^", at):
            fail("classes of all other characters are not supported")
        own: set[int] = set()
        while not pattern.startswith("]", at) or not own:
            low = char()
            if pattern.startswith("-", at) and not pattern.startswith("-]", at):
                at += 1
                own.update(range(min(low), max(char()) + 1))
            else:
                own |= low
        at += 1
        return frozenset(own)

    def atom() -> tuple[int, int]:
        nonlocal at
        if pattern.startswith("(", at):
            at += 3 if pattern.startswith("(?:", at) else 1
            part = either()
            if not pattern.startswith(")", at):
                fail("a bracket is missing")
            at += 1
            return part
        if pattern[at] in "*+?{.^$":
            fail("not supported here")
        if pattern[at] == "[":
            at += 1
            own = members()
        else:
            own = char()
        if max(own) > 127:
            fail("ASCII characters only")
        a, b = position(), position()
        steps[a].append((cased(own), b))
        return a, b

    def joined(parts: list[tuple[int, int]]) -> tuple[int, int]:
        if not parts:
            return (only := position()), only
        for (_, b), (a, _) in zip(parts, parts[1:]):
            free[b].append(a)
        return parts[0][0], parts[-1][1]

    def optional(part: tuple[int, int]) -> tuple[int, int]:
        a, b = position(), position()
        free[a] += [part[0], b]
        free[part[1]].append(b)
        return a, b

    def looped(part: tuple[int, int]) -> tuple[int, int]:
        free[part[1]].append(part[0])
        return part

    def repeated() -> tuple[int, int]:
        nonlocal at
        began = at
        part = atom()
        if at >= len(pattern) or pattern[at] not in "*+?{":
            return part
        sign, at = pattern[at], at + 1
        if sign != "{":
            return {"+": looped, "?": optional, "*": lambda p: optional(looped(p))}[sign](part)
        close = pattern.index("}", at)
        low, comma, high = pattern[at:close].partition(",")
        least, most = int(low), int(high) if high else None if comma else int(low)

        def again() -> tuple[int, int]:
            nonlocal at
            at = began
            return atom()

        parts = [part if not i else again() for i in range(least)]
        if most is None:
            parts = [*parts[:-1], looped(parts[-1])] if parts else [optional(looped(part))]
        else:
            parts += [optional(part if not least and not i else again()) for i in range(most - least)]
        at = close + 1
        return joined(parts)

    def sequence() -> tuple[int, int]:
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return joined(parts)

    def either() -> tuple[int, int]:
        nonlocal at
        parts = [sequence()]
        while pattern.startswith("|", at):
            at += 1
            parts.append(sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = position(), position()
        for x, y in parts:
            free[a].append(x)
            free[y].append(b)
        return a, b

    start, accept = either()
    if at < len(pattern):
        fail("a bracket is too much")
    return Pattern(steps, free, start, accept)


def longest(p: Pattern, data: bytes) -> int:
    """Length of the longest match at the beginning of data, -1 if there is none."""
    now, best = p.closed([p.start]), -1
    for i, byte in enumerate(data):
        if p.accept in now:
            best = i
        if not (now := p.moved(now, byte)):
            return best
    return len(data) if p.accept in now else best


class Automaton(NamedTuple):
    """``table[state * width + classes[byte]]``: the next state * width, or ~a for action a = (next state * width, reports, registers).

    A report is (pattern, source, end), a register is made of (source, end), or of a list of them for attempts
    that are over. A source is a register's number, or -age for an attempt that has none yet, its age counted with this
    byte. End None is the register's own, True the place of this step. ``last`` has each state's reports at the end of a text.
    """

    classes: bytes
    width: int
    table: np.ndarray
    actions: list[tuple]
    last: list[tuple]


def _step(p: Pattern, attempts: tuple, base: int, shortest: int, move) -> tuple[list, list]:
    """(attempts after a byte with what their registers are made of, reports). Attempts are (phase, positions, age or None)."""
    out, taken = [], frozenset()
    for phase, at, age in [*attempts, (OPEN, p.closed([p.start]), 0)]:
        if age is None:
            source, base = base, base + 1
        else:
            source = -(age + 1)
        if phase == OVER:
            out.append((OVER, frozenset(), None, [(source, None)]))
            continue
        now = move(at) - taken
        taken |= now
        after = MATCHING if p.accept in now else OPEN if phase == OPEN else MATCHED
        end = True if phase == MATCHING and after != MATCHING else None
        if now and age is not None and age < YOUNG and after != MATCHED:
            out.append((after, now, age + 1, None))
        elif now:
            out.append((after, now, None, (source, end)))
        elif phase != OPEN and (age is None or age >= shortest):
            out.append((OVER, frozenset(), None, [(source, end)]))
        if after == MATCHING:
            break
    reports = []
    while out and out[0][0] == OVER:
        reports += out.pop(0)[3]
    merged = []
    for x in out:
        if merged and x[0] == merged[-1][0] == OVER:
            merged[-1] = (OVER, frozenset(), None, merged[-1][3] + x[3])
        else:
            merged.append(x)
    return merged, reports


def build(patterns: list[Pattern], shortest: list[int] | None = None, most: int = 50_000) -> Automaton:
    """The smallest automaton of the patterns; raises where it has more than ``most`` states before minimisation.

    Matches of fewer than ``shortest`` bytes may be left out of the reports; they still hide what they overlap.
    """
    shortest = shortest or [0] * len(patterns)
    for k, p in enumerate(patterns):
        if p.accept in p.closed([p.start]):
            raise ValueError(f"pattern {k} matches the empty text")
    signs = [tuple(byte in own for p in patterns for steps in p.steps for own, _ in steps) for byte in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signs))}
    classes, samples = bytes(kinds[s] for s in signs), [signs.index(s) for s in kinds]
    memo: dict = {}

    def moved(k: int, at: frozenset[int], c: int | None) -> frozenset[int]:
        if c is None:
            return frozenset()
        if (k, at, c) not in memo:
            memo[k, at, c] = patterns[k].moved(at, samples[c])
        return memo[k, at, c]

    def step(state: tuple, c: int | None) -> tuple[tuple, tuple, tuple]:
        base, nxt, reports, registers = 0, [], [], []
        for k, (p, attempts) in enumerate(zip(patterns, state, strict=True)):
            after, told = _step(p, attempts, base, shortest[k], lambda at, k=k: moved(k, at, c))
            base += sum(age is None for *_, age in attempts)
            nxt.append(tuple(x[:3] for x in after))
            registers += [tuple(made) if isinstance(made, list) else made for *_, age, made in after if age is None]
            reports += [(k, *r) for r in told]
        return tuple(nxt), tuple(reports), tuple(registers)

    begin = tuple(() for _ in patterns)
    ids, todo, rows, last, sizes = {begin: 0}, [begin], [], [], []
    while todo:
        state = todo.pop(0)
        row = []
        for c in range(len(samples)):
            nxt, reports, registers = step(state, c)
            if nxt not in ids:
                ids[nxt] = len(ids)
                todo.append(nxt)
                if len(ids) > most:
                    raise ValueError(f"more than {most} states")
            row.append((ids[nxt], reports, registers))
        rows.append(row)
        last.append(step(state, None)[1])
        sizes.append(sum(age is None for attempts in state for *_, age in attempts))
    # Moore: states are alike if their actions are, and what follows is alike
    names: dict = {}
    named = lambda key: names.setdefault(key, len(names))
    acts = [(sizes[s], last[s], tuple(r[1:] for r in row)) for s, row in enumerate(rows)]
    group, count = [named(a) for a in acts], 0
    while count != (count := len(set(group))):
        names = {}
        group = [named((group[s], tuple(group[r[0]] for r in row))) for s, row in enumerate(rows)]
    order = {g: i for i, g in enumerate(dict.fromkeys(group))}  # the first state stays the first
    width, table, actions, known, ends = len(samples), [], [], {}, []
    first = {}
    for s, g in enumerate(group):
        first.setdefault(order[g], s)
    for i in range(len(order)):
        s = first[i]
        ends.append(last[s])
        for nxt, reports, registers in rows[s]:
            to = order[group[nxt]] * width
            if not reports and registers == tuple((j, None) for j in range(sizes[s])):
                table.append(to)
                continue
            act = (to, reports, registers)
            if act not in known:
                known[act] = len(actions)
                actions.append(act)
            table.append(~known[act])
    return Automaton(classes, width, np.array(table, np.int32), actions, ends)


def scan(a: Automaton, table: list[int], data: bytes) -> list[tuple[int, int, int]]:
    """(pattern, start, end) of all matches in data, in one pass over its bytes; ``table`` is a.table as a list."""
    found, registers, state, actions = [], [], 0, a.actions

    def places(source: int, end: bool | None, place: int) -> list[tuple[int, int]]:
        if source < 0:
            return [(place + 1 + source, place if end else -1)]
        own = registers[source]
        return own if isinstance(own, list) else [(own[0], place if end else own[1])]

    def report(reports: tuple, place: int) -> None:
        found.extend((k, *m) for k, source, end in reports for m in places(source, end, place))

    for i, c in enumerate(data.translate(a.classes)):
        state = table[state + c]
        if state < 0:
            state, reports, made = actions[~state]
            if reports:
                report(reports, i)
            registers = [[x for m in own for x in places(*m, i)] if isinstance(own[0], tuple) else places(*own, i)[0] for own in made]
    report(a.last[state // a.width], len(data))
    return found
