"""Named rules over fields, evaluated in one way and told by their codes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A field that matches ``hit`` (a pattern, or a predicate of one or several fields) breaks the rule, unless it, or the field ``unless_of``, matches ``unless``; with ``lacks``, a field without a match breaks it."""

    code: str
    of: str | tuple[str, ...]
    hit: str | Callable[..., Column]
    unless: str | None = None
    unless_of: str | None = None
    lacks: bool = False


def broken(fields: dict[str, Column], rules: list[Rule]) -> Column:
    """The codes of the rules that the fields break, in order."""

    def breaks(r: Rule) -> Column:
        own = [fields[f] for f in ((r.of,) if isinstance(r.of, str) else r.of)]
        hit = own[0].rlike(r.hit) if isinstance(r.hit, str) else r.hit(*own)
        hit = ~hit if r.lacks else hit
        return hit if r.unless is None else hit & ~fields[r.unless_of or r.of].rlike(r.unless)

    return F.array_compact(F.array(*[F.when(breaks(r), r.code) for r in rules]))
