"""Keyed state over event time: newest entries with eviction, answers that overtake each other, sessions, decisions that meet their issues.

State lies in RocksDB, by key or bucket of keys. Each function gives a stream; ``run_log.changes`` runs it and
keeps what its batches put out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NONE = -(1 << 63)
BUCKETS, BUCKET = 512, "__bucket"
HELD = ["who", "entry", "at", "number", "written"]
NEWEST = "who array<string>, entry array<string>, at array<bigint>, number array<bigint>, written array<bigint>"
WAITING = "who array<string>, at_us array<bigint>, sequence array<bigint>, id array<bigint>"


def _sealed(c: str) -> Column:
    """A key as text that is never null: pandas would take a batch of numbers with a null among them for floats, and each null for a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)


def _opened(df: DataFrame, c: str, kind: str) -> DataFrame:
    return df.withColumn(c, F.when(F.col(c) != "", F.substring(F.col(c), F.lit(2), F.char_length(c))).cast(kind))


def _bucket(c: str, buckets: int) -> Column:
    """A state holds the keys of a bucket: Python is called, and state is fetched, once a bucket and batch, however many keys there are."""
    return F.pmod(F.xxhash64(F.col(c)), F.lit(buckets)).cast("int").alias(BUCKET)


def _starts(codes: np.ndarray) -> np.ndarray:
    """Whether each of sorted codes is the first of its kind."""
    return np.append(True, codes[1:] != codes[:-1])[: len(codes)]


class _Newest(StatefulProcessor):
    """For each key of a bucket at most ``keep`` entries, newest first; an entry that is named again moves up, what falls off the end is evicted."""

    def __init__(self, named: str, keep: int, ttl_ms: int | None):
        self.named, self.keep, self.ttl_ms = named, keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", NEWEST, self.ttl_ms) if self.ttl_ms else handle.getValueState("newest", NEWEST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, touched = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0, set()
        held = pd.DataFrame(dict(zip(HELD, self.state.get() if self.state.exists() else [[]] * len(HELD), strict=True))).astype({"at": "int64", "number": "int64", "written": "int64"})
        if self.ttl_ms:
            held = held[held["written"] > now - self.ttl_ms]
        for b in rows:
            touched.update(b[self.named])
            new = pd.DataFrame({"who": b[self.named], "entry": b["entry"], "at": b["at_us"], "number": b["number"], "written": now})
            # never more than the lists and a batch in memory, however many rows a key has
            held = self._cut(pd.concat([held, new], ignore_index=True) if len(held) else new)
        held.loc[held["who"].isin(touched), "written"] = now
        self.state.update(tuple(held[c].tolist() for c in HELD))
        out = held[held["who"].isin(touched)]
        begins = np.flatnonzero(_starts(pd.factorize(out["who"])[0]))
        parts = lambda c: [out[c].iloc[i:j].tolist() for i, j in zip(begins, [*begins[1:], len(out)], strict=True)]
        yield pd.DataFrame({self.named: out["who"].to_numpy()[begins], "entries": parts("entry"), "ats": parts("at")})

    def _cut(self, f: pd.DataFrame) -> pd.DataFrame:
        who, entry, at, number = pd.factorize(f["who"])[0], pd.factorize(f["entry"], sort=True)[0], f["at"].to_numpy(), f["number"].to_numpy()
        newest = np.lexsort((~number, ~at, entry, who))
        newest = newest[_starts(who[newest]) | _starts(entry[newest])]
        order = newest[np.lexsort((entry[newest], ~number[newest], ~at[newest], who[newest]))]
        first = _starts(who[order])
        place = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        return f.iloc[order[place < self.keep]].reset_index(drop=True)

    def close(self) -> None:
        pass


def newest_entries(stream: DataFrame, key: str, entry: Column, at: Column, number: Column, keep: int = 12, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, entries and ats (microseconds), newest first: the ``keep`` entries of each key that were touched last.

    An entry counts once, by its last touch; ties of time go to the larger number. In update mode a batch puts out the keys that it has
    touched. The order of arrival changes nothing: what was evicted was older than ``keep`` others, and stays so. With
    ``ttl_ms`` the entries of a key go that was not written for so long by the clock. State lies in ``buckets`` of keys, whose number stays with a checkpoint.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(_sealed(key), entry.cast("string").alias("entry"), F.unix_micros(at).alias("at_us"), F.coalesce(number.cast("bigint"), F.lit(NONE).cast("bigint")).alias("number")).filter("entry is not null and at_us is not null")
    out = f"{key} string, entries array<string>, ats array<bigint>"
    dealt = rows.select("*", _bucket(key, buckets)).groupBy(BUCKET)
    return _opened(dealt.transformWithStateInPandas(_Newest(key, keep, ttl_ms), out, "Update", "ProcessingTime" if ttl_ms else "None"), key, kind)


class _InOrder(StatefulProcessor):
    """Answers of a bucket of keys wait until the watermark has passed them, then go in order of the time they were seen."""

    def __init__(self, named: str):
        self.named = named

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.highest = handle.getValueState("highest", "who array<string>, sequence array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark, late, soonest = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for b in rows:
            b = b[(b["at_us"] != NONE) & (b["sequence"] != NONE)]
            after = b["at_us"] < mark
            if after.any():
                late.append(pd.DataFrame({self.named: b[self.named], "id": b["id"], "verdict": "late"})[after])
            held = b[~after]
            if len(held):
                self.waiting.appendList([tuple(held[c].tolist() for c in (self.named, "at_us", "sequence", "id"))])
                soonest.append(int(held["at_us"].min()))
        if soonest:
            self.handle.registerTimer(-(-min(soonest) // 1000))
        yield from late

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = list(self.waiting.get())
        who = np.array([w for p in parts for w in p[0]], object)
        at, sequence, number = (np.array([x for p in parts for x in p[i]], np.int64) for i in (1, 2, 3))
        ready = at <= mark
        if not ready.any():
            return
        rest = tuple(x[~ready].tolist() for x in (who, at, sequence, number))
        who, at, sequence, number = (x[ready] for x in (who, at, sequence, number))
        highest = dict(zip(*self.highest.get(), strict=True)) if self.highest.exists() else {}
        codes, names = pd.factorize(who)
        order = np.lexsort((number, sequence, at, codes))
        codes, sequence = codes[order], sequence[order]
        before = np.array([highest.get(w, NONE) for w in names], np.int64)
        reached = np.maximum(pd.Series(sequence).groupby(codes).cummax().to_numpy(), before[codes])
        first = _starts(codes)
        known = np.where(first, before[codes], np.append(NONE, reached[:-1]))
        highest.update(zip(names, reached[np.append(first[1:], True)].tolist(), strict=True))
        self.highest.update((list(highest), list(highest.values())))
        if rest[0]:
            self.waiting.put([rest])
            self.handle.registerTimer(-(-min(rest[1]) // 1000))
        else:
            self.waiting.clear()
        yield pd.DataFrame({self.named: who[order], "id": number[order], "verdict": np.where(sequence < known, "stale", "applied")})

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, scope: str, sequence: Column, at: Column, number: Column, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """scope, id and verdict of each answer: applied; stale, where one of a later request was seen before; late, where it came after the watermark.

    Answers are judged in the order of ``at``, then sequence, whatever order they come in, as
    soon as the watermark has passed them; only those after it are state, and the highest sequence of each scope. Answers without a time or a sequence are left out.
    State lies in ``buckets`` of scopes, whose number stays with a checkpoint.
    """
    marked = stream.withColumn("__seen", at).withWatermark("__seen", late)
    # without its marked column, so that late answers reach the processor and are told
    # (nulls as a number, and not filtered here: a filter would go below the watermark and hide its rows from it)
    none = F.lit(NONE).cast("bigint")
    rows = marked.select(_sealed(scope), F.coalesce(F.unix_micros(F.expr("__seen + interval 0 seconds")), none).alias("at_us"), F.coalesce(sequence.cast("bigint"), none).alias("sequence"), F.coalesce(number.cast("bigint"), none).alias("id"))
    kind = stream.schema[scope].dataType.simpleString()
    dealt = rows.select("*", _bucket(scope, buckets)).groupBy(BUCKET)
    return _opened(dealt.transformWithStateInPandas(_InOrder(scope), f"{scope} string, id bigint, verdict string", "Append", "EventTime"), scope, kind)


def sessions(stream: DataFrame, key: str, at: str, value: Column, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """key, start_us, end_us (of the last event), n and total: runs of events with no gap as long as ``gap``; in append mode, as the watermark closes them."""
    marked = stream.withColumn("__value", value).withWatermark(at, late)
    seen = marked.groupBy(key, F.session_window(at, gap).alias("session")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), F.sum("__value").alias("total"))
    return seen.select(key, F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"), "n", "total")


def decided(issues: DataFrame, decisions: DataFrame, scope: str, raised_at: str, decided_at: str, expiry: str = "3 days", late: str = "1 day") -> DataFrame:
    """Issues with each decision on them that came within ``expiry``; those without one come out, with nulls, when it has passed.

    Two streams with a watermark each: state holds the issues that can still be decided and the decisions whose issue can still come.
    """
    i = issues.withWatermark(raised_at, late).alias("i")
    d = decisions.withWatermark(decided_at, late).select(F.col(scope).alias("d_scope"), F.col("issue_key").alias("d_key"), "decision_type", decided_at).alias("d")
    within = F.expr(f"d.{decided_at} >= i.{raised_at} and d.{decided_at} <= i.{raised_at} + interval {expiry}")
    joined = i.join(d, (F.col(f"i.{scope}") == F.col("d_scope")) & (F.col("i.issue_key") == F.col("d_key")) & within, "left_outer")
    return joined.drop("d_scope", "d_key")


def first_decision(found: DataFrame, scope: str, raised_at: str, decided_at: str) -> DataFrame:
    """One row an issue: its first decision, whatever order decisions came in."""
    rest = [c for c in found.columns if c not in (scope, "issue_key", raised_at, "decision_type", decided_at)]
    best = F.min_by("decision_type", F.struct(decided_at, "decision_type")).alias("decision_type")
    return found.groupBy(scope, "issue_key").agg(*[F.any_value(c).alias(c) for c in rest], best)
