"""State over many deliveries: eviction, order, sessions, compaction."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docweft.streaming import keyed, run_log

DAY = datetime(2024, 1, 1)
ROW = "who bigint, thing string, id bigint, at timestamp"


def deliveries(spark, tmp_path, parts, run):
    """Each part is one run over the same checkpoint; what all runs have put out."""
    schema = spark.createDataFrame([], ROW).schema
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = run(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return out


def test_eviction_is_the_same_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(u, f"t{rng.randint(0, 9)}", i, DAY + timedelta(minutes=i // 2)) for i in range(300) for u in (i % 3 or None,)]
    rows += [(1, None, 900, DAY), (1, "x", 901, None)]
    rng.shuffle(rows)
    seen = []

    def run(stream, out, checkpoint):
        found = keyed.newest_entries(stream, "who", F.col("thing"), F.col("at"), F.col("id"), keep=4)
        run_log.changes(found, out, checkpoint, partitions=2)
        run_log.compact(spark, out, found.schema, ["who"])
        seen.append(run_log.written(spark, out, found.schema).count())
        return run_log.newest(run_log.written(spark, out, found.schema), ["who"])

    got = {r.who: r.entries for r in deliveries(spark, tmp_path, [rows[:100], rows[100:220], rows[220:]], run).collect()}
    for user in (None, 1, 2):
        last = {}
        for u, thing, i, at in rows:
            if u == user and thing and at:
                last[thing] = max(last.get(thing, (at, i)), (at, i))
        assert got[user] == sorted(last, key=lambda t: last[t], reverse=True)[:4]
    # after compaction a reader has one row a key, however many batches there were
    assert seen[-1] == 3


def test_answers_in_order_and_late_ones(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    first = [(1, "a", 10, at(1)), (1, "a", 12, at(3)), (1, "a", 11, at(2)), (2, "a", 5, at(2)), (None, "a", 7, at(1))]
    second = [(1, "a", 9, at(30)), (1, "a", 13, at(40)), (None, "a", None, at(41)), (1, "a", 99, None)]
    third = [(1, "a", 3, at(2)), (None, None, None, DAY + timedelta(days=400))]

    def run(stream, out, checkpoint):
        return run_log.changes(keyed.in_order(stream, "who", F.col("id"), F.col("at"), F.col("id"), late="12 hours"), out, checkpoint, "append", 2)

    got = sorted(((r.who, r.id, r.verdict) for r in deliveries(spark, tmp_path, [first, second, third], run).collect()), key=str)
    assert got == sorted([(1, 10, "applied"), (1, 11, "applied"), (1, 12, "applied"), (2, 5, "applied"), (None, 7, "applied"), (1, 9, "stale"), (1, 13, "applied"), (1, 3, "late")], key=str)


@pytest.mark.parametrize("seed", [3])
def test_sessions(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 3), "e", i, DAY + timedelta(seconds=rng.randint(0, 300_000))) for i in range(400)]
    rows.sort(key=lambda r: r[3] + timedelta(hours=rng.random()))
    run = lambda stream, out, checkpoint: run_log.changes(keyed.sessions(stream, "who", "at", F.lit(1), late="2 hours"), out, checkpoint, "append", 2)
    got = sorted((r.who, r.start_us, r.n) for r in deliveries(spark, tmp_path, [rows[:200], rows[200:], [(None, None, None, DAY + timedelta(days=400))]], run).collect())
    want = []
    for user in range(4):
        last = None
        for t in sorted(int(r[3].timestamp() * 1e6) for r in rows if r[0] == user):
            if last is None or t - last > 1_800_000_000:
                want.append([user, t, 0])
            want[-1][2] += 1
            last = t
    assert got == [tuple(w) for w in want]


def test_compaction_survives_a_stop(spark, tmp_path):
    """A reader takes a compacted folder and what is after it, also while older folders are still there."""
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for n, v in enumerate("abc"):
        rows.withColumn("v", F.lit(v)).withColumn("batch", F.lit(n)).write.parquet(f"{tmp_path}/epoch={n}")
    rows.withColumn("v", F.lit("b")).withColumn("batch", F.lit(1)).write.parquet(f"{tmp_path}/epoch=-2")
    assert [tuple(r) for r in run_log.newest(run_log.written(spark, str(tmp_path), rows.schema), ["k"]).collect()] == [(1, "c")]
    assert run_log.written(spark, str(tmp_path), rows.schema).count() == 2
    run_log.compact(spark, str(tmp_path), rows.schema, ["k"])
    assert run_log._epochs(spark, str(tmp_path)) == [-3] and run_log.written(spark, str(tmp_path), rows.schema).count() == 1
    assert run_log.written(spark, f"{tmp_path}/none", rows.schema).count() == 0


class Handle:
    """State of one bucket; counts how often it is asked or told."""

    def __init__(self):
        self.value, self.rows, self.calls, self.timers, self.now = {}, [], 0, [], 0

    def getValueState(self, name, schema, ttl=None):
        return State(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def exists(self):
        return self.name in self.handle.value

    def get(self):
        self.handle.calls += 1
        return self.handle.value.get(self.name, [])

    def update(self, value):
        self.handle.calls += 1
        self.handle.value[self.name] = value

    put = update

    def appendList(self, rows):
        self.handle.calls += 1
        self.handle.value.setdefault(self.name, []).extend(rows)

    def clear(self):
        self.handle.value.pop(self.name, None)


def test_state_is_asked_once_a_bucket(spark):
    """Fetches of state don't grow with the keys (F15, F19)."""
    import pandas as pd

    rng, users = random.Random(2), 300
    rows = [(f"={rng.randrange(users)}", rng.randrange(10**6, 2 * 10**6), rng.randrange(2**62, 2**62 + 50), i) for i in range(3000)]
    frames = [pd.DataFrame(rows[i : i + 700], columns=["who", "at_us", "sequence", "id"]) for i in range(0, 3000, 700)]
    state, order = Handle(), keyed._InOrder("who")
    order.init(state)
    state.now = 0
    assert list(order.handleInputRows((0,), iter(frames), state)) == []
    got = []
    for state.now in (1500, 1500, 3000):  # what the watermark hasn't passed waits
        got += [tuple(r) for b in order.handleExpiredTimer((0,), state, None) for r in b[["who", "id", "verdict"]].itertuples(index=False)]
    want, highest = [], {}
    for who, _, sequence, number in sorted(rows, key=lambda r: r[1:]):
        want.append((who, number, "stale" if sequence < highest.get(who, sequence) else "applied"))
        highest[who] = max(sequence, highest.get(who, sequence))
    assert sorted(got) == sorted(want) and "waiting" not in state.value and state.calls < 20

    state, newest = Handle(), keyed._Newest("who", 3, 1000)
    newest.init(state)
    touched = pd.DataFrame([(w, str(n % 7), at, n) for w, at, _, n in rows], columns=["who", "entry", "at_us", "number"])
    out = pd.concat([pd.concat(newest.handleInputRows((0,), iter([b]), state)) for b in (touched[:1500], touched[1500:])])
    got = dict(zip(out["who"], zip(out["entries"], out["ats"], strict=True), strict=True))
    for who in {r[0] for r in rows}:
        last = {}
        for w, at, _, n in rows:
            if w == who:
                last[str(n % 7)] = max(last.get(str(n % 7), (at, n)), (at, n))
        best = sorted(last, key=lambda e: last[e], reverse=True)[:3]
        assert got[who] == (best, [last[e][0] for e in best])
    assert state.calls < 6
    # what other keys of the bucket do keeps no entry alive
    state.now = 900
    (out,) = newest.handleInputRows((0,), iter([pd.DataFrame([("=x", "a", 1, 1)], columns=touched.columns)]), state)
    state.now = 1500
    (out,) = newest.handleInputRows((0,), iter([pd.DataFrame([("=y", "b", 1, 1)], columns=touched.columns)]), state)
    assert list(out["who"]) == ["=y"] and sorted(state.value["newest"][0]) == ["=x", "=y"]
