"""Repairs against a search of all edits, and against a plain fold that keeps whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from docweft.llm import conversation_repair as R
from docweft.llm import queries as Q

WHOLE = re.compile(r"(s?(ua)+)?\Z")


def marked(rows):
    """(role, text, fault or None) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def every(rows, inserts):
    """All ways to edit few rows, with at most ``inserts`` insertions in a row: the cheapest (cost, audit, repaired)."""
    best = None
    choices = [[("D", 2, None)] + ([] if f in ("blank", "duplicate") else [("K", 5 * (f == "truncated"), (r, t))] + [("R", 1 + 5 * (f == "truncated"), (to, t)) for to in ("user", "assistant")]) for r, t, f in rows]
    gaps = [tuple(("I", 5, (to, "")) for to in own) for n in range(inserts + 1) for own in itertools.product(("user", "assistant"), repeat=n)]
    for picks in itertools.product(*choices):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            edits = [*filled[0], *(e for p, g in zip(picks, filled[1:], strict=True) for e in (p, *g))]
            made = [m for *_, m in edits if m]
            if WHOLE.match("".join(r[:1] or "?" for r, _ in made)):
                key = (sum(c for _, c, _ in edits), "".join(e for e, *_ in edits), "\n".join(f"{r}:{t}" for r, t in made))
                best = min(best, key) if best else key
    return best


def folded(rows):
    """The same by a fold over four states, with whole audits and texts."""
    inf = (10**9, "", ())
    plus = lambda v, cost, edit, made=None: (v[0] + cost, v[1] + edit, v[2] + ((made,) if made else ())) if v[0] < 10**9 else inf

    def inserted(st):
        for _ in range(3):
            st["U"] = min(st["U"], *(plus(st[x], 5, "I", ("user", "")) for x in "ZSA"))
            st["A"] = min(st["A"], plus(st["U"], 5, "I", ("assistant", "")))
        return st

    st = inserted({"Z": (0, "", ()), "S": inf, "U": inf, "A": inf})
    for role, text, fault in rows:
        new = {x: plus(v, 2, "D") for x, v in st.items()}
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            if role[:1] == "s":
                new["S"] = min(new["S"], plus(st["Z"], more, "K", (role, text)))
            for to, name, before in (("U", "user", "ZSA"), ("A", "assistant", "U")):
                for x in before:
                    new[to] = min(new[to], plus(st[x], 1 + more, "R", (name, text)))
                    if role[:1] == to.lower():
                        new[to] = min(new[to], plus(st[x], more, "K", (role, text)))
        st = inserted(new)
    cost, audit, made = min(st["Z"], st["A"])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)


def summary(turns, rows):
    faults = marked(rows)
    count = lambda k: sum(f == k for *_, f in faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
    own = [t for t in turns if t is not None]
    cost, audit, text = folded(faults)
    return (max(own) - min(own) + 1 - len(set(own)) if own else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_query(data):
    convs = {}
    for r in data:
        rows = convs.setdefault(r["conv_id"], [])
        space = lambda v: " " if v is None else v
        fault = zlib.crc32(f"{space(r['conv_id'])}:{space(r['turn'])}".encode()) % 20
        role, text = "user" if fault == 4 else space(r["role"]), space(r["text"])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(r["turn"], role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        out.append((conv, *summary([t for t, *_ in rows], [x[1:] for x in rows])))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    data = [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = [tuple(r) for r in Q.op13_conversation_repair(spark, sf).select("conv_id", *COLUMNS).collect()]
    assert sorted(got, key=str) == plain_query(data)


def run(rows):
    """The chart over marked rows."""
    own, told = R.Repair(), []
    own.tell = lambda edit, role, text: told.append((edit, role, text))
    for k, (role, text, fault) in enumerate(rows):
        own.add(k, role, text, fault == "duplicate")
    got = own.end()
    return got["cost"], got["audit"], "\n".join(f"{r}:{t}" for e, r, t in told if e != "D"), got["repaired_sha256"]


def test_against_every_edit():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(0, 3)
        rows = marked([(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["a.", "b", " ", "c!", "a."])) for _ in range(n)])
        want = every(rows, 2 if n < 3 else 1)
        assert folded(rows) == want
        assert run(rows)[:3] == want, rows


@pytest.mark.parametrize("wait", [1, 2, 32])
def test_against_the_fold(monkeypatch, wait):
    monkeypatch.setattr(R.Repair, "WAIT", wait)
    rng = random.Random(wait)
    for _ in range(400):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["system"], ["tool", "", "user"], ["assistant", "user", "user", "s"]])
        rows = marked([(rng.choice(roles), rng.choice(["a.", "b", " ", "c!", "d?", f"{rng.random()}."])) for _ in range(rng.randint(0, 60))])
        cost, audit, text = folded(rows)
        assert run(rows) == (cost, audit, text, hashlib.sha256(text.encode()).hexdigest())


def test_long_conversations():
    """Settled on the way where only one reading stays; else in time that grows with the rows."""
    rng, own, held = random.Random(1), R.Repair(), 0
    for i in range(30_000):
        own.add(i, "assistant" if i % 2 and rng.random() < 0.99 else "user", f"{i}.", False)
        held = max(held, len(own.rows))
    assert held < 3000 and len(own.end()["audit"]) >= 30_000
    own, rows = R.Repair(), marked([(("user", "assistant", "user")[i % 3], f"{i}.") for i in range(5000)])
    for i, (role, text, _) in enumerate(rows):
        own.add(i, role, text, False)
    cost, audit, text = folded(rows)
    got = own.end()
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, present string, repeat int, place int, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", 1, 2, "a") for r in rows], SCHEMA)


def test_edges(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (None, 0, "user", "x."), (None, None, None, None), (None, 1, "assistant", None), (2, None, "user", "a."), (2, None, "assistant", "b."), (2, 5, "user", "a."), (3, 0, "assistant", "z" * 300_000 + "."), (3, 0, "assistant", "z" * 300_000 + "."), (4, 3, "", "."), (4, 9, "user", "　"), (5, -2, "user", "q"), (5, 7, "user", "q")]
    rows += [(6, i, "user" if i % 2 else "assistant", f"{i}!") for i in range(300)]
    df = frame(spark, rows)
    got = sorted((tuple(r) for r in R.repair(df).select("conv_id", *COLUMNS).collect()), key=str)
    want = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in ((a, b, c or " ", d or " ") for a, b, c, d in rows) if r[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        want.append((conv, *summary([t for t, *_ in own], [x[1:] for x in own])))
    assert got == sorted(want, key=str)
    turns = R.repaired_turns(df).filter("conv_id = 1").orderBy("place").select("place", "edit", "role", "text").collect()
    assert [tuple(t) for t in turns] == [(0, "K", "system", "Be kind."), (1, "K", "user", "Why?"), (2, "K", "assistant", "So.")]
    assert R.repair(df.limit(0)).collect() == [] and R.repaired_turns(df.limit(0)).collect() == []
    gone = R.repair(df.filter("conv_id in (1, 2)"), present=F.col("conv_id") == 2).filter("conv_id = 1").collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_shuffle(spark, sf):
    plan = Q.op13_conversation_repair(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
