"""The combined automaton against regular expressions one after another, and against a search of all spans."""

import hashlib
import random
import re

import pytest

from docweft.llm import automaton, secret_scan
from docweft.llm import queries as Q

RULES = secret_scan.BASE + secret_scan.MORE
SINGLE = [re.compile(f"{r.head}({r.tail})", (re.I if r.any_case else 0) | re.A) for r in RULES]


def plain(text):
    """(kind, start, end) of all rules, each with its own expression."""
    out = []
    for k, (rule, one) in enumerate(zip(RULES, SINGLE, strict=True)):
        tail = 2 if rule.kind == "assign" else 1
        out += [(m.start(), k, m.end()) for m in one.finditer(text) if len(m.group(tail)) >= rule.least]
    return [(RULES[k].kind, s, e) for s, k, e in sorted(out)]


def row(doc_id, text):
    spans = plain(text or "")
    told = lambda own: ",".join(f"{k}:{s}:{e}" for k, s, e in own)
    base = [x for x in spans if x[0] in ("assign", "access", "hex")]
    return (doc_id, *(sum(x[0] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(told(base).encode()).hexdigest(), told(spans))


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in Q.op12_secret_scan(spark, sf).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()]
    assert sorted(got) == sorted(row(*d) for d in docs)


def test_edges(spark):
    key = "password: 'abcdefgh12'"
    texts = [None, "", "   \n", key, key, "é漢" + key + "漢" + "0" * 40, "a" * 1_000_000, " " * 500_000 + key, "token" * 1000 + "=" * 1000, "AKIAAKIA" + "Z" * 20 + "akia", "\x00" * 3 + "ghp_" + "a1" * 20]
    texts += ["secret=token=abcdefgh", "API-KEY=abcdefgh", "ApIkEy \t=abcdefgh", "api_key  :  abcdefgh", "token=\"'abcdefgh", "x" * 70_000 + "deadbeef" * 4 + "é", "eyJa.b.c eyJ" + "a" * 30 + ".b-._", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "tokenſecret=abcdefgh", "AKIA" * 3, "AKIA" + "0" * 12]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, key), (3, key)]
    df = spark.createDataFrame([(i, t, "s", 1, "d") for i, t in rows], "doc_id bigint, text string, spans string, kind int, data string")
    got = sorted(((r.doc_id, [(s.kind, s.start, s.stop) for s in r.spans]) for r in secret_scan.find(df).collect()), key=str)
    assert got == sorted(((i, plain(t or "")) for i, t in rows), key=str)
    assert secret_scan.find(df.limit(0)).collect() == []


def test_mixed_fragments():
    scanner, rng = secret_scan.Scanner(RULES), random.Random(4)
    parts = ["password", "passwd", "secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "AKI", "0123456789abcdef", "XYZ09", "é", "\n", "==", "deadbeef" * 4, "A" * 5, "漢", "pass", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ghp_", "eyJ", "a" * 36]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        assert [(RULES[k].kind, s, e) for k, s, e in scanner.spans(text.encode())] == plain(text), text


def leftmost_longest(one, text):
    out, at = [], 0
    while at < len(text):
        ends = [e for e in range(at + 1, len(text) + 1) if one.fullmatch(text, at, e)]
        if ends:
            out.append((at, max(ends)))
        at = max(ends, default=at + 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_any_patterns_together(seed):
    rng = random.Random(seed)

    def made(depth=0):
        pick = rng.random()
        if depth > 2 or pick < 0.4:
            return rng.choice(["a", "b", "c", "[ab]", "[a-c]", r"\x61"])
        if pick < 0.6:
            return made(depth + 1) + made(depth + 1)
        if pick < 0.75:
            return f"({made(depth + 1)}|{made(depth + 1)})"
        return f"({made(depth + 1)})" + rng.choice(["?", "*", "+", "{2}", "{1,3}", "{2,}"])

    for _ in range(40):
        patterns = [made() + rng.choice(["a", "b", "c"]) for _ in range(rng.randint(1, 3))]
        a = automaton.build([automaton.compiled(p) for p in patterns])
        table = a.table.tolist()
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))
            want = sorted((k, *m) for k, p in enumerate(patterns) for m in leftmost_longest(re.compile(p), text))
            assert sorted(automaton.scan(a, table, text.encode())) == want, (patterns, text)


def test_automaton_is_minimal():
    """Equal patterns written in two ways give automata of one size."""
    sizes = [len(automaton.build([automaton.compiled(p)]).last) for p in ("(ab|ac)d", "a[bc]d", "a(b|c|b)d")]
    assert len(set(sizes)) == 1


@pytest.mark.parametrize("pattern", ["a*", "[^a]b", "(a", "a)", "é", r"\q", ".", "^a", "*a"])
def test_what_is_not_supported(pattern):
    with pytest.raises(ValueError):
        automaton.build([automaton.compiled(pattern)])
