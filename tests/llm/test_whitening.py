"""Whitening against exact fractions and numpy's own decomposition."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from docweft.llm import queries as Q
from docweft.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component int, n string, whitened string, at int, key string"


def plain(rows, most=16):
    """vec_id -> (deviation, whitened up to sign), n and the shares, from exact sums and products."""
    rows = [(i, v) for i, v in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    width = max((len(v) for _, v in rows), default=0)
    xs = [(i, tuple(floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))])) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(width)] for i in range(width)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = []
    for i, x in xs:
        d = [n * c - s for c, s in zip(x, sums, strict=True)]
        out.append((i, sum(c * c for c in d), np.array([float(Fraction(c, n)) for c in d]) @ u / np.sqrt(e)))
    return out, n, e / np.trace(v)


def check(got, rows):
    want, n, shares = plain(rows)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert len(got) == len(want) * len(shares)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    signs = {}
    for i, deviation, w in want:
        for k, (x, share) in enumerate(zip(w, shares, strict=True), 1):
            for r in by[i, deviation][k]:
                assert abs(r["explained"] - share) <= 1e-9 * share
                signs.setdefault(k, set())
                if abs(x) > 1e-3:
                    signs[k].add(bool(np.sign(x) == np.sign(r["whitened"])))
                assert abs(abs(r["whitened"]) - abs(x)) < 1e-6
    assert all(len(s) == 1 for s in signs.values())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(Q.op11_embedding_whitening(spark, sf).collect(), rows)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "n", "w", 3, "k") for i, v in rows], SCHEMA)


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.4, 5)]) for i in range(60)]
    rows += [(100, None), (101, [None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (104, rows[3][1][:3]), (105, []), (106, [1e4, 2.0, 3.0, 4.0, 5.0])]
    check([r.asDict() for r in whitening.whiten(vectors(spark, rows).repartition(7)).collect()], rows)
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None), (2, [None])])).collect() == []


def test_no_spread_and_great_numbers(spark):
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    flat = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [2.5, 1.0])])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-9
    great = whitening.whiten(vectors(spark, [(1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert {r.vec_id for r in great} == {1, 2, 3} and {r.deviation for r in great if r.vec_id == 1} == {None}
    assert whitening.whiten(vectors(spark, [(1, [])])).collect() == []


def test_merge_is_exact_about_the_shift():
    rng = np.random.default_rng(1)
    z = rng.integers(-30, 30, (1000, 6)) + 10**12
    parts = [whitening.moments(z[i : i + 37]) for i in range(0, 1000, 37)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.merged(p, whole)
    own = z - 10**12
    want = np.cov(own.T, bias=True) * 1000
    assert whole.sums.tolist() == [int(s) + 1000 * 10**12 for s in own.sum(0)] and np.allclose(whole.scatter, want, rtol=1e-12, atol=1e-9)


def test_bytes_come_back():
    rng = np.random.default_rng(2)
    for top in (100, 30_000, 1 << 30, 1 << 62):
        z = rng.integers(-top, top, (50, 7))
        z[::3, 4:] = 0
        z[5] = 0
        assert (whitening.unpacked(whitening.packed(z), 7) == z).all()
