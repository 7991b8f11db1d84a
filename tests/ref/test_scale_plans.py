"""Retrieval by postings and interval links without pairs, against plain versions; helper columns beside others of their names."""

import random

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import relational as R
from docweft.operators import retrieval, selection

WORDS = "alpha beta gamma delta wallet engine the of x 区块链钱包 平台 node42 Kernel".split()


@pytest.mark.parametrize("k", [1, 3])
def test_retrieval_equals_the_join(spark, monkeypatch, k):
    monkeypatch.setattr(retrieval, "FIRST", 7)
    monkeypatch.setattr(retrieval, "PAIRS", 40)
    rng = random.Random(k)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    lines = [(d, n, text(rng.randint(0, 9))) for d in range(60) for n in range(3)] + [(None, 1, "alpha beta"), (5, None, "gamma"), (7, 7, None)]
    blocks = spark.createDataFrame(lines, "doc_id bigint, line_no int, line string").repartition(3)
    items = spark.createDataFrame([(i, text(rng.randint(1, 8))) for i in range(25)] + [(90, "of"), (91, None)], "item_id bigint, text string")
    bonus = F.when(F.col("line_no") == 0, 0.1).otherwise(0.0)

    def best(most):
        scored = retrieval.best_overlaps(blocks, items, ["doc_id", "line_no"], k, bonus=bonus, most=most).withColumn("score", F.round("score", 6))
        return sorted(map(str, R.top_k(scored, ["item_id"], [F.col("score").desc(), F.col("doc_id"), F.col("line_no")], k).select("item_id", "rank", "doc_id", "line_no", "score").collect()))

    by_postings = best(1000)
    rows = blocks.crossJoin(items).select("item_id", "doc_id", "line_no", T.distinct_tokens(F.col("text")).alias("q"), T.distinct_tokens(F.col("line")).alias("b"), bonus.alias("bonus"))
    scored = rows.withColumn("c", F.size(F.array_intersect("q", "b"))).filter("c > 0").select("item_id", "doc_id", "line_no", F.round(F.col("c") / F.size("q") + F.col("bonus"), 6).alias("score"))
    want = sorted(map(str, R.top_k(scored, ["item_id"], [F.col("score").desc(), F.col("doc_id"), F.col("line_no")], k).select("item_id", "rank", "doc_id", "line_no", "score").collect()))
    assert by_postings == want
    assert retrieval.best_overlaps(blocks.limit(0), items, ["doc_id", "line_no"], k).collect() == [] and retrieval.best_overlaps(blocks, items.limit(0), ["doc_id", "line_no"], k).collect() == []


def plain_links(inner, outer):
    out = []
    for s, i, lo, hi in inner:
        hi = lo if hi is None else hi
        fits = [o for t, o, a, b in outer if s is not None and s == t and None not in (lo, a, b) and a <= lo and hi <= b]
        out.append((s, i, len(fits), fits[0] if len(fits) == 1 else None, len(fits) > 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_interval_links(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([3, 40, 10**12])

    def one(i):
        a = rng.randint(-top, top)
        return (rng.choice([1, 1, 1, 2, None]), i, rng.choice([a, a, a, None]), rng.choice([a, a + rng.randint(0, 9), a + rng.randint(0, top), None]))

    inner, outer = [one(i) for i in range(80)], [one(1000 + i) for i in range(rng.choice([0, 60]))]
    schema = "scope bigint, id bigint, start bigint, end bigint"
    a, b = spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema)
    got = R.interval_candidates(a, b.withColumnRenamed("id", "other"), ["scope"], "id", "other").collect()
    assert sorted(map(tuple, got), key=str) == plain_links(inner, outer)
    assert R.interval_candidates(a.limit(0), b, ["scope"], "id", "id").collect() == []


def test_one_hot_scope(spark):
    """A million intervals of one scope, each within thousands of others."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("scope"), "id", (F.col("id") % 2000).alias("start"), (F.col("id") % 2000 + F.col("id") % 600).alias("end"))
    got = R.interval_candidates(rows, rows.withColumnRenamed("id", "other"), ["scope"], "id", "other")
    total, least = got.agg(F.sum("n_candidates"), F.min("n_candidates")).first()
    import numpy as np

    ids = np.arange(n)
    lo, hi = ids % 2000, ids % 2000 + ids % 600
    count = np.zeros((2000, 2600), np.int64)
    np.add.at(count, (lo, hi), 1)
    inside = count.cumsum(0)[:, ::-1].cumsum(1)[:, ::-1]
    want = inside[lo, hi]
    assert (total, least) == (int(want.sum()), int(want.min()))


def test_columns_of_helpers_stay(spark):
    df = spark.createDataFrame([(1, "a", 7, 3), (1, "b", 8, 4)], "k int, v string, n int, n_ int")
    assert [tuple(r) for r in R.keep_first(df, ["k"], [F.col("v")]).collect()] == [(1, "a", 7, 3)]
    one = spark.createDataFrame([("a", 1, "x")], "key string, at int, new string")
    assert [tuple(r) for r in R.upsert_recent(one, one.withColumn("new", F.lit("y")), "key", "at", 5).collect()] == [("a", 1, "y")]
    files = spark.createDataFrame([(1, "jd.docx", ".docx", 5, "w")], "folder int, name string, extension string, n int, docx string")
    assert selection.file_roles(files, ["folder"]).first().asDict() | {"jd_score": 0, "cv_score": 0} == {"folder": 1, "name": "jd.docx", "extension": ".docx", "n": 5, "docx": "w", "jd_score": 0, "cv_score": 0}


def test_keys_of_requirements_are_made_once(spark):
    from docweft.operators import records

    df = spark.createDataFrame([(1, ["SQL", "Go, Rust", "x"], ["go rust", "sql!", "y"])], "doc_id int, wanted array<string>, offered array<string>")
    got = records.matched(df)
    assert [r.offered_place for r in got.orderBy("place").collect()] == [1, 0, 2]
    # one place for the keys of either list, not one in every comparison of the fold
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4


@pytest.mark.parametrize("name", ["q_candidate_names", "q_role_titles", "q_rich_text", "q_pdf_quality_score"])
def test_a_small_file_is_worked_on_by_all_cores(spark, sf, name):
    from docweft import plans

    assert plans.QUERIES[name](spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_projects_are_dealt_before_they_are_read(spark, sf):
    from docweft import plans

    plan = plans.QUERIES["q_normalised_projects"](spark, sf)._jdf.queryExecution().toString()
    # the table's rows over the cores, then works by their customer; what is told of bullets is told before the last join
    assert "RoundRobinPartitioning" in plan and "REPARTITION_BY_NUM" in plan


def test_tasks_of_projects_and_links_stay_small(spark, monkeypatch):
    """More rows make more tasks, not larger ones (F20, F22), with the same results."""
    from docweft.operators import records
    from docweft.sources import shared

    rng = random.Random(4)
    projects = spark.createDataFrame([(i % 50, i, f"part {rng.randint(0, 3)}", rng.choice(["2020", "2020.1"]), rng.choice(["", "2021"]), ["x"]) for i in range(600)], "doc int, ord int, name string, start string, end string, bullets array<string>")
    spans = spark.createDataFrame([(i % 9, i, a, a + rng.randint(0, 9)) for i in range(400) for a in (rng.randint(0, 60),)], "scope int, id int, start bigint, end bigint")

    def both():
        chosen = records.choose_projects(projects.filter("ord % 3 > 0"), projects.filter("ord % 3 = 0"), ["doc"])
        return chosen, R.interval_candidates(spans, spans.withColumnRenamed("id", "other"), ["scope"], "id", "other")

    want = [sorted(map(str, df.collect())) for df in both()]
    monkeypatch.setattr(shared, "ROWS", 20)
    chosen, linked = both()
    assert [sorted(map(str, df.collect())) for df in (chosen, linked)] == want
    assert chosen.rdd.getNumPartitions() == 30
    # 400 spans on seven levels, in tasks of 20 rows
    assert "hashpartitioning(scope#" in (plan := linked._jdf.queryExecution().toString()) and "140), REPARTITION_BY_NUM" in plan
