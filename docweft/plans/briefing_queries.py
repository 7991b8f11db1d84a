"""Queries over records and drafts. Documents that the tables lack are made of their rows, so that SQL can say what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import briefing as B
from ..operators import records as C
from ..operators import scanners
from .registry import query, table


@query("""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ord, 'Senior Engineer' AS title, 'Order ' || o_orderkey || ' Ltd' AS company,
    CAST(year(o_orderdate) AS VARCHAR) AS start_year, CASE WHEN o_orderkey % 5 = 0 THEN 'Present' ELSE CAST(year(o_orderdate) + 1 AS VARCHAR) END AS end_year, CAST(1 + o_orderkey % 2 AS INTEGER) AS n_duties FROM orders""")
def q_employment_scan(spark, sf_dir):
    """A CV of each customer, a job per order in one of four layouts, read back by the scanner."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    company = F.concat(F.lit("Order "), k.cast("string"), F.lit(" Ltd"))
    dates = F.concat(y.cast("string"), F.lit(" - "), F.when(k % 5 == 0, "Present").otherwise((y + 1).cast("string")))
    role = F.lit("Senior Engineer")
    head = F.when(k % 4 == 0, F.array(F.concat(role, F.lit(" | "), company), dates)).when(k % 4 == 1, F.array(dates, company, role)).when(k % 4 == 2, F.array(role, company, dates)).otherwise(F.array(company, dates, role))
    duties = F.when(k % 2 == 0, F.array(F.lit("- handled it"), F.lit("and went on"))).otherwise(F.array(F.lit("• handled it"), F.lit("• closed it")))
    docs = table(spark, sf_dir, "orders").select("o_custkey", F.struct(k, F.concat(head, duties).alias("lines")).alias("x")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    found = scanners.scan(docs.select(F.col("o_custkey").alias("doc_id"), F.flatten("x.lines").alias("lines")), "employment")
    return found.select("doc_id", "ord", "title", "company", F.col("start").alias("start_year"), F.col("end").alias("end_year"), F.size("duties").alias("n_duties"))


_SETS = """WITH s AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS sv, count(*) FILTER (o_orderstatus = 'P') AS sb, count(*) FILTER (o_orderpriority = '1-URGENT') AS fv, count(*) FILTER (o_orderpriority = '2-HIGH') AS fb, count(*) AS n FROM orders GROUP BY o_custkey)"""


def _sets(spark, sf_dir):
    n = lambda c, v: F.sum((F.col(c) == v).cast("int")).cast("int")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"))
    return o.agg(n("o_orderstatus", "F").alias("s_valid"), n("o_orderstatus", "P").alias("s_bad"), n("o_orderpriority", "1-URGENT").alias("f_valid"), n("o_orderpriority", "2-HIGH").alias("f_bad"), F.count(F.lit(1)).cast("int").alias("n"))


@query(_SETS + """ SELECT k, CASE WHEN sv = 0 AND fv = 0 AND sb = 0 AND fb = 0 THEN 'none' WHEN sv = 0 AND fv = 0 THEN CASE WHEN sb >= fb THEN 'section' ELSE 'fallback' END
    WHEN sv > 0 AND (fv = 0 OR sb <= fb) THEN 'section' WHEN fv > 0 THEN 'fallback' ELSE 'none' END AS selection_source FROM s""")
def q_education_choice(spark, sf_dir):
    s = _sets(spark, sf_dir)
    return s.select("k", C.choose_education(s).alias("selection_source"))


@query(_SETS + """ SELECT k, CASE WHEN sv = 0 AND fv = 0 THEN CASE WHEN 30 * sv + 6 * sb >= 30 * fv + 6 * fb THEN 'section' ELSE 'fallback' END WHEN sv >= 3 AND fb >= 2 THEN 'section'
    WHEN sv > fv THEN 'section' WHEN sv < fv THEN 'fallback' WHEN sb < fb THEN 'section' WHEN sb > fb THEN 'fallback' WHEN 30 * sv + 6 * sb >= 30 * fv + 6 * fb THEN 'section' ELSE 'fallback' END AS selection_source FROM s""")
def q_employment_choice(spark, sf_dir):
    counts = lambda v, b: F.struct(v.alias("valid"), b.alias("malformed"), (30 * v + 6 * b).alias("score"), v.alias("structured"), b.alias("broken"), F.col("n"))
    s = _sets(spark, sf_dir).select("k", counts(F.col("s_valid"), F.col("s_bad")).alias("s"), counts(F.col("f_valid"), F.col("f_bad")).alias("f"))
    return s.select("k", B.choose_employment("s", "f", F.lit(True)).alias("selection_source"))


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS ord, 'part ' || (l_partkey % 3) AS name, CASE WHEN l_quantity > 25 THEN '2020.1' ELSE '2020' END AS s, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE '2021' END AS e, l_returnflag = 'R' AS later, l_extendedprice AS x FROM lineitem),
    r AS (SELECT *, CASE WHEN s = '2020.1' THEN 2 ELSE 1 END + CASE WHEN e = '' THEN 0 ELSE 1 END AS score, min((later, ord, x)) OVER (PARTITION BY doc, name) AS first FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY score DESC, later, ord, x) AS n FROM r)
    SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY first) AS INTEGER) AS place, name, CASE WHEN later THEN 'fallback' ELSE 'section' END AS origin, CAST(score AS INTEGER) AS score FROM b WHERE n = 1""")
def q_project_choice(spark, sf_dir):
    """Two sets of projects per order by name: the better dated one stays, in order of first appearance."""
    late = F.col("l_returnflag") == "R"
    p = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.struct(F.col("l_linenumber"), F.col("l_extendedprice")).alias("ord"), F.concat(F.lit("part "), (F.col("l_partkey") % 3).cast("string")).alias("name"),
        F.when(F.col("l_quantity") > 25, "2020.1").otherwise("2020").alias("start"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("2021").alias("end"), F.array().cast("array<string>").alias("bullets"), late.alias("late"),
    )
    got = C.choose_projects(p.filter(~F.col("late")).drop("late"), p.filter("late").drop("late"), ["doc"])
    return got.select("doc", F.col("ord").alias("place"), "name", "origin", "score")


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS p, l_extendedprice AS x, l_discount * 5 AS s FROM lineitem)
    SELECT k, CAST(count(*) FILTER (s >= 0.2) AS INTEGER) AS n_strengths, CAST(count(*) FILTER (s < 0.2) AS INTEGER) AS n_gaps,
        CASE WHEN count(*) FILTER (s >= 0.2) >= 3 AND count(*) FILTER (s < 0.2) <= 1 THEN 'review' WHEN count(*) FILTER (s >= 0.2) >= 1 THEN 'screen' ELSE 'more review' END AS next_step FROM m GROUP BY k""")
def q_fit_summary(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_extendedprice").alias("place"), F.lit("r").alias("requirement"), F.lit("e").alias("evidence"), (F.col("l_discount") * 5).alias("score"))
    f = B.fit(m, ["k"])
    step = F.when(F.col("next_step") == B.NEXT_STEP[0], "review").when(F.col("next_step") == B.NEXT_STEP[1], "screen").otherwise("more review")
    return f.select("k", "n_strengths", "n_gaps", step.alias("next_step"))


@query("""WITH c AS (SELECT conv_id, turn, text, role FROM conversations)
    SELECT conv_id, turn, regexp_matches(text, '(?i)no gaps?|guarantee|definitely|ideal candidate|perfect fit') AS strong, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM c""")
def q_strong_claims(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", B.strong_claim(F.col("text")).alias("strong"), B.escape_html(F.col("text")).alias("escaped"))
