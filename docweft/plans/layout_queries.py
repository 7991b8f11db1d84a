"""Employment sections in ten layouts, made of orders, parts and suppliers, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scanners
from .registry import query, table

#: Rows of a customer's CV: one job an order, its title from a part, its company from a supplier, its dates from the order.
_JOBS = """WITH l AS (SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey),
    j AS (SELECT o_custkey AS doc_id, o_orderkey AS k, (SELECT string_agg(upper(w[1]) || w[2:], ' ' ORDER BY i) FROM (SELECT unnest(string_split(coalesce(p_name, 'general'), ' ')) AS w, generate_subscripts(string_split(coalesce(p_name, 'general'), ' '), 1) AS i)) || ' Engineer' AS title,
        replace(coalesce(s_name, 'Own'), '#', ' ') || ' Ltd' AS company, CAST(year(o_orderdate) AS VARCHAR) AS start_year, CASE WHEN o_orderkey % 3 = 0 THEN 'Present' ELSE CAST(year(o_orderdate) + 1 AS VARCHAR) END AS end_year,
        CASE WHEN o_orderkey % 2 = 0 THEN 'Handled order ' || o_orderkey || ' and its papers' ELSE 'Handled order ' || o_orderkey || '|Closed it.' END AS duties
        FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk LEFT JOIN supplier ON s_suppkey = sk),
    r AS (SELECT doc_id, k, 0 AS sub, title, company, start_year, end_year, duties FROM j
        UNION ALL SELECT doc_id, k, 1, 'Senior ' || title, company, start_year, end_year, '' FROM j WHERE k % 10 = 9)"""


def cv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the lines of its employment section."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"), F.min("l_suppkey").alias("s_suppkey"))
    o = table(spark, sf_dir, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    o = o.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "left").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    title = F.concat(F.initcap(F.coalesce("p_name", F.lit("general"))), F.lit(" Engineer"))
    company = F.concat(F.replace(F.coalesce("s_name", F.lit("Own")), F.lit("#"), F.lit(" ")), F.lit(" Ltd"))
    dates = F.concat(year, F.lit(" - "), F.when(k % 3 == 0, "Present").otherwise((F.year("o_orderdate") + 1).cast("string")))
    row = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    ways: list[list[Column]] = [
        [row(title, " | ", company), dates], [dates, company, title], [title, company, dates], [company, dates, title], [company, title, dates], [row(company, " ", dates), title],
        [dates, row(company, " | ", title)], [title, F.lit("Singapore"), row(company, " | ", dates)], [row(title, " | ", company, " | ", dates)], [row(dates, " ", company), row(dates, " ", title), row(dates, " Senior ", title)],
    ]
    head = F.array(*ways[-1])
    for i, lines in enumerate(ways[:-1]):
        head = F.when(k % 10 == i, F.array(*lines)).otherwise(head)
    duties = F.when(k % 2 == 0, F.array(row("- Handled order ", k.cast("string")), F.lit("and its papers"))).otherwise(F.array(row("• Handled order ", k.cast("string")), F.lit("• Closed it.")))
    # a customer is one document
    docs = o.select("o_custkey", F.struct(k, F.concat(head, duties).alias("lines")).alias("x")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return docs.select(F.col("o_custkey").alias("doc_id"), F.concat(F.array(F.lit("Employment Experience")), F.flatten("x.lines")).alias("lines"))


@query(_JOBS + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, sub) - 1 AS INTEGER) AS ord, title, company, start_year, end_year, duties FROM r")
def q_employment_layouts(spark, sf_dir):
    """Ten layouts, role groups among them, read back by the segmentation of whole sections."""
    found = scanners.scan(cv_lines(spark, sf_dir), "employment")
    return found.select("doc_id", "ord", "title", "company", F.col("start").alias("start_year"), F.col("end").alias("end_year"), F.array_join("duties", "|").alias("duties"))
