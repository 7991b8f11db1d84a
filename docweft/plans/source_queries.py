"""Queries over payloads of unknown shape, data sources and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coerce, table_functions
from ..sources import data_source
from .file_queries import _WRITTEN, _folder
from .layout_queries import _JOBS, cv_lines
from .registry import query, table


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, count(*) OVER (PARTITION BY o_custkey) AS n, year(o_orderdate) AS y, o_orderpriority AS p, o_orderstatus AS s FROM orders),
    e AS (SELECT o_custkey, ord, 'Agent ' || p AS job_title, 'Unit ' || s AS company_name, CASE k % 4 WHEN 0 THEN CAST(y AS VARCHAR) || '.05' ELSE CAST(y AS VARCHAR) END AS start_date, CASE k % 4 WHEN 1 THEN CAST(y + 1 AS VARCHAR) WHEN 0 THEN 'Present' ELSE '' END AS end_date,
        CASE k % 4 WHEN 0 THEN 'order ' || k || '|closed' WHEN 1 THEN 'order ' || k || '|open' ELSE '' END AS duties, CAST(CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_refs FROM o WHERE k % 4 <> 3 AND o_custkey % 17 <> 0)
    SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY ord) - 1 AS INTEGER) AS place, job_title, company_name, start_date, end_date, duties, n_refs FROM e""")
def q_coerced_payloads(spark, sf_dir):
    """Employment rows out of payloads that spell keys in three ways, give one thing or a list, ranges or dates; every seventeenth is no JSON."""
    o = table(spark, sf_dir, "orders")
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    title, unit = F.concat(F.lit("Agent "), "o_orderpriority"), F.concat(F.lit("  Unit  "), "o_orderstatus")
    said = lambda *cols: F.to_json(F.struct(*cols))
    order = F.concat(F.lit("order "), k.cast("string"))
    one = (
        F.when(k % 4 == 0, said(title.alias("job_title"), unit.alias("company_name"), F.concat(year.cast("string"), F.lit(".05")).alias("start_date"), F.lit("Present").alias("end_date"), F.array(F.concat(F.lit("- "), order), F.lit(" "), F.lit("closed")).alias("responsibilities")))
        .when(k % 4 == 1, said(title.alias("jobTitle"), F.lit("").alias("company_name"), unit.alias("companyName"), F.concat(year.cast("string"), F.lit(" - "), (year + 1).cast("string")).alias("dates"), F.concat(F.lit("• "), order, F.lit("\nopen\n")).alias("responsibilities")))
        .when(k % 4 == 2, said(title.alias("title"), unit.alias("employer"), year.alias("startDate"), F.struct(F.lit("CV").alias("source")).alias("evidenceRefs")))
        .otherwise(said(F.lit("nothing here").alias("remark"), F.array().cast("array<string>").alias("responsibilities")))
    )
    payloads = o.select("o_custkey", F.struct(k, one.alias("one")).alias("x")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    # a single row is given as it is, several as a list
    inner = F.when(F.size("x") == 1, F.get("x.one", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("x.one", ","), F.lit("]")))
    whole = F.concat(F.lit('{"employment_history": '), inner, F.when(F.col("o_custkey") % 17 == 0, "").otherwise("}"))
    got = coerce.rows(payloads.select("o_custkey", whole.alias("payload")), "payload", "employment_history", "o_custkey")
    return got.select("o_custkey", "place", "job_title", "company_name", "start_date", "end_date", F.array_join("responsibilities", "|").alias("duties"), F.size("evidence_refs").alias("n_refs"))


@query("""SELECT event_type, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS low, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS high, count(*) AS n, 'OBJECT<k: BIGINT>' AS found, CAST(0 AS BIGINT) AS n_broken FROM events GROUP BY event_type""")
def q_variant_props(spark, sf_dir):
    """The schema of all properties of a kind of event, found by aggregation, and their range."""
    e = table(spark, sf_dir, "events")
    v = coerce.parsed(F.col("props"))
    k = F.try_variant_get(v, "$.k", "bigint")
    return e.groupBy("event_type").agg(F.min(k).alias("low"), F.max(k).alias("high"), F.count(F.lit(1)).alias("n"), F.schema_of_variant_agg(v).alias("found"), F.sum(v.isNull().cast("bigint")).alias("n_broken"))


@query(_WRITTEN + " SELECT name, extension, sha256(text) AS text_sha256, extension IN ('.doc', '.md') AS broken FROM f")
def q_source_folder(spark, sf_dir):
    """A folder of files read by the data source."""
    got = data_source.documents(spark, _folder(spark, sf_dir), bytesPerPartition="20000")
    return got.select("name", "extension", F.sha2(T.some(F.col("text")), 256).alias("text_sha256"), F.col("error").isNotNull().alias("broken"))


@query(_JOBS + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, sub) - 1 AS INTEGER) AS ord, title, company, start_year, end_year, duties FROM r")
def q_lateral_records(spark, sf_dir):
    """The segmentation as a table function: each document beside its records."""
    table_functions.register(spark)
    found = spark.sql("SELECT d.doc_id, r.* FROM {docs} d, LATERAL records(d.lines, 'employment') r", docs=cv_lines(spark, sf_dir))
    return found.select("doc_id", "ord", "title", "company", F.col("start").alias("start_year"), F.col("end").alias("end_year"), F.array_join("duties", "|").alias("duties"))


@query(_JOBS + " SELECT doc_id, count(*) AS n, max(title) AS last_title, min(start_year) AS first_year FROM r GROUP BY doc_id")
def q_records_of_lines(spark, sf_dir):
    """The same over a table of lines, gathered by document."""
    table_functions.register(spark)
    lines = cv_lines(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("place", "line"))
    found = spark.sql("SELECT d.doc_id, r.* FROM {docs} d, LATERAL records(d.lines, 'employment') r", docs=table_functions.gathered(lines))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("title").alias("last_title"), F.min("start").alias("first_year"))
