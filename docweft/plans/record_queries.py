"""Queries over records: keep-first and keep-best, merges, links, choosers, issues, metrics. Order and event tables stand in for records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as X
from ..operators import relational as R
from ..operators import review
from .registry import query, table


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def q_dedupe_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return R.keep_first(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("price")])


@query("""SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def q_keep_best(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return R.keep_best(rows, ["l_partkey"], F.col("price"), [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""WITH a AS (SELECT c_nationkey, list_sort(list_distinct(list(c_mktsegment))) AS x FROM customer GROUP BY c_nationkey),
    b AS (SELECT n_nationkey, [upper(n_name), 'building', 'Other', 'other'] AS y FROM nation)
    SELECT n_nationkey, array_to_string(list_concat(x, list_filter([y[1], y[2], y[3]], lambda v: NOT list_contains(list_transform(x, lambda w: lower(w)), lower(v)))), '|') AS merged
    FROM a JOIN b ON c_nationkey = n_nationkey""")
def q_array_union_merge(spark, sf_dir):
    """The market segments of a nation, then others, without repeats in any case."""
    a = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("x"))
    b = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.upper("n_name"), F.lit("building"), F.lit("Other"), F.lit("other")).alias("y"))
    return a.join(b, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", F.array_join(R.union_keep_first(F.col("x"), F.col("y")), "|").alias("merged"))


@query("""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS label FROM orders WHERE o_orderkey % 3 <> 0),
    f AS (SELECT o_orderkey AS k, o_orderstatus AS label FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(p.k, f.k) AS k, coalesce(CASE WHEN trim(p.label) <> '' THEN p.label END, f.label) AS label FROM p FULL OUTER JOIN f ON p.k = f.k""")
def q_coalesce_merge_full_outer(spark, sf_dir):
    """Two partial tables of orders: the first one's non-empty labels win."""
    o = table(spark, sf_dir, "orders")
    p = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority")).alias("label"))
    f = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("label"))
    return R.merge_coalesce(p, f, ["k"])


@query("""WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS at_us FROM s WHERE n = 1 ORDER BY at_us DESC, user_id LIMIT 12""")
def q_upsert_recent_topn(spark, sf_dir):
    """The last event of each user, the twelve most recent of them."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    last = R.keep_first(e, ["user_id"], [F.col("at_us").desc(), F.col("event_id").desc()])
    return R.upsert_recent(last.filter(F.lit(False)), last, "user_id", "at_us", 12)


LINK = """WITH p AS (SELECT o_custkey AS c, o_orderkey AS pid, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) AS e FROM orders),
    j AS (SELECT o_custkey AS c, o_orderkey AS eid, year(o_orderdate) * 12 + month(o_orderdate) - o_orderkey % 7 AS s, year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 7 AS e FROM orders),
    m AS (SELECT p.c, pid, count(eid) AS n, min(eid) AS first FROM p LEFT JOIN j ON p.c = j.c AND p.s >= j.s AND p.e <= j.e GROUP BY p.c, pid)"""


def _links(spark, sf_dir):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", month.alias("m"))
    inner = o.select("custkey", F.col("o_orderkey").alias("project_id"), F.col("m").alias("start"), F.col("m").alias("end"))
    outer = o.select("custkey", F.col("o_orderkey").alias("job_id"), (F.col("m") - F.col("o_orderkey") % 7).alias("start"), (F.col("m") + F.col("o_orderkey") % 7).alias("end"))
    return R.interval_candidates(inner, outer, ["custkey"], "project_id", "job_id")


@query(LINK + " SELECT c AS custkey, pid AS project_id, CASE WHEN n = 1 THEN first END AS linked_id, n AS n_candidates FROM m")
def q_interval_link(spark, sf_dir):
    """Each order's month against the spans of its customer's orders: linked where one span alone holds it."""
    return _links(spark, sf_dir).select("custkey", "project_id", "linked_id", "n_candidates")


@query(LINK + " SELECT c AS custkey, pid AS project_id, n AS n_candidates FROM m WHERE n > 1")
def q_ambiguous_links(spark, sf_dir):
    return _links(spark, sf_dir).filter("ambiguous").select("custkey", "project_id", "n_candidates")


@query("""WITH i AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'red' ELSE 'amber' END AS severity FROM labels)
    SELECT d.doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM i WHERE i.doc_id = d.doc_id AND severity = 'amber')""")
def q_semi_decisions(spark, sf_dir):
    issues = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "red").otherwise("amber").alias("severity")).filter("severity = 'amber'")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(issues, "doc_id", "left_semi")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT (l_returnflag = 'R' AND EXISTS (
    SELECT 1 FROM lineitem b WHERE b.l_returnflag <> 'R' AND b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey))""")
def q_anti_shadow_rows(spark, sf_dir):
    """Returned lines go where the order has a line of the same supplier that was not returned."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    sound = rows.filter("l_returnflag <> 'R'").select("l_orderkey", "l_suppkey").distinct()
    shadows = rows.filter("l_returnflag = 'R'").join(sound, ["l_orderkey", "l_suppkey"], "left_anti")
    return rows.filter("l_returnflag <> 'R'").unionByName(shadows).select("l_orderkey", "l_linenumber")


@query("""WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END) AS base, list(CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END ORDER BY l_linenumber, l_returnflag, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END) AS other FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_transform(list_zip(base, other), lambda p: CASE WHEN trim(p[2]) <> '' THEN p[2] ELSE p[1] END), ',') AS merged FROM l""")
def q_zip_merge(spark, sf_dir):
    """Arrays joined by position; the second one's non-empty values win."""
    status = F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("b"), status.alias("o")))).alias("x"))
    return g.select("l_orderkey", F.array_join(R.zip_merge(F.col("x.b"), F.col("x.o")), ",").alias("merged"))


@query("""WITH s AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag <> 'R') AS valid, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY k),
    f AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS BIGINT) AS valid, CAST(o_orderkey % 3 AS BIGINT) AS bad FROM orders)
    SELECT f.k, CASE WHEN coalesce(s.valid, 0) + coalesce(s.bad, 0) = 0 THEN 'fallback' WHEN s.valid > f.valid THEN 'section' WHEN s.valid < f.valid THEN 'fallback'
        WHEN s.bad <= f.bad THEN 'section' ELSE 'fallback' END AS selection_source FROM f LEFT JOIN s ON f.k = s.k""")
def q_candidate_set_chooser(spark, sf_dir):
    """Two candidate sets per order: more valid rows win, then fewer malformed ones, then the section's."""
    bad = (F.col("l_returnflag") == "R").cast("bigint")
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(1 - bad).alias("valid"), F.sum(bad).alias("bad"))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).alias("f_valid"), (F.col("o_orderkey") % 3).alias("f_bad"))
    j = f.join(s, "k", "left")
    chosen = F.when(F.coalesce(F.col("valid") + F.col("bad"), F.lit(0)) == 0, "fallback").when(F.col("valid") > F.col("f_valid"), "section").when(F.col("valid") < F.col("f_valid"), "fallback")
    return j.select("k", chosen.when(F.col("bad") <= F.col("f_bad"), "section").otherwise("fallback").alias("selection_source"))


_DATES = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%b %Y') WHEN 1 THEN strftime(o_orderdate, '%Y.%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'Present' WHEN 4 THEN strftime(o_orderdate, '%Y-%m') ELSE '' END"""


@query(f"""WITH d AS (SELECT o_orderkey, {_DATES} AS d FROM orders),
    m AS (SELECT o_orderkey, d, CAST(regexp_extract(d, '((?:19|20)\\d{{2}})', 1) AS VARCHAR) AS y, lower(substr(d, 1, 3)) AS mon, regexp_extract(d, '(?:19|20)\\d{{2}}[./-](\\d{{1,2}})', 1) AS num FROM d),
    v AS (SELECT o_orderkey, d, CASE WHEN d = '' THEN NULL WHEN d = 'Present' THEN 119988 WHEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], mon) > 0
        THEN CAST(y AS INTEGER) * 12 + list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], mon) - 1
        WHEN num <> '' THEN CAST(y AS INTEGER) * 12 + CAST(num AS INTEGER) - 1 ELSE CAST(y AS INTEGER) * 12 END AS s FROM m)
    SELECT o_orderkey, d AS date_text, CAST(s AS INTEGER) AS start_ordinal, CAST(CASE WHEN d = 'Present' THEN 119999 WHEN length(d) = 4 THEN s + 11 ELSE s END AS INTEGER) AS end_ordinal FROM v""")
def q_month_ordinal(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    form = lambda f: F.date_format("o_orderdate", f)
    text = F.when(k == 0, form("MMM yyyy")).when(k == 1, form("yyyy.MM")).when(k == 2, form("yyyy")).when(k == 3, "Present").when(k == 4, form("yyyy-MM")).otherwise("")
    d = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("date_text"))
    return d.select("o_orderkey", "date_text", X.month_ordinal(F.col("date_text")).alias("start_ordinal"), X.month_ordinal(F.col("date_text"), "end").alias("end_ordinal"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Present' ELSE strftime(o_orderdate, '%b %Y') END AS d FROM orders)
    SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(TRY_CAST(regexp_extract(d, '((?:19|20)\\d{2})', 1) AS INTEGER), 0) DESC, o_orderkey) AS INTEGER) AS place FROM d""")
def q_year_desc_sort(spark, sf_dir):
    """Records of a customer by falling year of their end; words for the present have no year and come last."""
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "Present").otherwise(F.date_format("o_orderdate", "MMM yyyy")).alias("d"))
    w = R.Window.partitionBy("o_custkey").orderBy(F.coalesce(X.year_of(F.col("d")), F.lit(0)).desc(), "o_orderkey")
    return d.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@query("""SELECT user_id, substr(sha1(lower(trim(user_id || '') || '|' || trim(event_type) || '|')), 1, 16) AS workspace_id, count(*) AS n FROM events GROUP BY ALL""")
def q_workspace_id_sha1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", X.workspace_id(F.col("user_id").cast("string"), F.col("event_type"), F.lit("")).alias("workspace_id"))
    return e.groupBy("user_id", "workspace_id").agg(F.count(F.lit(1)).alias("n"))


def _issues(spark, sf_dir):
    """One issue per labelled document: toxic is red, low quality is amber (ambiguous for every third)."""
    lab = table(spark, sf_dir, "labels")
    code = F.when(F.col("toxic") == 1, "employment_chronology_invalid").when(F.col("doc_id") % 3 == 0, "project_role_ambiguous").otherwise("project_name_suspicious")
    i = lab.filter("toxic = 1 or quality = 0").select("doc_id", F.lit("canonical-validation").alias("source"), code.alias("code"), F.when(F.col("toxic") == 1, "red").otherwise("amber").alias("severity"), F.when(F.col("toxic") == 1, "employment").otherwise("projects").alias("section"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("src"))
    i = i.join(docs, "doc_id").withColumn("entry_index", F.col("doc_id"))
    return i.withColumn("issue_key", review.issue_key(i))


ISSUE = """WITH i AS (SELECT l.doc_id, d.source AS src, CASE WHEN toxic = 1 THEN 'employment_chronology_invalid' WHEN l.doc_id % 3 = 0 THEN 'project_role_ambiguous' ELSE 'project_name_suspicious' END AS code,
    CASE WHEN toxic = 1 THEN 'red' ELSE 'amber' END AS severity, CASE WHEN toxic = 1 THEN 'employment' ELSE 'projects' END AS section FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1 OR quality = 0)"""


@query(ISSUE + """ SELECT src, count(*) AS n_issues, count(*) FILTER (severity = 'red') AS n_red, count(*) FILTER (severity = 'amber') AS n_amber,
    CASE WHEN count(*) FILTER (severity = 'red') > 0 THEN 'red' ELSE 'amber' END AS state FROM i GROUP BY src""")
def q_validation_rollup(spark, sf_dir):
    red, amber = F.sum((F.col("severity") == "red").cast("bigint")), F.sum((F.col("severity") == "amber").cast("bigint"))
    g = _issues(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("n_issues"), red.alias("n_red"), amber.alias("n_amber"))
    return g.withColumn("state", F.when(F.col("n_red") > 0, "red").otherwise("amber"))


def _state(spark, sf_dir):
    issues = _issues(spark, sf_dir)
    d = issues.filter("doc_id % 2 = 0").select("src", "issue_key", F.when(F.col("doc_id") % 5 == 0, "keep-project-unlinked").otherwise("mark-reviewed").alias("decision_type"), F.col("doc_id").alias("o"))
    return review.review_state(review.applied(issues, review.normal_decisions(d, ["src"], [F.col("o")]), ["src"]), ["src"])


STATE = ISSUE + """, p AS (SELECT *, CASE WHEN severity = 'amber' AND doc_id % 2 = 0 AND (doc_id % 5 <> 0 OR code = 'project_role_ambiguous') THEN 'allowed' WHEN severity = 'red' THEN 'blocked' ELSE 'review-required' END AS p FROM i),
    s AS (SELECT src, CASE WHEN count(*) FILTER (severity = 'red') > 0 THEN 'red' ELSE 'amber' END AS state, count(*) AS n_issues, count(*) FILTER (p = 'blocked') AS n_blocked,
        count(*) FILTER (p = 'review-required') AS n_review, count(*) FILTER (p = 'allowed') AS n_allowed, array_to_string(list_sort(list_distinct(list(section))), ',') AS sections FROM p GROUP BY src),
    r AS (SELECT src, state, CASE WHEN n_blocked > 0 THEN 'blocked' WHEN n_review > 0 THEN 'review-required' ELSE 'allowed' END AS posture, n_issues, n_blocked, n_review, n_allowed, sections FROM s)"""


@query(STATE + " SELECT * FROM r")
def q_review_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query(STATE + " SELECT posture, count(*) AS n, CAST(sum(n_issues) AS BIGINT) AS n_issues FROM r GROUP BY posture")
def q_export_gate(spark, sf_dir):
    return _state(spark, sf_dir).groupBy("posture").agg(F.count(F.lit(1)).alias("n"), F.sum("n_issues").alias("n_issues"))


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS k FROM orders GROUP BY o_custkey)
    SELECT o_custkey, n, k AS n_suspicious, n > 12 AND k >= greatest(2, ceil(n * 0.2)) AS over_expanded, k >= 3 AND k >= ceil(n * 0.4) AS unreliable FROM s""")
def q_report_quality(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("bigint")).alias("n_suspicious"))
    over, bad = review.over_expanded(F.col("n"), F.col("n_suspicious"))
    return s.select("o_custkey", "n", "n_suspicious", over.alias("over_expanded"), bad.alias("unreliable"))


@query("""SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k_or_default FROM events""")
def q_json_normalize_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json(X.json_payload(F.col("props")), "k string"))
    return e.select("event_id", "event_type", F.col("p.k").try_cast("bigint").alias("k"), X.number_or(F.col("p.k"), -1).alias("k_or_default"))


@query("""SELECT event_id, CAST(CASE WHEN value IS NULL OR NOT isfinite(value) OR value < 0 THEN 0 ELSE floor(value * 10 + 0.5) / 10 END AS DOUBLE) AS ms FROM events""")
def q_perf_round(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.round_ms(F.col("value")).alias("ms"))


@query("""WITH e AS (SELECT event_id, value - 20 AS a, value * 2 AS b FROM events)
    SELECT event_id, array_to_string(list_filter([CASE WHEN a >= 0 THEN 'extract=' || CAST(CAST(floor(a * 10 + 0.5) AS BIGINT) AS VARCHAR) END, CASE WHEN b >= 0 THEN 'total=' || CAST(CAST(floor(b * 10 + 0.5) AS BIGINT) AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS phases FROM e""")
def q_phase_map_filter(spark, sf_dir):
    """A map of durations without blank keys and negative values, printed in tenths."""
    m = F.create_map(F.lit("extract"), F.col("value") - 20, F.lit("total"), F.col("value") * 2, F.lit(" "), F.lit(1.0))
    kept = F.map_entries(X.phases(m))
    told = F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10).cast("bigint").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(told, ",").alias("phases"))


_MESSAGE = "event_type || CASE event_id % 7 WHEN 0 THEN ' Settings missing' WHEN 1 THEN ' JSON broken' WHEN 2 THEN ' fetch failed' WHEN 3 THEN ' template save' WHEN 4 THEN ' email validation' WHEN 5 THEN ' open' ELSE '' END"


@query(f"""WITH m AS (SELECT event_id, lower({_MESSAGE}) AS m FROM events),
    c AS (SELECT CASE WHEN contains(m, 'settings') OR contains(m, 'api key') THEN 'settings-error' WHEN contains(m, 'validation') THEN 'validation-error' WHEN contains(m, 'parse') OR contains(m, 'json') THEN 'parse-error'
        WHEN contains(m, 'translate') OR contains(m, 'translation') THEN 'translation-error' WHEN contains(m, 'email') THEN 'email-error' WHEN contains(m, 'export') OR contains(m, 'template') OR contains(m, 'save') THEN 'export-error'
        WHEN contains(m, 'clipboard') OR contains(m, 'mailto') OR contains(m, 'open') THEN 'shell-error' WHEN contains(m, 'network') OR contains(m, 'fetch') OR contains(m, 'provider') THEN 'provider-error' ELSE 'unknown-error' END AS category FROM m)
    SELECT category, count(*) AS n FROM c GROUP BY category""")
def q_error_category(spark, sf_dir):
    return table(spark, sf_dir, "events").select(X.error_category(F.expr(_MESSAGE)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, CAST(round(quantile_cont(value, 0.5), 6) AS DOUBLE) AS p50, CAST(round(quantile_cont(value, 0.9), 6) AS DOUBLE) AS p90, CAST(round(quantile_cont(value, 0.95), 6) AS DOUBLE) AS p95,
    CAST(round(avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS ok_rate FROM events GROUP BY event_type""")
def q_latency_percentiles(spark, sf_dir):
    p = lambda q: F.round(F.expr(f"percentile(value, {q})"), 6)  # noqa: E731  exact; percentile_approx where event types are few and rows are many
    ok = F.round(F.avg(F.when(F.col("value") >= 0, 1.0).otherwise(0.0)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), ok.alias("ok_rate"))


@query("""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'JD ' || page_id || '.docx' WHEN 1 THEN 'cv ' || page_id || '.pdf' WHEN 2 THEN 'Job Description.txt' ELSE 'cv_' || page_id || '.doc' END AS name FROM pages)
    SELECT page_id, name, CAST(CASE WHEN regexp_matches(name, '(?i)\\bjd\\b') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(name, '(?i)\\bjob\\b|description') THEN 3 ELSE 0 END + CASE WHEN lower(name) LIKE '%.docx' THEN 2 ELSE 0 END AS INTEGER) AS jd_score,
        CAST(CASE WHEN regexp_matches(name, '(?i)\\bcv\\b') THEN 8 ELSE 0 END + CASE WHEN lower(name) LIKE '%.pdf' THEN 2 ELSE 0 END AS INTEGER) AS cv_score FROM f""")
def q_file_role_score(spark, sf_dir):
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    name = F.when(k == 0, F.concat(F.lit("JD "), i, F.lit(".docx"))).when(k == 1, F.concat(F.lit("cv "), i, F.lit(".pdf"))).when(k == 2, "Job Description.txt").otherwise(F.concat(F.lit("cv_"), i, F.lit(".doc")))
    f = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    has = lambda p, n: F.when(F.col("name").rlike(p), n).otherwise(0)
    return f.select("page_id", "name", (has(r"(?i)\bjd\b", 8) + has(r"(?i)\bjob\b|description", 3) + has(r"(?i)\.docx$", 2)).alias("jd_score"), (has(r"(?i)\bcv\b", 8) + has(r"(?i)\.pdf$", 2)).alias("cv_score"))


@query("""SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INTEGER) AS n_links FROM pages""")
def q_tag_extract(spark, sf_dir):
    """Text between tags and counts of tags in raw markup."""
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("n_links"))


@query("""SELECT c_custkey, 'mailto:?subject=' || replace(url_encode(c_name), '+', '%20') || '&body=' || replace(url_encode(c_mktsegment), '+', '%20') AS url FROM customer""")
def q_mailto(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.mailto(F.col("c_name"), F.col("c_mktsegment")).alias("url"))


@query("""WITH m AS (SELECT doc_id FROM documents), n AS (SELECT doc_id FROM labels)
    SELECT doc_id, 'both' AS part FROM m WHERE doc_id IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, 'first only' FROM m WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def q_set_operations(spark, sf_dir):
    m, n = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return m.intersect(n).withColumn("part", F.lit("both")).unionByName(m.exceptAll(n).withColumn("part", F.lit("first only")))


@query("""SELECT r_name, n_name, count(*) AS n, CAST(round(avg(c_acctbal), 4) AS DOUBLE) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def q_rollup(spark, sf_dir):
    """Grouping sets, for reports over several levels."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))

