"""Queries of text rules over values of the tables.

Each builds what the rule reads from columns of a table, in several forms, and SQL says from the same
columns what has to come out. They take the place of the queries of written cases with their names,
which stay as tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import api
from ..functions import nested
from ..functions import text as T
from ..functions import values as X
from ..operators import briefing as B
from ..operators import checks, identity, normalised, report, requests, retrieval, review, rich_text, scanners, sections, selection
from ..operators import records as C
from ..sources.shared import spread
from .record_queries import ISSUE, _issues
from .registry import query, table
from .text_queries import LINES, TOKENS, doc_lines

joined = lambda c: F.array_join(c, "|")


def row(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def by(key: Column, *ways: Column | str | None) -> Column:
    """One of the ways, going round by the key."""
    out = F.lit(None)
    for i, way in enumerate(ways):
        out = F.when(key % len(ways) == i, F.lit(way) if isinstance(way, str) or way is None else way).otherwise(out)
    return out


def _parts(spark, sf_dir):
    """Keys, names and brands of all parts over all cores: a table of one small file is read by one task, which would do all the work on its texts."""
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))


_SPLIT = "regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')"


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_SPLIT}, '\\n{{2,}}'), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS ps,
        list_filter(list_transform(string_split({_SPLIT}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents)
    SELECT doc_id, CAST(len(ps) AS INTEGER) AS n_paragraphs, CAST(len(ls) AS INTEGER) AS n_lines, sha256(array_to_string(ps, '|')) AS paragraphs, sha256(array_to_string(ls, '|')) AS lines FROM p""")
def q_split_lines(spark, sf_dir):
    """Paragraphs and lines that are not empty, of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("ps"), T.non_empty_lines(F.col("text")).alias("ls"))
    return d.select("doc_id", F.size("ps").alias("n_paragraphs"), F.size("ls").alias("n_lines"), F.sha2(joined(F.col("ps")), 256).alias("paragraphs"), F.sha2(joined(F.col("ls")), 256).alias("lines"))


_STOPPED = "(" + ", ".join(f"'{w}'" for w in T.V.STOP_WORDS) + ")"


@query(f"""WITH t AS (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS told, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ts FROM conversations),
    g AS (SELECT conv_id, turn, role, told, flatten(list_transform(ts, lambda t: CASE WHEN regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AND length(t) > 1 THEN list_transform(range(1, length(t)), lambda i: t[i:i + 1]) ELSE [t] END)) AS every FROM t),
    k AS (SELECT *, list_filter(every, lambda t: length(t) > 1 AND t NOT IN {_STOPPED}) AS kept FROM g)
    SELECT conv_id, turn, role, told, CAST(len(every) AS INTEGER) AS n_every, CAST(len(kept) AS INTEGER) AS n_kept, CAST(len(list_distinct(kept)) AS INTEGER) AS n_distinct, sha256(array_to_string(every, '|')) AS tokens FROM k""")
def q_token_cases(spark, sf_dir):
    """Tokens of every turn of a conversation, CJK as pairs, with and without stop words and repeats."""
    c = table(spark, sf_dir, "conversations")
    text = F.col("text")
    return c.select("conv_id", "turn", "role", F.md5(F.coalesce(text, F.lit(""))).alias("told"), F.size(T.all_tokens(text)).alias("n_every"), F.size(T.tokens(text)).alias("n_kept"), F.size(T.distinct_tokens(text)).alias("n_distinct"), F.sha2(joined(T.all_tokens(text)), 256).alias("tokens"))


@query(f"""WITH o AS (SELECT o_custkey AS k, list('• ' || o_orderpriority || '  x' ORDER BY o_orderkey) AS ls, list(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderpriority || ' -> ' || o_orderstatus END ORDER BY o_orderkey) AS ms FROM orders GROUP BY o_custkey)
    SELECT c_custkey, CASE WHEN ls IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN '{requests.EMPTY["zh"]}' ELSE '{requests.EMPTY["en"]}' END ELSE array_to_string(list_transform(ls, lambda x: '- ' || replace(x[3:], '  ', ' ')), chr(10)) END AS bullets,
        CASE WHEN ms IS NULL THEN CASE WHEN c_custkey % 2 = 0 THEN '{requests.NO_MATCHES["zh"]}' ELSE '{requests.NO_MATCHES["en"]}' END ELSE array_to_string(list_transform(ms, lambda x: '- ' || x), chr(10)) END AS pairs FROM customer LEFT JOIN o ON k = c_custkey""")
def q_bullet_lines(spark, sf_dir):
    """Orders of each customer as bullets and as pairs; who has none gets the placeholder of a language."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("x"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    lines = F.transform("x", lambda r: F.concat(F.lit("• "), r["o_orderpriority"], F.lit("  x")))
    pairs = F.transform("x", lambda r: F.struct(r["o_orderpriority"].alias("requirement"), F.when(r["o_orderstatus"] != "P", r["o_orderstatus"]).alias("evidence")))
    language = F.when(F.col("c_custkey") % 2 == 0, "zh").otherwise("en")
    return c.select("c_custkey", requests.bullets(lines, language).alias("bullets"), requests.match_lines(pairs, language).alias("pairs"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' of ' || p_brand WHEN 1 THEN 'Tech Stack: ' || p_name || ', ' || p_brand || '/' || p_type WHEN 2 THEN 'MSc in ' || p_name WHEN 3 THEN 'the ideal candidate for ' || p_name || ', a 100% match' ELSE '' END AS bullet,
        CASE WHEN p_partkey % 5 = 1 THEN p_name || '|' || p_brand || '|' || p_type ELSE '' END AS technologies, CASE WHEN p_partkey % 5 = 2 THEN 'MSc' WHEN p_partkey % 5 = 0 THEN '- ' || p_name || ' of ' || p_brand WHEN p_partkey % 5 = 1 THEN 'Tech Stack: ' || p_name || ', ' || p_brand || '/' || p_type WHEN p_partkey % 5 = 3 THEN '• the ideal candidate for ' || p_name || ', a 100% match' ELSE '' END AS degree,
        CASE WHEN p_partkey % 5 = 2 THEN p_name ELSE '' END AS field, CASE p_partkey % 5 WHEN 0 THEN '-  ' || p_name || ' of ' || p_brand WHEN 1 THEN 'Tech Stack: ' || p_name || ', ' || p_brand || '/' || p_type WHEN 2 THEN 'MSc in ' || p_name WHEN 3 THEN '• the strong candidate for ' || p_name || ', a strong match' ELSE '' END AS softer FROM part""")
def q_line_pieces(spark, sf_dir):
    """Bullets, technologies, degrees and softened claims in lines made of parts."""
    k, name, brand, kind = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type"))
    text = by(k, row("-  ", name, " of ", brand), row("Tech Stack: ", name, ", ", brand, "/", kind), row("MSc in ", name), row("• the ideal candidate for ", name, ", a 100% match"), None)
    p = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    t = F.col("text")
    return p.select("p_partkey", T.strip_bullet(t).alias("bullet"), joined(B.technologies(F.array(t))).alias("technologies"), C.degree_and_field(t)["degree"].alias("degree"), C.degree_and_field(t)["field"].alias("field"), B.soften(t).alias("softer"))


@query("""WITH d AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
    SELECT k AS o_orderkey, CASE WHEN k % 5 < 3 THEN CAST(y AS VARCHAR) ELSE '' END AS range_start, CASE k % 5 WHEN 0 THEN CAST(y + k % 3 AS VARCHAR) WHEN 1 THEN '至今' WHEN 2 THEN 'PRESENT' ELSE '' END AS range_end,
        CASE WHEN k % 4 = 3 THEN CAST(y AS VARCHAR) ELSE y || ' - ' || (y + k % 3 - 1) END AS formatted, CASE WHEN k % 4 = 3 THEN NULL ELSE k % 3 = 0 END AS wrong, CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(y AS INTEGER) END AS year FROM d""")
def q_date_pieces(spark, sf_dir):
    """Ranges, their form, their order and years in texts made of order dates."""
    k, y, m = F.col("o_orderkey"), F.year("o_orderdate"), F.month("o_orderdate")
    text = by(k, row("from ", y, ".", m, " - ", (y + k % 3).cast("string"), ","), row(y, "/", m, " 至 至今"), row("x ", y, " to PRESENT"), row("since ", y), "no date")
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), y.cast("string").alias("a"), F.when(k % 4 != 3, (y + k % 3 - 1).cast("string")).alias("b"))
    t, a, b = F.col("text"), F.col("a"), F.col("b")
    return o.select("o_orderkey", X.date_range(t)["start"].alias("range_start"), X.date_range(t)["end"].alias("range_end"), X.format_range(a, b).alias("formatted"), C.chronology_wrong(a, b).alias("wrong"), X.year_of(t).alias("year"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' is ' || p_name || ', ' WHEN 1 THEN 'brand ' || p_brand || ' {{Other}}' ELSE p_type END AS filled FROM part""")
def q_filled_text(spark, sf_dir):
    """Templates filled with the values of parts; unknown keys become nothing."""
    p = table(spark, sf_dir, "part")
    template = by(F.col("p_partkey"), "{{name}} is {{name}}, {{other_key}}", "brand {{brand}} {{Other}}", F.col("p_type"))
    return p.select("p_partkey", T.fill_template(template, {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("filled"))


@query("""SELECT s_suppkey, '/out/' || s_name || CASE s_suppkey % 6 WHEN 0 THEN '.docx' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.docx' WHEN 3 THEN '.v2.docx' WHEN 4 THEN '.docx' ELSE '.docx' END AS named FROM supplier""")
def q_output_names(spark, sf_dir):
    """The path of a report for each supplier, whatever extension it was asked for with."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", report.output_name(row("/out/", F.col("s_name"), by(F.col("s_suppkey"), ".docx", ".DOCX ", ".pdf", ".v2", ".dotx", ""))).alias("named"))


@query("""WITH f AS (SELECT o_custkey AS k, list('f' || o_orderkey ORDER BY 'f' || o_orderkey) FILTER (o_orderstatus <> 'P') AS others FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(array_to_string(others, '|'), '') AS others, CASE WHEN c_custkey % 3 = 0 THEN 'gone' || c_custkey ELSE '' END AS stale FROM customer LEFT JOIN f ON k = c_custkey""")
def q_remaining_files(spark, sf_dir):
    """A folder of each customer: files that were not selected, and loaded documents whose files are gone."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    files = o.select(F.col("o_custkey").alias("id"), row("f", F.col("o_orderkey")).alias("path"), "o_orderstatus")
    selected = files.filter("o_orderstatus = 'P'").select("id", "path")
    loaded = files.filter("o_orderstatus <> 'F'").select("id", "path").unionByName(c.filter("id % 3 = 0").select("id", row("gone", F.col("id")).alias("path")))
    told = lambda df, name: df.groupBy("id").agg(joined(F.sort_array(F.collect_list("path"))).alias(name))
    others, stale = selection.other_files(files.drop("o_orderstatus"), selected, ["id"]), selection.stale(loaded, files.select("id", "path"), ["id"])
    out = c.join(told(others, "others"), "id", "left").join(told(stale, "stale"), "id", "left").na.fill("", ["others", "stale"])
    return out.select(F.col("id").alias("c_custkey"), "others", "stale")


_LINE = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_returnflag || l_partkey) AS t FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_LINE} SELECT a.k, CAST(a.n AS INTEGER) AS ord, coalesce(b.t, CASE WHEN a.n % 2 = 1 THEN a.t END) AS text FROM l a LEFT JOIN l b ON b.k = a.k AND b.n = a.n + 2 AND b.n % 2 = 1""")
def q_first_blocks(spark, sf_dir):
    """References of an order's lines to blocks: the line two after, else the line itself; only odd lines are blocks."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("int").alias("ord")).agg(F.max(row(F.col("l_returnflag"), F.col("l_partkey"))).alias("text"))
    refs = lines.select("k", "ord", F.array(F.lit("none"), row("b", F.col("ord") + 2), row("b", F.col("ord"))).alias("block_ids"))
    blocks = lines.filter("ord % 2 = 1").select("k", row("b", F.col("ord")).alias("block_id"), "text")
    return selection.first_block(refs, blocks, ["k"])


@query("""WITH b AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS src, o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE lower(o_orderpriority) END AS req, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'order ' || o_orderkey END AS ev, o_orderstatus AS ref FROM orders),
    g AS (SELECT k, lower(req) AS key, arg_min(req, (src, ord)) AS requirement, coalesce(arg_min(ev, (src, ord)) FILTER (ev <> ''), '') AS evidence, array_to_string(list_sort(list(DISTINCT ref)), '|') AS refs, min((src, ord)) AS place FROM b GROUP BY ALL)
    SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY place) AS INTEGER) AS ord, requirement, evidence, refs FROM g""")
def q_requirement_upsert(spark, sf_dir):
    """Requirements of two sources by name in any case: first evidence, all references."""
    o = table(spark, sf_dir, "orders")
    rows = lambda df, name: df.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), name.alias("requirement"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(row("order ", F.col("o_orderkey"))).alias("evidence"), F.array("o_orderstatus").alias("refs"))
    out = B.upsert_requirements(rows(o.filter("o_orderstatus = 'F'"), F.col("o_orderpriority")), rows(o.filter("o_orderstatus <> 'F'"), F.lower("o_orderpriority")), ["k"])
    return out.select("k", "ord", "requirement", "evidence", joined(F.sort_array("refs")).alias("refs"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 4 THEN '' WHEN 5 THEN '' ELSE c_mktsegment END AS value FROM customer""")
def q_label_values(spark, sf_dir):
    """The segment of a customer behind a label, or below one."""
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    lines = by(F.col("c_custkey"), F.array(name, row("Location: ", seg)), F.array(F.lit("Location:"), seg, name), F.array(F.lit("location"), row(" ", seg)), F.array(row("Current Location ", seg), row("Location: ", name)), F.array(name, seg), F.array(name, F.lit("Location")))
    return table(spark, sf_dir, "customer").select("c_custkey", selection.label_value(lines, ["current location", "location"]).alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' -> ' || p_brand || '|' || p_type WHEN 1 THEN p_name || ', ' || p_brand || '; ' || p_name || ' / ' || p_type ELSE '' END AS strings,
        CASE p_partkey % 3 WHEN 0 THEN p_name || '=' || p_brand || '|' || p_type || '=' WHEN 1 THEN p_name || ', ' || p_brand || '; ' || p_name || ' / ' || p_type || '=' ELSE '' END AS pairs,
        CASE p_partkey % 3 WHEN 0 THEN '- ' || p_name || ' -> ' || p_brand || ' * ' || p_type WHEN 1 THEN p_name || '|' || p_brand || '|' || p_type ELSE '' END AS languages FROM part""")
def q_coerced_lists(spark, sf_dir):
    """Lists, pairs and language lists in texts made of parts."""
    k, name, brand, kind = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type"))
    p = table(spark, sf_dir, "part").select("p_partkey", by(k, row("- ", name, " -> ", brand, "\n*  ", kind, "\n\n"), row(name, ", ", brand, "; ", name, " / ", kind), None).alias("text"))
    t = F.col("text")
    pairs = F.transform(checks.match_pairs(t), lambda m: F.concat(m["requirement"], F.lit("="), m["evidence"]))
    return p.select("p_partkey", joined(checks.strings(t)).alias("strings"), joined(pairs).alias("pairs"), joined(checks.languages(t)).alias("languages"))


@query("""WITH d AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderpriority AS p FROM orders)
    SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN y || '/' || (y + 2) || '/' || p WHEN 2 THEN y || '/Present/' END AS first, CASE WHEN k % 4 = 1 THEN y || '.' || m || '/Present/' || p END AS last FROM d""")
def q_date_lines(spark, sf_dir):
    """Lines of orders that begin or end with a range of dates."""
    k, y, m, p = F.col("o_orderkey"), F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderkey", by(k, row(y, " - ", (y + 2).cast("string"), " | ", p), row(p, ", ", y, ".", m, " – Present"), row(y, " –"), row("since ", y)).alias("text"))
    told = lambda s: F.when(s.isNotNull(), F.concat_ws("/", *[s[c] for c in ("start", "end", "rest")]))
    return o.select("o_orderkey", told(selection.dates_first(F.col("text"))).alias("first"), told(selection.dates_last(F.col("text"))).alias("last"))


@query("""WITH o AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS a, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'P') AS b FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(array_to_string(coalesce(a, b), '|'), '') AS rows, CASE WHEN a IS NOT NULL THEN 'section' WHEN b IS NOT NULL THEN 'fallback' ELSE 'none' END AS source FROM customer LEFT JOIN o ON k = c_custkey""")
def q_requirement_choice(spark, sf_dir):
    """The set of a section, if it has rows, else the other one."""
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.struct("o_orderkey", "o_orderpriority")))), lambda r: r["o_orderpriority"])
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("F").alias("a"), of("P").alias("b"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("c", selection.chosen_requirements(F.col("a"), F.col("b")))
    return c.select("c_custkey", F.coalesce(joined(F.col("c.rows")), F.lit("")).alias("rows"), "c.source")


_NAME = "(SELECT string_agg(upper(w[1]) || w[2:], ' ' ORDER BY i) FROM (SELECT unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i))"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN 'Candidate' ELSE {_NAME} END AS found FROM part")
def q_candidate_names(spark, sf_dir):
    """A name made of each part, in seven places and forms of a CV's head, and once nowhere."""
    name = F.initcap("p_name")
    letters = F.trim(F.regexp_replace(F.replace(name, F.lit(" "), F.lit("")), "(.)", "$1 "))
    text = by(F.col("p_partkey"), row("Curriculum Vitae\nName: ", name, "\nx@y.org"), row("Resume\n", name, "\nEmail: x@y.org"), row(F.replace(name, F.lit(" "), F.lit("\n")), "\nx@y.org"), row(letters, "\nx"), row("Page | 1 Name: Dr. ", name, " Age: 30\nx"), "Senior Engineer\nWork Experience\n2010 - 2012", row("Profile\nSenior Engineer\n", name), "Senior Engineer\n2010 - 2012")
    file = F.when(F.col("p_partkey") % 8 == 5, row(F.replace("p_name", F.lit(" "), F.lit("_")), "_CV_2020.pdf")).otherwise("resume.pdf")
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.lit("cv").alias("kind"), text.alias("text"), file.alias("file_name"))
    return identity.identified(docs).select(F.col("doc_id").alias("p_partkey"), "found")


@query(f"SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN replace(p_name, ' ', ' ') || ' engineer 2' WHEN 4 THEN 'Role' ELSE {_NAME} || ' Engineer' END AS found FROM part")
def q_role_titles(spark, sf_dir):
    """A title made of each part: labelled, told, first line, in the file's name, nowhere."""
    title = row(F.initcap("p_name"), " Engineer")
    text = by(F.col("p_partkey"), row("About us\nJob Title: ", title, "\nx"), row("Overview\n- a bullet\nCompany: Widget\n", title, "\nmore"), row("Overview\n", title), "Role\nx\n", "")
    file = by(F.col("p_partkey"), "jd.pdf", "jd.pdf", "jd.pdf", row(F.replace("p_name", F.lit(" "), F.lit("_")), "_engineer-2.pdf"), "job_description.pdf")
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.lit("jd").alias("kind"), text.alias("text"), file.alias("file_name"))
    return identity.identified(docs).select(F.col("doc_id").alias("p_partkey"), "found")


@query(f"""WITH e AS (SELECT o_custkey AS k, o_orderkey AS ord, p_name, s_name, year(o_orderdate) AS y FROM orders JOIN part ON p_partkey = o_orderkey % 97 JOIN supplier ON s_suppkey = o_orderkey % 7)
    SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS INTEGER) AS ord, 'BSc in ' || p_name AS degree, replace(s_name, '#', ' ') || ' University' AS school, CAST(y AS VARCHAR) AS started, CAST(y + 3 AS VARCHAR) AS ended FROM e""")
def q_education_scan(spark, sf_dir):
    """Degrees of each customer in four layouts, read back by the scanner."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").withColumn("pk", k % 97).withColumn("sk", k % 7)
    o = o.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name"), "pk").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), "s_name"), "sk")
    degree, school, dates = row("BSc in ", F.col("p_name")), row(F.replace("s_name", F.lit("#"), F.lit(" ")), " University"), row(y, " - ", y + 3)
    lines = by(k, F.array(degree, school, dates), F.array(dates, school, degree), F.array(row(school, " | ", degree, " | ", dates)), F.array(row(degree, " | ", dates), school))
    docs = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", lines.alias("l")))), lambda x: x["l"])).alias("lines"))
    return scanners.scan(docs, "education").select(F.col("doc_id").alias("k"), "ord", "degree", "school", F.col("start").alias("started"), F.col("end").alias("ended"))


@query(f"""WITH e AS (SELECT o_custkey AS k, o_orderkey AS ord, {_NAME} AS name, year(o_orderdate) AS y, o_orderpriority AS p FROM orders JOIN part ON p_partkey = o_orderkey % 97)
    SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY ord) - 1 AS INTEGER) AS ord, name || ' Platform' AS name, CASE WHEN ord % 2 = 0 THEN CAST(y AS VARCHAR) ELSE '' END AS started, CASE WHEN ord % 2 = 0 THEN CAST(y + 1 AS VARCHAR) ELSE '' END AS ended,
        CASE WHEN ord % 2 = 0 THEN 'Tech Stack: Go, SQL|built ' || p || ' and kept on' ELSE 'ran ' || p || '|closed it' END AS bullets FROM e""")
def q_project_scan(spark, sf_dir):
    """Projects of each customer, dated with their tools or bare, read back by the scanner."""
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").withColumn("pk", k % 97).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name"), "pk")
    name, p = row(F.initcap("p_name"), " Platform"), F.col("o_orderpriority")
    lines = by(k, F.array(row(name, " (", y, " - ", y + 1, ") Tech Stack: Go, SQL"), row("- built ", p), F.lit("and kept on")), F.array(name, row("- ran ", p), F.lit("- closed it")))
    docs = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", lines.alias("l")))), lambda x: x["l"])).alias("lines"))
    return scanners.scan(docs, "projects").select(F.col("doc_id").alias("k"), "ord", "name", F.col("start").alias("started"), F.col("end").alias("ended"), joined(F.col("bullets")).alias("bullets"))


_TOLD = " ".join(f"WHEN '{c}' THEN '{t}|{a}'" for c, (t, a) in review.PRESENTATION.items())
_LABEL = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in review.SECTION_NAMES.items())


@query(ISSUE + f" SELECT doc_id, src, CASE code {_TOLD} END AS told, CASE section {_LABEL} END AS section_label FROM i")
def q_issue_presentation(spark, sf_dir):
    """Title, action and section of the issue of each labelled document."""
    got = review.presented(_issues(spark, sf_dir))
    return got.select("doc_id", "src", row(F.col("title"), "|", F.col("action")).alias("told"), "section_label")


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' Bank' WHEN 1 THEN p_name || ' Bank Manager' WHEN 2 THEN 'SKILLS: ' || p_name WHEN 3 THEN upper(p_name) WHEN 4 THEN p_name ELSE '' END AS title, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE '' END AS company FROM part)
    SELECT p_partkey, company = '' AND p_partkey % 6 IN (0, 2, 3) AS company_as_title FROM t""")
def q_company_as_title(spark, sf_dir):
    """Whether a row without a company has one, or a heading of skills, as its title."""
    name = F.col("p_name")
    title = by(F.col("p_partkey"), row(name, " Bank"), row(name, " Bank Manager"), row("SKILLS: ", name), F.upper(name), name, None)
    return table(spark, sf_dir, "part").select("p_partkey", normalised.company_as_title(title, F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand"))).alias("company_as_title"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS pk, CASE WHEN l_linestatus = 'O' THEN '' ELSE CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag || ' flag') ELSE l_returnflag || ' flag' END END AS ev, l_quantity / 50 AS score FROM lineitem),
    f AS (SELECT k, ev, row_number() OVER (PARTITION BY k, lower(ev) ORDER BY n, pk, score, ev) AS r, n, pk, score FROM m WHERE ev <> '' AND score >= 0.2)
    SELECT l_orderkey, coalesce(array_to_string(list(ev ORDER BY n, pk, score, ev) FILTER (r = 1), '|'), '') AS lines FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN f ON k = l_orderkey GROUP BY l_orderkey""")
def q_evidence_lines(spark, sf_dir):
    """Evidence of an order's lines: scores of 0.2 or more, each text once in any case."""
    ev = F.when(F.col("l_linestatus") != "O", F.when(F.col("l_linenumber") % 2 == 0, F.upper(row(F.col("l_returnflag"), " flag"))).otherwise(row(F.col("l_returnflag"), " flag"))).otherwise("")
    one = F.struct("l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("score"), ev.alias("evidence"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("x"))
    matches = F.transform("x", lambda r: F.struct(r["evidence"].alias("evidence"), r["score"].alias("score")))
    return o.select("l_orderkey", joined(normalised.evidence_lines(matches, 0.2)).alias("lines"))


@query("""WITH l AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS wanted, list(lower(CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || '!' WHEN 1 THEN o_orderpriority || ' plus' ELSE 'other' END) ORDER BY o_orderkey DESC) AS base FROM orders GROUP BY 1),
    n AS (SELECT k, wanted, CASE WHEN k % 2 = 0 THEN base ELSE list_append(base, 'one more') END AS offered FROM l),
    c AS (SELECT *, list_transform(wanted, lambda w: trim(regexp_replace(lower(w), '[^a-z0-9]+', ' ', 'g'))) AS ws, list_transform(offered, lambda w: trim(regexp_replace(lower(w), '[^a-z0-9]+', ' ', 'g'))) AS os FROM n),
    f AS (SELECT k, wanted, list_reduce(list_transform(range(1, len(ws) + 1), lambda i: {'used': [CAST(0 AS BIGINT)], 'out': [CAST(NULL AS BIGINT)], 'i': i, 'w': ws[i], 'os': os, 'same': len(ws) = len(os)}),
        lambda st, x: (list_transform([coalesce(list_filter(range(1, len(x.os) + 1), lambda j: NOT list_contains(st.used, j) AND x.os[j] = x.w)[1], list_filter(range(1, len(x.os) + 1), lambda j: NOT list_contains(st.used, j) AND x.os[j] <> '' AND x.w <> '' AND (contains(x.os[j], x.w) OR contains(x.w, x.os[j])))[1], CASE WHEN x.same THEN x.i END)],
            lambda hit: {'used': CASE WHEN hit IS NULL THEN st.used ELSE list_append(st.used, hit) END, 'out': list_append(st.out, hit), 'i': x.i, 'w': x.w, 'os': x.os, 'same': x.same}))[1],
        {'used': [CAST(0 AS BIGINT)], 'out': CAST([] AS BIGINT[]), 'i': CAST(0 AS BIGINT), 'w': '', 'os': CAST([] AS VARCHAR[]), 'same': false}).out AS hits FROM c)
    SELECT k AS o_custkey, CAST(i - 1 AS BIGINT) AS place, wanted[i] AS requirement, hits[i] - 1 AS offered_place FROM (SELECT *, unnest(range(1, len(wanted) + 1)) AS i FROM f)""")
def q_requirement_match(spark, sf_dir):
    """The priorities of a customer's orders against a list that spells, lengthens or lacks them."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    other = F.lower(by(k, row(p, "!"), row(p, " plus"), "other"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct(k, p))), lambda r: r["o_orderpriority"]).alias("wanted"), F.transform(F.sort_array(F.collect_list(F.struct((-k).alias("n"), other.alias("o")))), lambda r: r["o"]).alias("base"))
    offered = F.when(F.col("o_custkey") % 2 == 0, F.col("base")).otherwise(F.array_append("base", F.lit("one more")))
    return C.matched(o.select(F.col("o_custkey").alias("doc_id"), "wanted", offered.alias("offered"))).withColumnRenamed("doc_id", "o_custkey")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN '{"a":' || chr(10) || props || '}' ELSE props END AS payload FROM events""")
def q_reply_json(spark, sf_dir):
    """The JSON in replies made of the properties of events."""
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", requests.reply_json(by(F.col("event_id"), row("Here: ", p, " done"), p, row('{"a":\n', p, "}"), row("none of ", F.col("event_type")))).alias("payload"))


@query("""WITH o AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS p, list(o_orderstatus ORDER BY o_orderkey) AS s FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'Anonymous Candidate' ELSE 'the candidate' END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'the role' ELSE c_mktsegment END AS role, CASE WHEN c_custkey % 5 = 0 THEN '(not specified)' ELSE 'C ' || c_nationkey END AS company,
        coalesce(array_to_string(p[1:4], '|'), '') AS points, coalesce(array_to_string(s[1:3], '|'), '') AS concerns FROM customer LEFT JOIN o ON k = c_custkey""")
def q_email_facts(spark, sf_dir):
    """The facts that an e-mail about each customer may use."""
    k = F.col("c_custkey")
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", c))), lambda r: r[c])
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(of("o_orderpriority"), lambda x: F.concat(F.lit("- "), x)).alias("p"), of("o_orderstatus").alias("s"))
    c = table(spark, sf_dir, "customer").join(o, k == F.col("o_custkey"), "left")
    draft = F.struct(
        F.struct(F.when(k % 3 > 0, F.col("c_name")).alias("name")).alias("candidate"), F.struct(F.when(k % 4 > 0, F.col("c_mktsegment")).otherwise(" ").alias("title"), F.when(k % 5 > 0, row("C ", F.col("c_nationkey"))).alias("company")).alias("role"), F.col("p").alias("relevant_experience"), F.col("s").alias("potential_concerns")
    )
    f = c.select("c_custkey", requests.email_facts(draft, F.when(k % 2 == 0, "anonymous").otherwise("named")).alias("f"))
    return f.select("c_custkey", "f.name", "f.role", "f.company", F.coalesce(joined(F.col("f.points")), F.lit("")).alias("points"), F.coalesce(joined(F.col("f.concerns")), F.lit("")).alias("concerns"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name ELSE '' END AS candidate, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS target_role, CASE WHEN c_custkey % 3 < 2 THEN 'Fits ' || c_mktsegment || '.' ELSE '' END AS fit_summary, CASE WHEN c_custkey % 3 = 0 THEN 'Go on' ELSE '' END AS next_step FROM customer""")
def q_summary_sections(spark, sf_dir):
    """The sections of a summary of each customer."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    text = by(F.col("c_custkey"), row("Candidate: ", name, "\nTarget Role: ", segment, "\n## Fit Summary\nFits ", segment, ".\n---\n### Recommended Next Step\nGo on"), row("Candidate: ", name, "\r\n\r\nFit Summary:\r\nFits ", segment, "."), row("About ", name))
    d = B.parsed_summaries(table(spark, sf_dir, "customer").select("c_custkey", text.alias("summary")))
    return d.select("c_custkey", *[F.coalesce(F.element_at("sections", k), F.lit("")).alias(n) for k, n in (("candidate", "candidate"), ("target_role", "target_role"), ("fit_summary", "fit_summary"), ("recommended_next_step", "next_step"))])


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Candidate CV' WHEN 1 THEN '' ELSE c_name END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' B' ELSE '' END AS b, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS p, CASE WHEN c_custkey % 4 = 0 THEN 'Job Description' ELSE c_mktsegment END AS r FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN a ELSE b END AS name, CASE WHEN c_custkey % 3 = 2 THEN 'section' WHEN b <> '' THEN 'fallback' ELSE 'none' END AS name_from, CASE WHEN p <> '' THEN p ELSE 'Oslo' END AS place, CASE WHEN p <> '' THEN 'section' ELSE 'fallback' END AS place_from,
        CASE WHEN c_custkey % 4 = 0 THEN '' ELSE r END AS role, CASE WHEN c_custkey % 4 = 0 THEN 'none' ELSE 'section' END AS role_from FROM c""")
def q_identity_choice(spark, sf_dir):
    """Names, places and roles of customers: what blocks say, unless that is nothing or a label."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    found = identity.identity((by(k, "Candidate CV", None, name), F.when(k % 2 == 0, row(name, " B"))), (F.when(k % 5 > 0, row(" ", segment, " ")), F.lit("Oslo")), (F.when(k % 4 == 0, "Job Description").otherwise(segment), F.lit("")))
    c = table(spark, sf_dir, "customer").select("c_custkey", found.alias("i"))
    return c.select("c_custkey", *[F.col(f"i.{a}.{v}").alias(n) for a, x in (("name", "name"), ("location", "place"), ("role", "role")) for v, n in (("value", x), ("source", f"{x}_from"))])


_GONE = ", ".join(f"CASE WHEN c_custkey % {n} = 0 THEN '{told}' END" for n, (_, told) in zip((2, 3, 5, 7), checks.REQUIRED, strict=True))


@query(f"SELECT c_custkey, array_to_string(list_filter([{_GONE}], lambda x: x IS NOT NULL), '|') AS errors FROM customer")
def q_briefing_errors(spark, sf_dir):
    """What is missing from briefings that lack fields by the customer's number."""
    held = [F.when(F.col("c_custkey") % n > 0, F.col("c_name")).otherwise(None if n % 2 else " ").alias(k) for n, (k, _) in zip((2, 3, 5, 7), checks.REQUIRED, strict=True)]
    return table(spark, sf_dir, "customer").select("c_custkey", joined(checks.briefing_errors(F.struct(*held))).alias("errors"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n FROM part)
    SELECT k AS p_partkey, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'degree_names_school|school_names_degree|degree_from_job' WHEN 2 THEN 'school_blank' WHEN 3 THEN 'degree_equals_school|school_names_degree' WHEN 4 THEN 'degree_from_job' ELSE 'no_education_word' END AS faults, k % 6 IN (1, 3) AS noise,
        CASE k % 6 WHEN 0 THEN 'BSc' WHEN 1 THEN n || ' University' WHEN 2 THEN 'MBA ' || n WHEN 3 THEN 'Master of ' || n WHEN 4 THEN n || ' Engineer' ELSE n END AS parsed_degree, CASE WHEN k % 6 = 0 THEN n ELSE '' END AS field FROM p""")
def q_education_validity(spark, sf_dir):
    """Faults of education rows made of parts."""
    k, n = F.col("p_partkey"), F.col("p_name")
    degree = by(k, row("BSc in ", n), row(n, " University"), row("MBA ", n), row("Master of ", n), row(n, " Engineer"), n)
    school = by(k, row(n, " College"), "BSc", "", row("Master of ", n), row(n, " College"), row(n, " x"))
    d = table(spark, sf_dir, "part")
    return d.select("p_partkey", joined(C.education_faults(degree, school)).alias("faults"), C.education_noise(degree, school, F.lit(""), F.lit("")).alias("noise"), C.degree_and_field(degree)["degree"].alias("parsed_degree"), C.degree_and_field(degree)["field"].alias("field"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'candidate_name_missing_or_generic' WHEN 2 THEN 'candidate_name_embedded_metadata' WHEN 3 THEN 'candidate_name_missing_or_generic' WHEN 4 THEN 'candidate_name_heading_or_table_header|candidate_name_embedded_role_or_banner' ELSE 'candidate_name_missing_or_generic' END AS flags FROM part""")
def q_name_flags(spark, sf_dir):
    """Flags of names made of parts."""
    name = F.initcap("p_name")
    given = by(F.col("p_partkey"), name, F.col("p_name"), row("Email: ", name), row(name, " 2"), row(name, " Engineer"), None)
    return table(spark, sf_dir, "part").select("p_partkey", joined(C.name_flags(given)).alias("flags"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' made it' WHEN 1 THEN p_name || ' Works' || chr(10) || p_brand || ' made it' WHEN 2 THEN p_brand || ' made it' ELSE '' END AS taken FROM part""")
def q_extraction_text(spark, sf_dir):
    """What of a block is read: its label too, unless it is a general one or the text begins with it."""
    label = by(F.col("p_partkey"), "Experience", row(F.col("p_name"), " Works"), row(F.col("p_brand"), " made it"), None)
    text = F.when(F.col("p_partkey") % 4 < 3, row(F.col("p_brand"), " made it"))
    return table(spark, sf_dir, "part").select("p_partkey", sections.extraction_text(label, text).alias("taken"))


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 0 END AS INTEGER) AS n FROM customer""")
def q_draft_warnings(spark, sf_dir):
    """How many warnings the draft of each customer has, by what it lacks."""
    k = F.col("c_custkey")
    whole = F.create_map(*[F.lit(x) for key, _ in B.MISSING for x in (key, "said")])
    none = F.create_map(F.lit("other"), F.lit("x"))
    sure, plain = F.lit("the ideal candidate"), F.lit("a good fit")
    warnings = B.draft_warnings(F.when(k % 4 == 0, none).otherwise(whole), F.when(k % 2 == 0, 0).otherwise(1), F.when(k % 3 == 0, 0).otherwise(2), F.lit(1), F.lit("Jane"), F.lit("Lead"), F.when(k % 5 == 0, sure).otherwise(plain), F.lit(False), F.when(k % 7 == 0, 0).otherwise(1))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(warnings).alias("n"))


_NORMAL = "regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, sha256({_NORMAL}) AS text_sha256, CAST(length({_NORMAL}) AS INTEGER) AS n FROM documents")
def q_text_blocks(spark, sf_dir):
    """The normal form of every whole text."""
    t = T.normalise_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("text_sha256"), F.char_length(t).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS images, CAST(doc_id % 8 AS INTEGER) AS pages, length({_NORMAL}) AS n, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(trim(x), '(?i)^[-–—]*\\s*\\d+\\s+of\\s+\\d+\\s*[-–—]*$'))) AS markers FROM documents),
    c AS (SELECT *, CASE WHEN pages > 0 THEN pages ELSE images END AS k FROM d),
    h AS (SELECT *, CASE WHEN k > 0 THEN images >= greatest(1, k - 1) ELSE images > 0 END AND CASE WHEN k > 0 THEN n / k ELSE n END < 700 AS thin FROM c)
    SELECT doc_id, CASE WHEN n = 0 THEN images > 0 WHEN k > 6 THEN false ELSE thin AND (markers >= greatest(1, k - 1) OR n < 1600) END AS wanted FROM h""")
def q_ocr_wanted(spark, sf_dir):
    """Whether the texts of documents are thin for so many pages and images."""
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.wants_ocr(F.col("text"), (F.col("doc_id") % 4).cast("int"), (F.col("doc_id") % 8).cast("int")).alias("wanted"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 < 4 THEN 'zh' ELSE 'en' END AS language FROM customer""")
def q_language_codes(spark, sf_dir):
    """Codes and names of languages, others being English."""
    return table(spark, sf_dir, "customer").select("c_custkey", X.output_language(by(F.col("c_custkey"), " ZH ", "zh-CN", "Chinese", "cn", F.col("c_name"), None)).alias("language"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS ord, CASE o_orderkey % 6 WHEN 0 THEN 'Build ' || o_orderpriority WHEN 1 THEN o_orderpriority WHEN 2 THEN 'Role: x' WHEN 3 THEN '熟悉分布式系统' WHEN 4 THEN 'Lead ' || o_custkey ELSE 'build ' || o_orderpriority END AS t FROM orders),
    d AS (SELECT *, row_number() OVER (PARTITION BY k, lower(t) ORDER BY ord) AS n FROM r)
    SELECT k, ord, t AS requirement FROM d WHERE n = 1 AND t NOT LIKE 'Role:%' AND t NOT LIKE 'Lead %' AND (contains(t, ' ') OR t = '熟悉分布式系统')""")
def q_requirement_filter(spark, sf_dir):
    """Requirements that say something, each once, in any case."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    text = by(k, row("- Build  ", p), row("•", p), "Role: x", "熟悉分布式系统", row("lead ", F.col("o_custkey")), row("* build ", p))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), k.alias("ord"), text.alias("requirement"), row("Lead ", F.col("o_custkey")).alias("role_title"))
    return B.requirements(o, ["k"]).select("k", "ord", "requirement")


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderpriority AS t, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'C' || o_orderstatus END AS c, CAST(year(o_orderdate) AS VARCHAR) AS a, CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(year(o_orderdate) + 1 AS VARCHAR) END AS b FROM orders),
    g AS (SELECT k, count(*) AS n, string_agg(t || CASE WHEN c = '' THEN '' ELSE ', ' || c END || ' | ' || a || CASE WHEN b = '' THEN '' ELSE CASE WHEN k % 2 = 0 THEN ' 至 ' ELSE ' - ' END || b END, chr(10) ORDER BY ord) AS lines, arg_min(t, ord) AS title, arg_min(c, ord) AS company FROM e GROUP BY k)
    SELECT c_custkey, c_name AS candidate_name, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', C ' || c_nationkey END AS role_line, coalesce(title, '') AS current_title, coalesce(company, '') AS current_company, coalesce(lines, '') AS employment_lines, c_mktsegment || ', ' || c_nationkey AS skills_line, CAST(coalesce(n, 0) AS INTEGER) AS n_employment FROM customer LEFT JOIN g ON k = c_custkey""")
def q_view_model(spark, sf_dir):
    """The flat keys of a report on each customer."""
    job = F.struct("o_orderkey", F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(row("C", F.col("o_orderstatus"))).alias("company"), F.year("o_orderdate").cast("string").alias("start"), F.when(F.col("o_orderstatus") != "P", (F.year("o_orderdate") + 1).cast("string")).alias("end"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(job)).alias("jobs"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    jobs = F.coalesce("jobs", F.array().cast(o.schema["jobs"].dataType))
    none = F.array().cast("array<struct<degree:string,school:string,start:string,end:string>>")
    draft = F.struct(
        F.struct(row(" ", F.col("c_name")).alias("name"), F.lit("Oslo").alias("location")).alias("candidate"), F.struct(F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 3 > 0, row("C ", F.col("c_nationkey"))).alias("company")).alias("role"), F.lit("fits").alias("fit_summary"),
        none.alias("education"), F.transform(jobs, lambda j: F.struct(*[j[x].alias(x) for x in ("title", "company", "start", "end")])).alias("employment"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("skills"),
    )
    v = c.select("c_custkey", B.view_model(draft, F.when(F.col("c_custkey") % 2 == 0, "zh").otherwise("en")).alias("v"))
    return v.select("c_custkey", *[f"v.{x}" for x in ("candidate_name", "role_line", "current_title", "current_company", "employment_lines", "skills_line", "n_employment")])


_SHAPE = '{"fit": ""}'


@query(f"""SELECT c_custkey, 'About ' || c_name || chr(10) || chr(10) || 'Return only valid JSON of this shape:' || chr(10) || '{_SHAPE}' AS asked,
    'The reply below is no valid JSON of the wanted shape (' || c_mktsegment || ').' || chr(10) || 'Return only the corrected JSON.' || chr(10) || chr(10) || 'Shape:' || chr(10) || '{_SHAPE}' || chr(10) || chr(10) || 'Reply:' || chr(10) || c_name AS repair,
    'Candidate: ' || c_name || chr(10) || chr(10) || 'Target Role: ' || c_mktsegment || chr(10) || chr(10) || '## Match Against Key Requirements' || chr(10) || '- ' || c_mktsegment || ' -> ' || c_name AS mock FROM customer""")
def q_briefing_requests(spark, sf_dir):
    """What is asked for a briefing, what for its repair, and what a run without a model answers."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    matches = F.array(F.struct(segment.alias("requirement"), name.alias("evidence")))
    return table(spark, sf_dir, "customer").select("c_custkey", requests.briefing_prompt(row("About ", name), _SHAPE).alias("asked"), requests.repair_prompt(name, segment, _SHAPE).alias("repair"), requests.mock_reply(name, segment, matches).alias("mock"))


@query("""WITH o AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1)
    SELECT c_custkey, upper(c_name) || '@name' AS name, coalesce(array_to_string(list_transform(p, lambda x: upper(x) || '@orders[].said'), '|'), '') AS said, c_name || coalesce('|' || array_to_string(p, '|'), '') || '|' || c_mktsegment AS every FROM customer LEFT JOIN o ON k = c_custkey""")
def q_nested_strings(spark, sf_dir):
    """Every string leaf of nested customers mapped with its path, and all of them as one list."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda r: F.struct(r["o_orderkey"].alias("n"), r["o_orderpriority"].alias("said"))).alias("orders"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.struct(F.col("c_name").alias("name"), "orders", F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("more")).alias("v"))
    kind = c.schema["v"].dataType
    mapped = nested.map_strings(F.col("v"), kind, lambda x, path: F.concat(F.upper(x), F.lit("@" + path)))
    told = c.select("c_custkey", mapped.alias("m"), joined(nested.all_strings(F.col("v"), kind)).alias("every"))
    return told.select("c_custkey", F.col("m.name").alias("name"), F.coalesce(joined(F.transform("m.orders", lambda r: r["said"])), F.lit("")).alias("said"), "every")


@query(f"""WITH {LINES}, q AS (SELECT doc_id, list_distinct({TOKENS}) AS qs FROM lines WHERE line_no = 0),
    s AS (SELECT l.doc_id, line_no, qs, list_distinct({TOKENS}) AS ts FROM lines l JOIN q USING (doc_id)),
    p AS (SELECT doc_id, line_no, CASE WHEN line_no = 0 THEN 1.0 ELSE CAST(round(len(list_intersect(ts, qs)) / greatest(len(qs), 1) + CASE WHEN line_no % 2 = 0 THEN 0.25 ELSE 0 END, 4) AS DOUBLE) END AS score FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no = 0 DESC, score DESC, line_no) AS rank FROM p)
    SELECT doc_id, line_no, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def q_block_ranks(spark, sf_dir):
    """The eight lines of each document that go into a request about its first line; even ones are preferred."""
    lines = doc_lines(spark, sf_dir)
    first = lines.filter("line_no = 0").select("doc_id", T.distinct_tokens(F.col("line")).alias("qs"))
    blocks = lines.join(first, "doc_id").select("doc_id", F.col("line_no").alias("order"), F.col("line").alias("text"), "qs")
    got = retrieval.select_blocks(blocks, F.col("qs"), F.col("order") % 2 == 0, F.lit("cv"))
    return got.select("doc_id", F.col("order").alias("line_no"), "score", "rank")


@query(f"""WITH w AS (SELECT p_partkey, p_name, {_NAME} AS t, list_filter(string_split({_NAME}, ' '), lambda w: length(w) >= 4) AS ends, list_filter(CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ') ELSE [] END, lambda w: length(w) >= 4) AS words FROM part),
    v AS (SELECT *, list_concat([t], CASE WHEN len(words) > 1 THEN [array_to_string(words, ' ')] ELSE [] END, ends, words) AS every FROM w)
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The candidate''s ' || p_name || '. I met the candidate.' WHEN 1 THEN 'Candidate: Anonymous Candidate' || chr(10) || p_name ELSE '' END AS told, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE array_to_string(every, '|') END AS variants FROM v""")
def q_anonymous_prose(spark, sf_dir):
    """Prose about a part as a candidate, and the names that redaction looks for."""
    name = F.initcap("p_name")
    text = by(F.col("p_partkey"), row("Anonymous Candidate's ", F.col("p_name"), ". I met Anonymous Candidate (Sam)."), row("Candidate: Anonymous Candidate (x)\n", F.col("p_name")), None)
    file = by(F.col("p_partkey"), row(F.replace("p_name", F.lit(" "), F.lit("_")), "_cv.pdf"), "x.pdf", None)
    own = F.when(F.col("p_partkey") % 3 < 2, row(name, " (Sam)"))
    return table(spark, sf_dir, "part").select("p_partkey", T.narrative(text).alias("told"), joined(T.name_variants(own, file)).alias("variants"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'responsible for ' || p_name WHEN 1 THEN p_name || ', ' || p_type || '(x)' WHEN 2 THEN '' WHEN 3 THEN p_name || chr(10) || p_brand ELSE CAST(p_size AS VARCHAR) END AS working, CASE p_partkey % 5 WHEN 0 THEN 'mixed' WHEN 2 THEN 'zh' WHEN 4 THEN 'unknown' ELSE 'en' END AS hint FROM part""")
def q_working_text(spark, sf_dir):
    """Working texts of parts: terms and punctuation replaced, lines cleaned; guidance has none."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = by(k, row("负责 ", name), row(name, "，", F.col("p_type"), "（x）"), "负责", row(name, "\n\n ", F.col("p_brand"), " "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.working_text(text, by(k, "cv", "jd", "guidance", "jd", "cv")).alias("working"), T.language_hint(text).alias("hint"))


@query("""WITH f AS (SELECT o_custkey AS k, o_orderkey AS f, o_orderkey % 4 AS v, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (o_orderkey % 4 IN (1, 2)) OVER (PARTITION BY o_custkey) AS d FROM orders)
    SELECT k, f, CASE v WHEN 0 THEN 'Some CV ' || f || '.pdf' WHEN 1 THEN 'job description ' || f || '.docx' WHEN 2 THEN 'x ' || f || '.docx' ELSE 'notes ' || f || '.txt' END AS name,
        CAST(CASE v WHEN 1 THEN 13 WHEN 2 THEN 2 ELSE 0 END + CASE WHEN v IN (1, 2) AND d = 1 AND n > 1 THEN 2 ELSE 0 END AS INTEGER) AS jd_score, CAST(CASE WHEN v = 0 THEN 10 ELSE 0 END AS INTEGER) AS cv_score FROM f""")
def q_file_roles(spark, sf_dir):
    """How much each file in a customer's folder looks like a CV or a job description."""
    k = F.col("o_orderkey")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), k.alias("f"), by(k, row("Some CV ", k, ".pdf"), row("job description ", k, ".docx"), row("x ", k, ".docx"), row("notes ", k, ".txt")).alias("name"), by(k, ".pdf", ".docx", ".docx", ".txt").alias("extension"))
    return selection.file_roles(files, ["k"]).select("k", "f", "name", "jd_score", "cv_score")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'A generated recruiter summary is required.' WHEN 2 THEN 'Candidate CV file metadata must include a name or absolute path.' WHEN 3 THEN 'Candidate CV file path must be an absolute path.' ELSE 'Job description file path must be an absolute path.' END AS error,
    CASE WHEN c_custkey % 7 = 0 THEN 'anonymous' ELSE 'named' END AS mode, c_custkey % 2 = 0 AS is_workspace FROM customer""")
def q_payload_errors(spark, sf_dir):
    """The first thing that is wrong with the payload of each customer."""
    k, name = F.col("c_custkey"), F.col("c_name")
    payload = F.struct(by(k, name, " ", name, name, name).alias("summary"), by(k, name, name, "", name, name).alias("cv_name"), by(k, row("/", name), "", "", row("x/", name), "").alias("cv_path"), name.alias("jd_name"), by(k, "", "", "", "", row("b/", name)).alias("jd_path"))
    hexed = F.when(k % 2 == 0, F.substring(F.sha1(name), 1, 16)).otherwise(name)
    return table(spark, sf_dir, "customer").select("c_custkey", checks.draft_errors(payload, True).alias("error"), checks.output_mode(F.when(k % 7 == 0, " anonymous ").otherwise(name)).alias("mode"), checks.workspace_id(hexed).alias("is_workspace"))


@query("""WITH n AS (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier)
    SELECT kind, id, id % 11 < 2 AS company, id % 11 BETWEEN 2 AND 4 AS place FROM n""")
def q_place_lines(spark, sf_dir):
    """Lines of customers and suppliers that name a company or a place, or neither."""
    side = lambda t, k, n: table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).cast("bigint").alias("id"), F.replace(n, F.lit("#"), F.lit(" ")).alias("name"))
    names = side("customer", "c_custkey", "c_name").unionByName(side("supplier", "s_suppkey", "s_name"))
    k, name = F.col("id"), F.col("name")
    line = by(k, row(name, " Ltd"), row("S", k, "X"), "Oslo, Norway", "London", "南京市", row("Oslo ", k), row("Manager, ", name), "CTO Manager", row("Manager, Oslo ", name), "", None)
    return names.select("kind", "id", selection.company_line(line).alias("company"), selection.location_line(line).alias("place"))


@query(f"""WITH p AS (SELECT p_partkey, p_name AS n, {_NAME} AS t, p_brand AS b FROM part)
    SELECT p_partkey, 'heading:' || t || '|list:' || n || '/' || b || ' <c>|paragraph:about ' || n || ' and two. x|label:' || t || '|list:z' AS blocks,
        '<h3>' || t || '</h3>' || chr(10) || '<ul><li>' || n || '</li><li>' || b || ' &lt;c&gt;</li></ul>' || chr(10) || '<p>about ' || n || ' and two. x</p>' || chr(10) || '<p><strong>Name:</strong> ' || t || '</p>' || chr(10) || '<ul><li>z</li></ul>' AS html FROM p""")
def q_rich_text(spark, sf_dir):
    """Texts about parts as blocks and as HTML."""
    name, title = F.col("p_name"), F.initcap("p_name")
    text = row("# ", title, "\n- ", name, "\n* ", F.col("p_brand"), " <c>\n\nabout ", name, "\nand two. x\nName: ", title, "\n-- 1 of 2 --\n- z")
    told = F.transform("b", lambda b: F.concat(b["kind"], F.lit(":"), F.replace(b["text"], F.lit("\n"), F.lit("/"))))
    return _parts(spark, sf_dir).select("p_partkey", rich_text.blocks(text).alias("b")).select("p_partkey", joined(told).alias("blocks"), rich_text.html_of(F.col("b")).alias("html"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '- did ' || c_mktsegment || ', 2.|- did more, 3.' WHEN 1 THEN '- made ' || c_mktsegment || ', 1.' ELSE c_mktsegment || ';|English;' END AS lines FROM customer""")
def q_section_lines(spark, sf_dir):
    """Lines of the preferred sections of a CV of each customer, else of the next best, else of all."""
    s = F.col("c_mktsegment")
    text = by(F.col("c_custkey"), row("Projects\n\n- made p, 1.\n\nExperience\n\n- did ", s, ", 2.\n- did more, 3."), row("Projects\n\n- made ", s, ", 1.\n\nSkills\n\nSQL;"), row("Skills\n\n", s, ";\n\nLanguages\n\nEnglish;"))
    b = sections.blocks(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("cv").alias("kind"), text.alias("text")))
    return sections.preferred_lines(b, ["experience"], ["projects"]).select(F.col("doc_id").alias("c_custkey"), joined(F.col("lines")).alias("lines"))


@query("""WITH o AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS red, count(*) FILTER (o_orderstatus = 'P') AS amber, count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 1) AS left_amber FROM orders GROUP BY 1)
    SELECT c_custkey, CASE WHEN red > 0 THEN 'red' WHEN amber > 0 THEN 'amber' ELSE 'green' END AS raw_state, CASE WHEN red > 0 THEN 'red' WHEN amber > 0 THEN 'amber' ELSE 'green' END AS state, CASE WHEN red > 0 THEN 'blocked' WHEN left_amber > 0 THEN 'review-required' ELSE 'allowed' END AS posture, NOT (coalesce(red, 0) > 0 OR coalesce(left_amber, 0) > 0) AS exportable FROM customer LEFT JOIN o ON k = c_custkey""")
def q_render_review(spark, sf_dir):
    """Drafts of customers with the issues of their orders, of which every second amber one is decided."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'")
    red = F.col("o_orderstatus") == "F"
    issues = o.select(F.col("o_custkey").alias("doc_id"), F.when(red, "role_title_missing_or_generic").otherwise("project_role_ambiguous").alias("code"), F.when(red, "red").otherwise("amber").alias("severity"), F.when(red, "role").otherwise("projects").alias("section"), F.col("o_orderkey").cast("int").alias("entry_index"))
    keyed = issues.withColumn("issue_key", review.issue_key(issues))
    said = keyed.filter("entry_index % 2 = 0").select("doc_id", "issue_key", F.lit("keep-project-unlinked").alias("decision_type"), F.col("entry_index").alias("at"))
    out = api.render_review(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), issues, said)
    return out.select(F.col("doc_id").alias("c_custkey"), "raw_state", "state", "posture", "exportable")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'tag: name;missing: ' || c_name || ' or John;forbidden: X;separator: ||' ELSE 'missing: ' || c_mktsegment END AS faults FROM customer""")
def q_report_faults(spark, sf_dir):
    """What is wrong with the rendered text of each customer's report."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    said = by(k, row(name, ",  ", segment), "x {{name}} | | y", None)
    required = F.when(k % 3 == 0, F.array(F.array(F.lower(name)), F.array(F.lit("nothing"), segment))).when(k % 3 == 1, F.array(F.array(name, F.lit("John")))).otherwise(F.array(F.array(segment)))
    forbidden = F.when(k % 3 == 1, F.array(F.lit("X"))).otherwise(F.array(F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(report.report_faults(said, required, forbidden), ";").alias("faults"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '张' || chr(19968 + CAST(c_custkey % 500 AS INTEGER)) WHEN 1 THEN '李四' ELSE '' END AS found FROM customer""")
def q_name_fragments(spark, sf_dir):
    """The piece of CJK text about each customer that is most like a name."""
    k = F.col("c_custkey")
    drawn = F.decode(F.unhex(F.lpad(F.hex(F.lit(19968) + k % 500), 4, "0")), "UTF-16BE")
    text = by(k, row(F.col("c_name"), " 张", drawn, " 高级工程师"), row("工作经验 李四 ", F.col("c_name")), row("资深软件工程师 ", F.col("c_name")), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", identity.best_fragment(text).alias("found"))


@query("""SELECT c_custkey, c_custkey % 12 < 2 AS contact, c_custkey % 12 IN (2, 3) AS duty, c_custkey % 12 IN (4, 6) AS heading, c_custkey % 12 IN (0, 1, 2, 3, 4, 5, 7, 9) AS extractable FROM customer""")
def q_line_predicates(spark, sf_dir):
    """Contacts, duties, subheadings and extractable texts among those about customers."""
    k, name, segment, year = F.col("c_custkey"), F.replace("c_name", F.lit("#"), F.lit(" ")), F.initcap(F.col("c_mktsegment")), F.lit(2000) + F.col("c_custkey") % 20
    text = by(
        k, row(k, "@x.org"), row("+49 170 ", F.lit(1000) + k % 9000), row("- did ", segment), row("l did ", segment), row(segment, " Results:"), row("Senior ", segment, " Engineer"), "Led the team", row("Led the team\n", year, " - ", year + 2),
        row("Name: ", name, "\nBSc, Example University\ndegree"), row("Name: ", name, " Engineer\nExample University"), "", None,
    )
    found = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return found.select("c_custkey", *[rule(F.col("text")).alias(n) for n, rule in (("contact", selection.contact_line), ("duty", selection.duty_line), ("heading", selection.subheading), ("extractable", selection.extractable))])


@query("""WITH t AS (SELECT doc_id, 'Summary' || chr(10) || source || chr(10) || 'Work Experience:' || chr(10) || coalesce(text, '') || chr(10) || 'Lead, ' || (2000 + doc_id % 20) || ' - ' || (2001 + doc_id % 20) || chr(10) || 'Skills' || chr(10) || lang || chr(10) || '2010 to now' AS text FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM t),
    w AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '(?i)(?:19|20)\\d{2}(?:[./-]\\d{1,2})?\\s*(?:–|-|—|to|至)\\s*(?:present|current|now|(?:19|20)\\d{2})(?:[./-]\\d{1,2})?')) AS hits FROM l)
    SELECT doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(len(ls) - 6 AS INTEGER) AS n_experience, sha256(array_to_string(ls[4:27][1:least(24, len(ls) - 6)], '|')) AS experience, sha256(array_to_string(list_transform(hits[1:8], lambda i: array_to_string(ls[greatest(i - 2, 1):i + 3], ' || ')), '|')) AS windows FROM w""")
def q_employment_diagnostics(spark, sf_dir):
    """What of a CV made of each document stands in its experience section, and what around its dates."""
    year = lambda n: (F.lit(n) + F.col("doc_id") % 20).cast("string")
    text = row("Summary\n", F.col("source"), "\nWork Experience:\n", F.col("text"), "\nLead, ", year(2000), " - ", year(2001), "\nSkills\n", F.col("lang"), "\n2010 to now")
    d = sections.diagnostics(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return d.select("doc_id", "found.n_lines", "found.n_experience", F.sha2(joined(F.col("found.experience")), 256).alias("experience"), F.sha2(joined(F.col("found.windows")), 256).alias("windows"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 11 = 0 THEN 'Provider is required.' END, CASE WHEN c_custkey % 2 = 0 THEN 'Base URL must start with http:// or https://.' END, CASE WHEN c_custkey % 13 = 0 THEN 'Model is required.' END, CASE WHEN c_custkey % 3 = 0 THEN 'API key is required.' END,
    CASE WHEN c_custkey % 5 = 0 THEN 'Temperature must be between 0 and 2.' END, CASE WHEN c_custkey % 7 = 0 THEN 'Max tokens must be between 128 and 8192.' END, CASE WHEN c_custkey % 4 = 1 THEN 'The reference template must be a Markdown (.md) document.' END], lambda x: x IS NOT NULL), '|') AS errors FROM customer""")
def q_settings_errors(spark, sf_dir):
    """What is wrong with settings that each customer could have."""
    k, name = F.col("c_custkey"), F.col("c_name")
    s = F.struct(
        F.when(k % 11 > 0, "openai").alias("provider"), row(F.when(k % 2 == 0, "ftp://").otherwise("HTTPS://"), name).alias("base_url"), F.when(k % 13 > 0, F.col("c_mktsegment")).otherwise(" ").alias("model"), F.when(k % 3 > 0, name).alias("api_key"), F.lit("").alias("key_status"),
        F.when(k % 5 == 0, 2.5).otherwise(2.0).alias("temperature"), F.when(k % 7 == 0, 127).otherwise(128).cast("bigint").alias("max_tokens"), name.alias("system_prompt"), F.lit(None).cast("string").alias("template_mode"),
        F.when(k % 4 < 2, row("/", name)).alias("template_path"), F.when(k % 4 == 0, ".MD").otherwise(".txt").alias("template_extension"), F.lit("").alias("output_path"), F.lit("").alias("output_extension"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", joined(checks.settings_errors(s)).alias("errors"))


_KEPT = {m: "~".join([*requests.CONSTRAINTS[m], *requests.CONSTRAINTS[""]]).replace("'", "''") for m in ("named", "anonymous")}


@query(f"""SELECT c_custkey, replace('Candidate:~' || c_name || '~~Target role:~' || c_mktsegment || '~~Candidate CV source blocks:~[cv-1] Skills~' || c_mktsegment || '~~[cv-2] Name~' || c_name || '~~Job description source blocks:~jd~~Template:~g~~Requirement-to-evidence hints:~' ||
    CASE WHEN c_custkey % 3 = 0 THEN '{requests.NO_HINTS}' ELSE '- Requirement: ' || c_mktsegment || '~  Evidence hint: ' || c_name END || '~~Constraints:~' || CASE WHEN c_custkey % 2 = 0 THEN '{_KEPT["anonymous"]}' ELSE '{_KEPT["named"]}' END, '~', chr(10)) AS asked FROM customer""")
def q_summary_request(spark, sf_dir):
    """What is asked about each customer."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    block = lambda i, label, text: F.struct(F.lit(i).alias("block_id"), F.lit(label).alias("section_label"), text.alias("text"))
    matches = F.array(F.struct(segment.alias("requirement"), F.when(k % 3 > 0, name).alias("evidence")))
    asked = requests.summary_prompt(name, segment, requests.source_context(F.array(block("cv-1", "Skills", segment), block("cv-2", "Name", name))), F.lit("jd"), F.lit("g"), matches, F.when(k % 2 == 0, "anonymous").otherwise("named"))
    return table(spark, sf_dir, "customer").select("c_custkey", asked.alias("asked"))


@query("""SELECT p_partkey, p_partkey % 6 IN (1, 2, 3, 4) AS odd, p_partkey % 6 IN (1, 2, 3) AS odd_in_report FROM part""")
def q_project_suspicion(spark, sf_dir):
    """Names of projects made of parts, and what is more likely a fragment, a label or a role."""
    name = F.initcap("p_name")
    given = by(F.col("p_partkey"), row(name, " Platform"), row("and ", name), row("Languages: ", name), F.col("p_name"), row(name, " Engineer"), name)
    return table(spark, sf_dir, "part").select("p_partkey", B.suspicious_project(given).alias("odd"), B.suspicious_report_project(given).alias("odd_in_report"))


_PART = "p_partkey % 13"


@query(f"""SELECT p_partkey, CASE {_PART} WHEN 2 THEN 'blank' WHEN 3 THEN 'section_label' WHEN 4 THEN 'company' WHEN 11 THEN 'company|institution' WHEN 12 THEN 'blank' ELSE '' END AS title_faults,
    CASE WHEN {_PART} IN (3, 4, 5, 6, 12) THEN 'blank' WHEN {_PART} = 8 THEN 'date' WHEN {_PART} = 9 THEN 'sentence' WHEN {_PART} = 10 THEN 'role' ELSE '' END AS company_faults,
    CASE {_PART} WHEN 2 THEN 'no_title' WHEN 3 THEN 'title_is_label' WHEN 4 THEN 'title_is_company' WHEN 5 THEN 'duties_of_project' WHEN 6 THEN 'duties_name_company' WHEN 8 THEN 'certificate' WHEN 9 THEN 'company_sentence' WHEN 10 THEN 'company_project' WHEN 12 THEN 'no_title' ELSE '' END AS noise,
    CAST(CASE WHEN {_PART} = 0 THEN 44 WHEN {_PART} IN (1, 7) THEN 42 WHEN {_PART} IN (2, 3, 4) THEN 6 WHEN {_PART} IN (5, 6) THEN 7 WHEN {_PART} < 12 THEN 12 END AS INTEGER) AS score FROM part""")
def q_employment_validity(spark, sf_dir):
    """Faults, noise and scores of jobs made of parts, of which some are null."""
    k, name = F.col("p_partkey"), F.initcap("p_name")
    firm, job = row(name, " Ltd"), row(name, " Engineer")
    title = by(k, job, row("Title: ", job), "", "Skills", row(name, " Bank"), job, job, "PMP", "PMP", job, job, "Example University", None)
    company = by(k, firm, row("Company Name: ", name, " Ltd."), firm, "", "", "", "", firm, (F.lit(2000) + k % 20).cast("string"), row("Led the ", F.col("p_name"), "."), row("Project ", name, " Engineer"), firm, None)
    one = lambda c: F.array(c)
    duties = F.when(k % 13 == 0, F.array(F.col("p_name"), F.col("p_brand"))).when(k % 13 == 5, one(row("Project: ", F.col("p_name")))).when(k % 13 == 6, one(firm)).when(k % 13 < 12, F.array().cast("array<string>"))
    found = table(spark, sf_dir, "part").select("p_partkey", title.alias("t"), company.alias("c"), duties.alias("d"))
    t, c, d = (F.col(x) for x in "tcd")
    return found.select("p_partkey", joined(C.title_faults(t)).alias("title_faults"), joined(C.company_faults(C.company_name(c))).alias("company_faults"), joined(normalised.employment_noise(t, c, d)).alias("noise"), C.employment_score(t, c, F.lit(""), F.lit(""), d).alias("score"))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderpriority AS f, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'U ' || o_orderstatus || ' University' END AS school, CAST(year(o_orderdate) AS VARCHAR) AS a, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(year(o_orderdate) + 2 AS VARCHAR) END AS b FROM orders),
    d AS (SELECT *, row_number() OVER (PARTITION BY k, lower(f), lower(school), a, b ORDER BY ord) AS n FROM e)
    SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE WHEN b = '' THEN 0 ELSE CAST(b AS INTEGER) END DESC, ord) AS INTEGER) AS place, 'MSc' AS degree, f AS field, school, a AS since, b AS until, CASE WHEN school = '' THEN 'education_entry_malformed' ELSE '' END AS flags FROM d WHERE n = 1""")
def q_normalised_education(spark, sf_dir):
    """Degrees of each customer, each once, in order, with what is wrong with them."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), k.alias("ord"), row("MSc in ", F.col("o_orderpriority")).alias("degree"), F.when(k % 7 > 0, row("U ", F.col("o_orderstatus"), " University")).alias("school"), year.cast("string").alias("start"), F.when(k % 5 > 0, (year + 2).cast("string")).alias("end")
    )
    out = normalised.education(rows, ["k"])
    return out.select("k", "place", "degree", "field", "school", F.col("start").alias("since"), F.col("end").alias("until"), joined(F.col("flags")).alias("flags"))
