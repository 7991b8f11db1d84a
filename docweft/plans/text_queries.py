"""Queries over lines, blocks and tokens of ``documents`` and ``benchmark``; each line of a document counts as a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X
from ..functions import vocabulary as V
from ..operators import relational as R
from ..operators import retrieval
from ..sources.shared import spread
from .registry import query, table

LINES = """lines AS (
    SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, trim(regexp_replace(unnest(ls), '\\s+', ' ', 'g')) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
)"""
STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
PAGE = "regexp_matches(line, '(?i)^[-–—\\s]*\\d+\\s+of\\s+\\d+\\s*[-–—\\s]*$') OR regexp_matches(line, '(?i)^page\\s+\\d+\\s+of\\s+\\d+$')"
OPAQUE = "regexp_matches(line, '^~+$') OR (regexp_matches(line, '^[A-Za-z0-9_~-]{20,}$') AND regexp_matches(line, '[0-9]') AND regexp_matches(line, '[A-Za-z]') AND regexp_matches(line, '[_~-]'))"
BULLET = "regexp_replace(line, '^\\s*[•●◦▪■○*\\-–—]+\\s+', '- ')"
RULE = f"""CASE WHEN line = '' THEN 'drop_empty' WHEN {PAGE} THEN 'strip_page_marker' WHEN {OPAQUE} THEN 'strip_opaque_pdf_artifact'
    WHEN regexp_matches(line, '^[\\s\\-–—_=~*•·▪●○◦]{{3,}}$') THEN 'strip_decoration_only_line' WHEN {BULLET} <> line THEN 'normalize_bullet_marker' END"""
TOKENS = f"""list_filter(string_split(trim(regexp_replace(lower(line), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"""


#: Lines that the invented documents lack: a page marker, a bullet, a rule, an opaque token, a heading or a label at the end of each.
EXTRA = """CASE doc_id % 7 WHEN 0 THEN '-- 1 of 3 --' WHEN 1 THEN 'page 2 of 9' WHEN 2 THEN '• point of ' || source WHEN 3 THEN '=====' WHEN 4 THEN 'a1b2c3d4e5f6_g7h8i9j0k' WHEN 5 THEN 'Work Experience:' ELSE 'Company: ' || source END"""
MARKED = LINES.replace("coalesce(text, '')", f"coalesce(text, '') || chr(10) || {EXTRA}")


def doc_lines(spark: SparkSession, sf_dir: str, marked: bool = False) -> DataFrame:
    """doc_id, line_no (from 0), line (cleaned)."""
    text = F.concat(T.some(F.col("text")), F.lit("\n"), F.expr(EXTRA)) if marked else F.col("text")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "raw"))
    return docs.select("doc_id", "line_no", T.clean_line(F.col("raw")).alias("line"))


@query(f"WITH {MARKED}, r AS (SELECT *, {RULE} AS rule FROM lines) SELECT doc_id, line_no, {BULLET} AS line FROM r WHERE rule IS NULL OR rule = 'normalize_bullet_marker'")
def q_clean_lines(spark, sf_dir):
    rows = doc_lines(spark, sf_dir, marked=True).withColumn("rule", T.line_rule(F.col("line")))
    return rows.filter(F.col("rule").isNull() | (F.col("rule") == "normalize_bullet_marker")).select("doc_id", "line_no", T.normalise_bullet(F.col("line")).alias("line"))


@query(f"""WITH {MARKED}, r AS (SELECT *, {RULE} AS rule FROM lines)
    SELECT doc_id, rule AS rule_id, CASE WHEN rule = 'normalize_bullet_marker' THEN 'normalize' ELSE 'strip' END AS action, 1 + line_no AS line_ref, line AS before_text,
        CASE WHEN rule = 'normalize_bullet_marker' THEN {BULLET} ELSE '' END AS after_text
    FROM r WHERE rule IS NOT NULL AND rule <> 'drop_empty'""")
def q_cleaning_manifest(spark, sf_dir):
    rows = doc_lines(spark, sf_dir, marked=True).withColumn("rule_id", T.line_rule(F.col("line"))).filter("rule_id <> 'drop_empty'")
    bullet = F.col("rule_id") == "normalize_bullet_marker"
    return rows.select("doc_id", "rule_id", F.when(bullet, "normalize").otherwise("strip").alias("action"), (F.col("line_no") + 1).alias("line_ref"), F.col("line").alias("before_text"), F.when(bullet, T.normalise_bullet(F.col("line"))).otherwise("").alias("after_text"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed'
    WHEN regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS language_hint
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def q_language_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language_hint(F.col("text")).alias("language_hint"))


@query(f"""WITH t AS (SELECT item_id, {TOKENS.replace("lower(line)", "lower(coalesce(text, ''))")} AS ts FROM benchmark)
    SELECT item_id, CAST(len(ts) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct, array_to_string(ts, ' ') AS tokens FROM t""")
def q_tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("ts"))
    return t.select("item_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_distinct"), F.array_join("ts", " ").alias("tokens"))


NORMAL = "trim(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


@query(f"""WITH n AS (SELECT doc_id, {NORMAL} AS t FROM documents)
    SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars_clean, CASE WHEN t = '' THEN 'No readable text was extracted from this document.'
        WHEN length(t) < 140 THEN 'Extracted text is very short and may be incomplete.' ELSE '' END AS warnings FROM n""")
def q_import_warnings(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", T.normalise_whitespace(F.col("text")).alias("t"))
    return n.select("doc_id", F.char_length("t").cast("bigint").alias("n_chars_clean"), F.array_join(retrieval.import_warnings(F.col("t"), F.lit(".txt")), "\n").alias("warnings"))


@query(f"""WITH {LINES.replace("trim(regexp_replace(unnest(ls), '\\s+', ' ', 'g'))", "unnest(ls)")}, k AS (
        SELECT doc_id, line, line_no, regexp_matches(trim(line), '(?i)^[-–—]*\\s*\\d+\\s+of\\s+\\d+\\s*[-–—]*$') AS page FROM lines
    ), g AS (
        SELECT doc_id, count(*) FILTER (page) AS pages, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT page AND NOT ({OPAQUE.replace("line", "trim(line)")})), '') AS text FROM k GROUP BY doc_id
    ), n AS (SELECT doc_id, pages, {NORMAL} AS t FROM g)
    SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE length(t) + 120 * len(regexp_extract_all(t, '\\b(?:19|20)\\d{{2}}\\b'))
        + 260 * len(regexp_extract_all(t, '(?i)\\b(?:professional|employment|work|project)\\s+experience\\b')) + 45 * len(regexp_extract_all(t, '(?m)^\\s*[•*-]\\s+')) - 220 * pages END AS BIGINT) AS score FROM n""")
def q_pdf_quality_score(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", retrieval.extraction_score(F.col("text")).cast("bigint").alias("score"))


HEADINGS = ", ".join(f"('{k}', '{v}')" for k, v in V.SECTION_HEADINGS.items())


@query(f"""WITH {MARKED}, h(heading, section_key) AS (VALUES {HEADINGS}),
    l AS (SELECT *, lower(trim(regexp_replace(regexp_replace(line, '^#+\\s*', ''), '[:：]\\s*$', ''))) AS heading FROM lines)
    SELECT l.heading, section_key, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM l JOIN h USING (heading) GROUP BY ALL""")
def q_heading_lookup(spark, sf_dir):
    keyed = doc_lines(spark, sf_dir, marked=True).withColumn("heading", T.heading_key(F.col("line")))
    found = keyed.join(F.broadcast(retrieval.headings(spark)), "heading")  # a fixed list of some fifty rows
    return found.groupBy("heading", "section_key").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


@query("""WITH t AS (
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, CASE WHEN role = 'user' THEN text END AS head FROM conversations
    ) SELECT conv_id, n - 1 AS ord, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'Overview') AS section FROM t""")
def q_section_carry_forward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("n", F.row_number().over(R.Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    head = F.when(F.col("role") == "user", F.col("text"))
    return c.select("conv_id", (F.col("n") - 1).cast("bigint").alias("ord"), F.coalesce(R.carry_forward(head, ["conv_id"], [F.col("n")]), F.lit("Overview")).alias("section"))


@query(f"""WITH {LINES}, b AS (SELECT doc_id, line_no, list_distinct({TOKENS}) AS ts FROM lines),
    q AS (SELECT item_id, list_distinct({TOKENS.replace("lower(line)", "lower(coalesce(text, ''))")}) AS qs FROM benchmark),
    qt AS (SELECT item_id, greatest(len(qs), 1) AS n, unnest(qs) AS t FROM q), bt AS (SELECT doc_id, line_no, unnest(ts) AS t FROM b),
    s AS (SELECT item_id, doc_id, line_no, round(count(*) / max(n) + CASE WHEN line_no = 0 THEN 0.1 ELSE 0 END, 6) AS score FROM qt JOIN bt USING (t) GROUP BY item_id, doc_id, line_no),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line_no) AS rank FROM s)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, line_no, CAST(score AS DOUBLE) AS score FROM r WHERE rank <= 8""")
def q_retrieve_topk(spark, sf_dir):
    """The best eight blocks of all documents for each item of ``benchmark``."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return retrieval.retrieve(doc_lines(spark, sf_dir), items, k=V.LIMITS["cv"]).select("item_id", "rank", "doc_id", "line_no", "score")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, line_no, list_distinct(list_filter(string_split(trim(regexp_replace(lower(line), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')), ' '), lambda t: t <> '')) AS ts FROM lines),
    t AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')) AS qs FROM documents),
    s AS (SELECT doc_id, line_no, len(list_intersect(ts, qs)) AS score FROM b JOIN t USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rank FROM s WHERE score > 0)
    SELECT doc_id, line_no, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def q_source_refs_top2(spark, sf_dir):
    """The two blocks of a document that share most tokens with its terms (here its source and language)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.all_tokens(F.concat_ws(" ", "source", "lang"))).alias("terms"), F.posexplode(T.lines(F.col("text"))).alias("line_no", "raw"))
    scored = docs.select("doc_id", "line_no", F.size(F.array_intersect(F.array_distinct(T.all_tokens(F.col("raw"))), "terms")).cast("bigint").alias("score")).filter("score > 0")
    return R.top_k(scored, ["doc_id"], [F.col("score").desc(), F.col("line_no")], 2)


@query(f"""WITH s AS (
        SELECT doc_id, CAST(unnest(range(len(ss))) AS INTEGER) AS sent_no, unnest(ss) AS line
        FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS ss FROM documents)
    ), st AS (SELECT doc_id, sent_no, unnest(list_distinct({TOKENS})) AS t FROM s WHERE length(line) > 30),
    qt AS (SELECT item_id, len(qs) AS n, unnest(qs) AS t FROM (SELECT item_id, list_distinct({TOKENS.replace("lower(line)", "lower(coalesce(text, ''))")}) AS qs FROM benchmark)),
    sc AS (SELECT item_id, doc_id, sent_no, count(*) / max(n) AS score FROM qt JOIN st USING (t) GROUP BY item_id, doc_id, sent_no),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, sent_no) AS n FROM sc)
    SELECT item_id, doc_id, sent_no, CAST(round(score, 6) AS DOUBLE) AS score FROM r WHERE n = 1""")
def q_best_evidence(spark, sf_dir):
    """For each item the sentence of more than 30 characters that holds most of its tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "line")).filter(F.char_length("line") > 30)
    scored = retrieval.best_overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), ["doc_id", "sent_no"], 1)
    return R.top_k(scored, ["item_id"], [F.col("score").desc(), F.col("doc_id"), F.col("sent_no")], 1).select("item_id", "doc_id", "sent_no", F.round("score", 6).alias("score"))


@query(f"""WITH {LINES}, c AS (
        SELECT doc_id, line_no, trim(regexp_replace(line, '^[-*]\\s*', '')) AS req,
            len(list_filter(string_split(trim(regexp_replace(lower(line), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN ({STOP}))) AS n FROM lines
    ), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(req) ORDER BY line_no) AS k FROM c WHERE n BETWEEN 4 AND 20 AND req <> ''),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rank FROM d WHERE k = 1)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, req AS requirement FROM r WHERE rank <= 5""")
def q_requirements_top5(spark, sf_dir):
    """The first five distinct lines of 4 to 20 tokens of each document."""
    rows = doc_lines(spark, sf_dir).withColumn("requirement", F.trim(F.regexp_replace("line", r"^[-*]\s*", ""))).filter(F.size(T.tokens(F.col("line"))).between(4, 20) & (F.col("requirement") != ""))
    first = R.keep_first(rows.withColumn("key", F.lower("requirement")), ["key"], [F.col("line_no")], scope=["doc_id"])
    return R.top_k(first, ["doc_id"], [F.col("line_no")], 5).select("doc_id", "rank", "requirement")


EMAIL = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"
LINKEDIN = "(?i)\\b(?:https?://)?(?:[\\w-]+\\.)?linkedin\\.com/[^\\s)]+"
LABELED = "(?i)\\b(address|home address|current address)\\s*[:：][^\\n]+"
STREET = V.STREET_ADDRESS.replace("'", "''")
PLAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{EMAIL}', '[email redacted]', 'g'), '{LINKEDIN}', '[LinkedIn redacted]', 'g'), '{LABELED}', '\\1: [address redacted]', 'g'), '{STREET}', '[address redacted]', 'g')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, {PLAIN} AS redacted FROM d""")
def q_redact_labelled(spark, sf_dir):
    """E-mail, LinkedIn and addresses only; q_redact_pii takes phones and names too."""
    t = T.some(F.col("text"))
    for p, r in ((V.EMAIL, "[email redacted]"), (V.LINKEDIN, "[LinkedIn redacted]"), (V.LABELED_ADDRESS, "$1: [address redacted]"), (V.STREET, "[address redacted]")):
        t = F.regexp_replace(t, p, r)
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("redacted"))


def _phones_sql(t, p):
    digits = "length(regexp_replace(m[2], '\\D', '', 'g'))"
    return f"array_to_string(list_transform(list_zip(string_split_regex({t}, '{p}'), regexp_extract_all({t}, '{p}')), lambda m: m[1] || CASE WHEN m[2] IS NULL THEN '' WHEN {digits} BETWEEN 7 AND 15 THEN '[phone redacted]' ELSE m[2] END), '')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, {PLAIN} AS t FROM d),
    b AS (SELECT doc_id, {_phones_sql("t", V.PHONES[0])} AS t FROM a), c AS (SELECT doc_id, {_phones_sql("t", V.PHONES[1])} AS t FROM b)
    SELECT doc_id, {_phones_sql("t", V.PHONES[2])} AS redacted FROM c""")
def q_redact_pii(spark, sf_dir):
    """Whole texts without personal data; phones are told apart by the digits of each match."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '{EMAIL}') AS has_email, regexp_matches(t, '{LINKEDIN}') AS has_linkedin,
        regexp_matches(t, '\\+\\d[\\d()\\s.-]{{6,}}\\d') OR regexp_matches(t, '\\b\\d{{3}}[-.\\s]?\\d{{3}}[-.\\s]?\\d{{4}}\\b') OR regexp_matches(t, '\\b\\d{{2,4}}[-.\\s]\\d{{3,4}}[-.\\s]\\d{{3,4}}\\b') AS has_phone,
        regexp_matches(t, '{LABELED}') OR regexp_matches(t, '{STREET}') AS has_address FROM d""")
def q_residual_pii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.residual(F.col("text")).items()])


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 179)) || '…' END AS preview FROM c""")
def q_preview_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(f"""WITH {MARKED}, l AS (SELECT doc_id, line_no, lower(regexp_extract(line, '^([A-Za-z ]{{2,20}})[:：]\\s*(.+)$', 1)) AS label, regexp_extract(line, '^([A-Za-z ]{{2,20}})[:：]\\s*(.+)$', 2) AS value FROM lines),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY line_no) AS k FROM l WHERE label <> '')
    SELECT doc_id, label, value FROM r WHERE k = 1""")
def q_label_value(spark, sf_dir):
    """The first value of each label (``label: value``) of a document."""
    pattern = r"^([A-Za-z ]{2,20})[:：]\s*(.+)$"
    rows = doc_lines(spark, sf_dir, marked=True).select("doc_id", "line_no", F.lower(F.regexp_extract("line", pattern, 1)).alias("label"), F.regexp_extract("line", pattern, 2).alias("value"))
    return R.keep_first(rows.filter("label <> ''"), ["label"], [F.col("line_no")], scope=["doc_id"]).select("doc_id", "label", "value")


@query(f"""WITH {LINES}, l AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines WHERE line <> '')
    SELECT doc_id, line_no, sha256(array_to_string(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING), ' || ')) AS frame_sha256 FROM l""")
def q_context_frame(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).filter("line <> ''")
    return rows.select("doc_id", "line_no", F.sha2(R.context(F.col("line"), ["doc_id"], [F.col("line_no")]), 256).alias("frame_sha256"))


@query("""WITH t AS (SELECT lang, text FROM documents),
    c AS (SELECT lang, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}')) >= 4 AND NOT regexp_matches(coalesce(text, ''), '[\\x{3400}-\\x{9fff}]') AS english, regexp_matches(coalesce(text, ''), '[\\x{3400}-\\x{9fff}]') AS chinese FROM t)
    SELECT lang, count(*) FILTER (english) AS target, count(*) FILTER (chinese) AS opposite, count(*) FILTER (chinese) >= 2 AND count(*) FILTER (chinese) > count(*) FILTER (english) AS needs_normalization FROM c GROUP BY lang""")
def q_language_vote(spark, sf_dir):
    return retrieval.language_vote(table(spark, sf_dir, "documents").select("lang", "text"), "lang", "text")


@query("""SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS size_chars, source || '/' || lang || '/' || doc_id || '.txt' AS path, doc_id || '.txt' AS name, '.txt' AS extension,
    substr(sha1(lower(source || '|' || lang || '|' || doc_id)), 1, 16) AS workspace_id FROM documents""")
def q_projection_view_model(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return d.select(
        "doc_id",
        F.char_length(T.some(F.col("text"))).cast("bigint").alias("size_chars"),
        "path",
        X.base_name(F.col("path")).alias("name"),
        X.extension(F.col("path")).alias("extension"),
        X.workspace_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("workspace_id"),
    )


@query(None)
def q_section_blocks(spark, sf_dir):
    """The section fold over all documents as CVs, lines as paragraphs; order matters inside a document, so tests hold it against small cases."""
    from ..operators import sections

    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("cv").alias("kind"), F.replace(T.some(F.col("text")), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return sections.blocks(docs).select("doc_id", "order", "section_key", "reason", "confidence", "language_hint", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.sha2("text", 256).alias("text_sha256"))
