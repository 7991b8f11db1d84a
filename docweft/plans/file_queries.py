"""Queries over files: written to the shared folder from rows of the tables, then listed and imported."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import selection
from ..sources import scan, shared, store
from ..sources.pdf import pdf_bytes
from .registry import query, table

EXTENSIONS = [".txt", ".docx", ".pdf", ".doc", ".md"]


def _contents(extension: str, text: str) -> bytes:
    lines = text.split("\n")
    return {".docx": lambda: scan.docx_bytes(text), ".pdf": lambda: pdf_bytes(lines)}.get(extension, text.encode)()


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file of each kind for every nation, written by the tasks."""
    where = shared.scratch(spark, "files")
    n = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" "), "n_nationkey").alias("name"), F.concat(F.lit("Nation "), "n_name", F.lit(" of region "), "n_regionkey", F.lit("\n"), F.repeat(F.lit("is a row of a table. "), F.col("n_nationkey"))).alias("text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(where)
        system.create_dir(top, recursive=True)
        for b in batches:
            for name, text in zip(b["name"], b["text"], strict=True):
                for ext in EXTENSIONS:
                    with system.open_output_stream(f"{top}/{name}{ext}") as f:
                        f.write(_contents(ext, text))
            yield pd.DataFrame({"n": [len(b)]})

    n.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()
    return where


_WRITTEN = """WITH n AS (SELECT n_name || ' ' || n_nationkey AS name, 'Nation ' || n_name || ' of region ' || n_regionkey AS head, repeat('is a row of a table. ', n_nationkey) AS body FROM nation),
    e(extension) AS (VALUES ('.txt'), ('.docx'), ('.pdf'), ('.doc'), ('.md')),
    f AS (SELECT name || extension AS name, extension, CASE WHEN extension IN ('.doc', '.md') THEN '' WHEN extension = '.docx' THEN head || chr(10) || chr(10) || body WHEN extension = '.pdf' THEN rtrim(head || chr(10) || trim(body), chr(10)) ELSE head || chr(10) || body END AS text FROM n, e)"""


@query(_WRITTEN + """, t AS (SELECT *, length(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) AS n FROM f)
    SELECT name, extension, sha256(text) AS text_sha256, CASE WHEN extension IN ('.doc', '.md') THEN 'error' WHEN n < 140 OR (extension = '.pdf' AND n < 220) THEN 'warning' ELSE 'ready' END AS status,
        CAST(CASE WHEN extension IN ('.doc', '.md') THEN 0 ELSE CAST(n < 140 AS INTEGER) + CAST(extension = '.pdf' AND n < 220 AS INTEGER) END AS INTEGER) AS n_warnings FROM t""")
def q_import_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, Word, PDF and other files imported; what can't be read is a row with an error."""
    got = scan.documents(spark, _folder(spark, sf_dir))
    return got.select("name", "extension", F.sha2(T.some(F.col("text")), 256).alias("text_sha256"), "status", F.size("warnings").alias("n_warnings"))


@query("""WITH e(extension) AS (VALUES ('.txt'), ('.docx'), ('.pdf'), ('.doc')), f AS (SELECT n_name || ' ' || n_nationkey || extension AS name, extension, n_nationkey FROM nation, e)
    SELECT name, extension, CAST(row_number() OVER (ORDER BY n_nationkey, extension) AS INTEGER) AS place FROM f""")
def q_list_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of a folder in natural order, templates left out."""
    listed = scan.files(spark, _folder(spark, sf_dir)).select("name", "extension")
    # a listing is as long as a folder; its order is the result
    return listed.withColumn("row", F.monotonically_increasing_id()).select("name", "extension", F.row_number().over(selection.R.Window.partitionBy(F.lit(0)).orderBy("row")).alias("place"))


@query("""WITH n AS (SELECT n_name || ' ' || n_nationkey || '.md' AS name, 'Nation ' || n_name || ' of region ' || n_regionkey || chr(10) || repeat('is a row of a table. ', n_nationkey) AS text FROM nation)
    SELECT name, sha256(text) AS text_sha256 FROM n""")
def q_import_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown templates alone."""
    return scan.templates(spark, _folder(spark, sf_dir)).filter("error is null").select("name", F.sha2("text", 256).alias("text_sha256"))


def _workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored workspace of each order: folder, job description and CV, with a draft or not."""
    o = table(spark, sf_dir, "orders")
    path = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    return o.select(
        path("/c/", F.col("o_custkey").cast("string")).alias("folder"), path("/c/jd", (F.col("o_orderkey") % 3).cast("string")).alias("jd_path"), path("/c/cv.pdf").alias("cv_path"), F.lit("").alias("loaded_jd_path"), F.lit(None).cast("string").alias("loaded_cv_path"),
        F.when(F.col("o_orderstatus") == "F", "draft").otherwise(" ").alias("summary"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("updated_at"), F.col("o_orderkey").cast("string").alias("workspace_id"),
    )


_STORED = """WITH w AS (SELECT '/c/' || o_custkey AS folder, '/c/jd' || (o_orderkey % 3) AS jd_path, o_orderstatus = 'F' AS has_draft, strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS updated_at, CAST(o_orderkey AS VARCHAR) AS workspace_id FROM orders)"""


@query(_STORED + """ SELECT c_custkey AS id, max_by(workspace_id, updated_at) AS workspace_id FROM customer LEFT JOIN w ON w.folder = '/c/' || c_custkey AND w.jd_path = '/c/jd' || (c_custkey % 3) AND has_draft GROUP BY c_custkey""")
def q_recent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest workspace with a draft for each selection of folder, job description and CV."""
    c = F.col("c_custkey")
    wanted = table(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.lit("/c/"), c.cast("string")).alias("folder"), F.concat(F.lit("/c/jd"), (c % 3).cast("string")).alias("jd_path"), F.lit("/c/cv.pdf").alias("cv_path"))
    return selection.recent_match(_workspaces(spark, sf_dir), wanted)


@query(_STORED + """ SELECT workspace_id, 'jd' || regexp_extract(jd_path, '.$') AS jd_name, 'cv.pdf' AS cv_name, updated_at, has_draft FROM w""")
def q_workspace_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of workspaces shows of each."""
    return store.summaries(store.meaningful(_workspaces(spark, sf_dir)))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen_at, value FROM events),
    m AS (SELECT *, max(event_id) OVER (PARTITION BY user_id ORDER BY seen_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT user_id, event_id FROM m WHERE before IS NULL OR event_id >= before""")
def q_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that have overtaken later requests are suppressed."""
    e = table(spark, sf_dir, "events")
    e = e.select("user_id", "event_id", F.row_number().over(selection.R.Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seen_at"))
    return selection.in_order(e, ["user_id"], F.col("event_id")).select("user_id", "event_id")


@query("""WITH r AS (SELECT o_orderkey AS id, sha256(o_custkey || chr(31) || o_orderpriority) AS key FROM orders), c AS (SELECT sha256(c_custkey || chr(31) || '1-URGENT') AS key, max(c_name) AS result FROM customer GROUP BY ALL)
    SELECT id, result FROM r LEFT JOIN c USING (key)""")
def q_result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from a keyed cache; the others have no result yet."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), selection.cache_key(F.col("o_custkey"), F.col("o_orderpriority")).alias("key"))
    made = table(spark, sf_dir, "customer").select(selection.cache_key(F.col("c_custkey"), F.lit("1-URGENT")).alias("key"), F.col("c_name").alias("result"), F.col("c_custkey").alias("made_at"))
    hits, misses = selection.cached(asked, made)
    return hits.select("id", "result").unionByName(misses.select("id", F.lit(None).cast("string").alias("result")))
