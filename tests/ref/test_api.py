"""The channel functions end to end on small tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweft import api
from docweft.sources.scan import docx_bytes


def test_workspaces(spark, tmp_path):
    kind = "folder string, jd_path string, cv_path string, loaded_jd_path string, loaded_cv_path string, summary string, updated_at string"
    fresh = spark.createDataFrame([("/a", "/a/jd", "/a/cv", "", "", "draft", "2020"), ("/b", "/b/jd", "/b/cv", "", "", "", "2021")], kind)
    named = StructType.fromDDL(kind).add("workspace_id", "string")
    api.save_snapshot(spark.createDataFrame([], named), fresh, f"{tmp_path}/s1")
    stored = spark.read.schema(named).json(f"{tmp_path}/s1")
    assert [(r.jd_name, r.has_draft) for r in api.list_recent(stored).collect()] == [("jd", False), ("jd", True)]
    first = stored.filter("folder = '/a'").first().workspace_id
    assert api.load_snapshot(stored, first, F.lit("2022")).first().workspace_id == first
    with pytest.raises(Exception, match="no workspace"):
        api.load_snapshot(stored, "missing", F.lit("2022")).collect()
    api.clear_recent(stored, f"{tmp_path}/s2")
    assert spark.read.schema(named).json(f"{tmp_path}/s2").count() == 0


def test_settings(spark, tmp_path):
    ddl = "provider string, base_url string, model string, api_key string, key_status string, temperature double, max_tokens bigint, system_prompt string, template_mode string, template_path string, template_extension string, output_path string, output_extension string"
    good = ("openai", "https://x", "m", "k", "", 0.5, 1000, "p", "default", "", "", "", "")
    assert api.save_settings(spark.createDataFrame([good], ddl), f"{tmp_path}/s").first().errors == []
    assert api.load_settings(spark, f"{tmp_path}/s", StructType.fromDDL(ddl), {}).first().model == "m"
    assert len(api.save_settings(spark.createDataFrame([("", *good[1:])], ddl), f"{tmp_path}/t").first().errors) == 1


def test_export_needs_a_review(spark):
    drafts = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    issues = spark.createDataFrame([(2, "role_title_missing_or_generic", "red", "role")], "doc_id bigint, code string, severity string, section string")
    none = spark.createDataFrame([], "doc_id bigint, issue_key string, decision_type string, at int")
    template = bytes(docx_bytes("{{candidate_name}} for {{role_title}}"))
    payloads = spark.createDataFrame([(i, template, {"candidate_name": "Jane", "role_title": "Lead"}, [["Jane"], ["Nobody"]], ["Lead"]) for i in (1, 2)], "doc_id bigint, template binary, values map<string,string>, required array<array<string>>, forbidden array<string>")
    out = api.export_word_draft(api.render_review(drafts, issues, none), payloads).collect()
    assert [(r.doc_id, r.faults) for r in out] == [(1, ["missing: Nobody", "forbidden: Lead"])]


def test_clipboard(spark):
    df = spark.createDataFrame([("s", "b"), ("s", "x" * 200_001)], "s string, b string")
    assert [r[0] for r in df.select(api.clipboard(F.col("s"), F.col("b"))).collect()] == ["Subject: s\n\nb", None]
