"""Summaries, warnings, fit, requirement and project rules, employment chooser, report quality."""

import pytest
from pyspark.sql import functions as F

from docweft.operators import briefing as B

SUMMARY = "Candidate: Jane Example\n---\n## Fit Summary\nGood.\n### Notes\nMore.\nRelevant Experience:\n- did x\n- fit summary\n## Fit Summary\nBetter."


def test_summary_sections(spark):
    got = B.summary_sections(SUMMARY)
    assert got == {"candidate": "Jane Example", "fit_summary": "Better.", "relevant_experience": "- did x\n- fit summary"}
    df = B.parsed_summaries(spark.createDataFrame([(SUMMARY,), (None,)], "summary string"))
    assert [len(r.sections) for r in df.collect()] == [3, 0]


def test_tidy_summary():
    assert B.tidy_summary("# Candidate Profile Summary\n\n\n**Candidate**\n\n Jane \nTarget Role\nEngineer\nWhy this candidate may be a fit\nx") == "Candidate: Jane\nTarget Role: Engineer\n## Fit Summary\nx"


@pytest.mark.parametrize(("text", "soft", "strong"), [("An Ideal Candidate, 100% fit", "An strong candidate, strong fit", True), ("A perfect match", "A strong match", True), ("solid", "solid", False), ("完全匹配", "完全匹配", True)])
def test_claims(spark, text, soft, strong):
    r = spark.createDataFrame([(text,)], "t string").select(B.soften(F.col("t")).alias("s"), B.strong_claim(F.col("t")).alias("c")).first()
    assert (r.s, r.c) == (soft, strong)


def test_warnings(spark):
    df = B.parsed_summaries(spark.createDataFrame([(SUMMARY, "cv.pdf", "Engineer", 1)], "summary string, name string, role string, n int"))
    args = [F.col("sections"), F.lit(1), F.lit(3), F.lit(1), F.col("name"), F.col("role"), F.lit("no gaps"), F.lit(False), F.col("n")]
    got = df.select(B.draft_warnings(*args).alias("w")).first().w
    assert [w.split(".")[0][:40] for w in got] == ["Recruiter summary is missing the match a", "Recruiter summary is missing the recomme", "Several requirement matches do not inclu", "Candidate name looks generic or file-der", "The draft uses strong certainty language"]


def test_fit(spark):
    df = spark.createDataFrame([(1, i, f"r{i}", e, s) for i, (e, s) in enumerate([("A", 0.5), ("a", 0.3), ("b", 0.19), ("", 0.9), ("c", 0.1)])], "d int, place int, requirement string, evidence string, score double")
    r = B.fit(df, ["d"]).first()
    assert (r.n_strengths, r.n_gaps, r.strengths, r.gaps, r.experience) == (3, 2, ["r0", "r1", "r3"], ["r2", "r4"], ["A", "b"]) and r.next_step == B.NEXT_STEP[1]


def test_requirements(spark):
    df = spark.createDataFrame([(1, i, t, "Data Engineer") for i, t in enumerate(["- Python skills", "python  skills", "Data engineer", "Role: x y", "job description", "single", "五年开发经验", ""])], "d int, ord int, requirement string, role_title string")
    assert [r.requirement for r in B.requirements(df, ["d"]).orderBy("ord").collect()] == ["Python skills", "五年开发经验"]
    schema = "d int, ord int, requirement string, evidence string, refs array<string>"
    a = spark.createDataFrame([(1, 1, "SQL", "", ["x"]), (1, 2, "Go", "e", [])], schema)
    b = spark.createDataFrame([(1, 1, "sql", "f", ["x", "y"]), (1, 2, "Rust", "g", [])], schema)
    got = [(r.ord, r.requirement, r.evidence, r.refs) for r in B.upsert_requirements(a, b, ["d"]).orderBy("ord").collect()]
    assert got == [(1, "SQL", "f", ["x", "y"]), (2, "Go", "e", []), (3, "Rust", "g", [])]


def test_projects(spark):
    names = {"Wallet Platform": False, "": True, "and more": True, "Jan 2020": True, "AWS": True, "Master of Arts": True, "Engineer": True, "Trading Engineer Platform": False, "Built it": True, "lower case": True, "Ends here.": True, "x" * 95: True}
    df = spark.createDataFrame([(n, w) for n, w in names.items()], "n string, w boolean")
    assert [r.n for r in df.filter(B.suspicious_project(F.col("n")) != F.col("w")).collect()] == []
    r = spark.createDataFrame([(["", "Tech Stack: Go, SQL / Spark", "Did a thing"],)], "b array<string>").select(B.technologies(F.col("b")).alias("t"), B.project_summary(F.col("b")).alias("s")).first()
    assert (r.t, r.s) == (["Go", "SQL", "Spark"], "Did a thing")


def test_employment_chooser(spark):
    rows = [((0, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), "none", "section"), ((0, 0, 0, 0, 0, 0), (1, 0, 40, 1, 0, 1), "fallback", "fallback"), ((3, 0, 90, 3, 0, 3), (2, 3, 80, 0, 3, 5), "section", "section"), ((1, 1, 40, 1, 0, 2), (2, 0, 80, 2, 0, 2), "fallback", "fallback"), ((3, 0, 99, 0, 0, 3), (3, 1, 120, 0, 1, 4), "section", "section")]
    df = spark.createDataFrame(rows, f"s struct<{B.EMPLOYMENT.replace(' int', ':int')}>, f struct<{B.EMPLOYMENT.replace(' int', ':int')}>, loose string, strict string")
    got = df.select("loose", "strict", B.choose_employment("s", "f", F.lit(False)).alias("a"), B.choose_employment("s", "f", F.lit(True)).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(r.loose, r.strict) for r in got]
    e = spark.createDataFrame([(1, "Engineer", "Widget Ltd", "2010", "", ["a"]), (1, "", "", "", "", []), (1, "", "Widget Ltd", "", "", [])], "d int, t string, c string, s string, e string, r array<string>")
    assert tuple(e.groupBy("d").agg(B.employment_counts(*[F.col(c) for c in "tcser"]).alias("x")).first().x) == (1, 1, 53, 1, 2, 3)


def test_report_issues(spark):
    df = spark.sql("""select 'CV.pdf' name, 'Engineer' role, array(named_struct('degree', '', 'school', ''), named_struct('degree', 'Widget Ltd', 'school', '')) edu,
        array(named_struct('title', 'Skills', 'company', ''), named_struct('title', 'Engineer', 'company', 'X')) emp, array('a b', 'and', '', 'Fine Name') pro""")
    got = df.select(B.report_issues(*[F.col(c) for c in ("name", "role", "edu", "emp", "pro")]).alias("x")).first().x
    assert got == ["word_report_candidate_name_generic", "word_report_education_entry_empty", "word_report_education_entry_polluted", "word_report_employment_role_skill_heading", "word_report_employment_role_looks_like_company", "word_report_project_experience_unreliable"]
    assert df.select(B.escape_html(F.lit("<a & 'b'>")).alias("x")).first().x == "&lt;a &amp; &#39;b&#39;&gt;"


def test_whole_drafts(spark):
    one = "named_struct('candidate', named_struct('name', '{n}', 'location', 'Paris'), 'role', named_struct('title', 'Engineer', 'company', ''), 'fit_summary', '{f}', 'education', array(named_struct('degree', 'BSc', 'school', 'U', 'start', '2010', 'end', '2012')), 'employment', array(named_struct('title', '{t}', 'company', 'Widget', 'start', '2012', 'end', '')), 'skills', array('{s}'))"
    df = spark.sql(f"select {one.format(n='Jane Example', f='Jane Example wrote to a@b.co', t='Lead', s='Go')} p, {one.format(n='J', f='x', t='Engineer', s='SQL')} f")
    kind = df.schema["p"].dataType
    r = df.select(B.report(F.col("p"), F.col("f"), kind).alias("r")).withColumn("a", B.anonymised(F.col("r"), kind, F.array(F.lit("Jane Example"))))
    r = r.select("r", "a", B.residual_warnings(F.col("r"), kind).alias("before"), B.residual_warnings(F.col("a"), kind).alias("after"), B.view_model(F.col("r"), F.lit("en")).alias("v")).first()
    assert (r.r.employment[0].title, r.r.skills, r.r.candidate.name) == ("Engineer", ["Go", "SQL"], "Jane Example")
    assert (r.a.candidate.name, r.a.fit_summary) == ("Anonymous Candidate", "The candidate wrote to [email redacted]")
    assert (r.before, r.after) == (["has_email"], [])
    assert (r.v.role_line, r.v.education_lines, r.v.employment_lines, r.v.skills_line) == ("Engineer", "BSc, U | 2010 - 2012", "Engineer, Widget | 2012", "Go, SQL")
