"""A draft from documents and replies: whole, broken, repaired, missing."""

import json

from docweft import api

CV = "Jane Example\njane@example.org\n\nExperience\n\nWidget Bank Ltd\n2015 - 2019\nSenior Engineer\n- Built payment platforms in Go for retail users.\n- Ran SQL reporting for the risk team.\n\nSkills\n\nGo, SQL;"
JD = "Job Title: Staff Engineer\n\nRequirements:\n\n- Built payment platforms in Go\n- SQL reporting for risk\n- Kernel drivers in Rust\n"
REPLY = {"candidate": {"name": "Jane Example", "skills": ["Go"]}, "role": {"title": "Staff Engineer"}, "fit_summary": "Jane fits well.", "recommended_next_step": ""}
SUMMARY = "**Candidate**\nJane Example\n\n## Fit Summary\nJane Example, jane@example.org, is the ideal candidate."


def drafts(spark):
    pairs = spark.createDataFrame([(i, CV, "cv.pdf", JD, "jd.pdf", mode) for i, mode in ((1, "named"), (2, "anonymous"), (3, "named"), (4, None))] + [(5, None, None, None, None, None), (None, CV, "cv.pdf", JD, "jd.pdf", "named")], "pair_id bigint, cv_text string, cv_file string, jd_text string, jd_file string, mode string")
    wanted = api.summary_requests(pairs, "guide")
    whole = "Here: " + json.dumps(REPLY)
    replies = spark.createDataFrame([(1, SUMMARY, whole, None), (2, SUMMARY, whole, None), (3, None, "{broken", whole), (4, "", "nothing", "also nothing")], "pair_id bigint, summary string, briefing string, repair string")
    return wanted, replies


def test_requests(spark):
    wanted, replies = drafts(spark)
    rows = {r.pair_id: r for r in wanted.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, None}
    r = rows[1]
    assert (r.name, r.role, r.mode) == ("Jane Example", "Staff Engineer", "named") and r.n_cv > 0 and r.n_jd > 0
    assert [m.role for m in r.summary_request] == ["system", "user"] and "guide" in r.summary_request[1].content and "Built payment platforms" in r.summary_request[1].content
    assert r.briefing_request[1].content.startswith(r.summary_request[1].content)
    assert [(m.requirement, bool(m.evidence)) for m in r.facts.match_requirements] == [("Built payment platforms in Go", True), ("SQL reporting for risk", True), ("Kernel drivers in Rust", False)]
    assert [(j.title, j.company, j.start, j.end) for j in r.facts.employment_history] == [("Senior Engineer", "Widget Bank Ltd", "2015", "2019")]
    assert (rows[5].name, rows[5].role, rows[5].n_cv) == ("Candidate", "", 0) and rows[5].facts.match_requirements == []
    from docweft.operators import generation

    assert {x.pair_id for x in generation.repairs(wanted, replies).collect()} == {3, 4}


def test_drafts(spark):
    wanted, replies = drafts(spark)
    rows = {r.pair_id: r for r in api.generate_summary(wanted, replies).collect()}
    assert {k: r.origin for k, r in rows.items()} == {1: "reply", 2: "reply", 3: "repair", 4: "facts", 5: "facts", None: "facts"}
    one = rows[1]
    assert one.briefing.fit_summary == "Jane fits well." and one.briefing.recommended_next_step.startswith("Recommend") and len(one.briefing.match_requirements) == 3
    assert one.summary.startswith("Candidate: Jane Example\n\n## Fit Summary\nJane Example, jane@example.org, is the strong candidate.") and "## Match Against Key Requirements\n- Built payment platforms in Go -> " in one.summary
    assert one.errors == [] and one.personal_data == []
    two = rows[2]
    assert two.briefing.candidate.name == "Anonymous Candidate" and "Jane" not in two.summary and "jane@" not in two.summary and two.personal_data == []
    assert "Jane" not in json.dumps(two.briefing.asDict(True))
    assert rows[4].summary.startswith("## Fit Summary\nThe CV shows: ")
    assert rows[5].errors and rows[5].warnings
    empty = api.generate_summary(api.summary_requests(spark.createDataFrame([], "pair_id bigint, cv_text string, cv_file string, jd_text string, jd_file string, mode string")), replies)
    assert empty.collect() == []
