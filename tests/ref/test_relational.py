"""Keyed and ordered operators, review states, retrieval, import and streams on small tables."""

from pyspark.sql import functions as F

from docweft.operators import relational as R
from docweft.operators import retrieval, review
from docweft.sources import scan
from docweft.streaming import run_log


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_first_and_best(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 1.0), ("", 0, 9.0), (None, 3, 9.0), ("b", 4, 5.0), ("b", 5, 5.0)], "k string, o int, s double")
    assert rows(R.keep_first(df, ["k"], [F.col("o")])) == [("a", 1, 1.0), ("b", 4, 5.0)]
    assert rows(R.keep_best(df, ["k"], F.col("s"), [F.col("o")])) == [("a", 2, 5.0), ("b", 4, 5.0)]


def test_upsert(spark):
    old = spark.createDataFrame([(i, i, "old") for i in range(15)], "id int, at int, v string")
    new = spark.createDataFrame([(3, 99, "new"), (77, 5, "new")], "id int, at int, v string")
    got = R.upsert_recent(old, new, "id", "at", 12).collect()
    assert len(got) == 12 and tuple(got[0]) == (3, 99, "new") and [r.id for r in got].count(3) == 1


def test_interval_links(spark):
    p = spark.createDataFrame([(1, 10, 5, None), (1, 11, 1, 2), (1, 12, 50, 60), (2, 13, None, 3)], "d int, pid int, start int, end int")
    e = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 4, 8), (1, 2, None, 9), (2, 3, 0, 9)], "d int, eid int, start int, end int")
    got = rows(R.interval_candidates(p, e, ["d"], "pid", "eid"))
    assert got == [(1, 10, 2, None, True), (1, 11, 1, 0, False), (1, 12, 0, None, False), (2, 13, 0, None, False)]


def test_arrays(spark):
    df = spark.createDataFrame([(["A", "b", ""], ["a", "C", "B"], ["x", "", " "])], "a array<string>, b array<string>, c array<string>")
    got = df.select(R.union_keep_first(F.col("a"), F.col("b")).alias("u"), R.zip_merge(F.col("a"), F.col("c")).alias("z")).first()
    assert got.u == ["A", "b", "C"] and got.z == ["x", "b", ""]


def test_review_states(spark):
    issues = spark.createDataFrame([(1, "s", "project_role_ambiguous", "amber", "projects"), (2, "s", "x", "red", "role"), (2, "s", "y", "amber", "projects"), (3, "s", "y", "amber", "projects")], "d int, source string, code string, severity string, section string")
    issues = issues.withColumn("issue_key", review.issue_key(issues))
    dec = spark.createDataFrame([(1, issues.first().issue_key, "keep-project-unlinked", 1), (1, issues.first().issue_key, "mark-reviewed", 2), (2, "s::x::role::::::::::::::::", "mark-reviewed", 1), (3, "s::y::projects::::::::::::::::", "keep-project-unlinked", 1)], "d int, issue_key string, decision_type string, o int")
    state = review.review_state(review.applied(issues, review.normal_decisions(dec, ["d"], [F.col("o")]), ["d"]), ["d"])
    got = {r.d: (r.state, r.posture, r.n_allowed) for r in state.collect()}
    assert got == {1: ("amber", "allowed", 1), 2: ("red", "blocked", 0), 3: ("amber", "review-required", 0)}
    assert [r.d for r in review.gate(state).collect()] == [1]


def test_select_blocks(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["nothing", "python spark", "spark", "other", "python"])], "doc_id int, order int, text string")
    got = retrieval.select_blocks(df, F.array(F.lit("python"), F.lit("spark")), F.lit(False), F.lit("other")).orderBy("order").collect()
    assert [(r.order, r.score) for r in got] == [(0, 1.0), (1, 1.0), (2, 0.5), (4, 0.5)]


def test_import(spark, tmp_path):
    (tmp_path / "b10.txt").write_text("x" * 150)
    (tmp_path / "b9.docx").write_bytes(scan.docx_bytes("Line & one\nLine two"))
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.png").write_bytes(b"no")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    assert [r.name for r in scan.files(spark, str(tmp_path)).collect()] == ["a.pdf", "b9.docx", "b10.txt", "broken.docx"]
    got = {r.name: r for r in scan.documents(spark, str(tmp_path)).collect()}
    assert got["b10.txt"].status == "ready" and got["b9.docx"].text == "Line & one\n\nLine two" and got["b9.docx"].status == "warning"
    assert {n: r.status for n, r in got.items() if r.error} == {"a.pdf": "error", "c.png": "error", "broken.docx": "error"}
    made = scan.word_reports(spark.createDataFrame([("a\nb",)], "text string")).first()
    assert scan.docx_text(bytes(made.document)) == "a\n\nb"


def test_ocr_rules(spark):
    df = spark.createDataFrame([("", 1, 1), ("a", 0, 1), ("a" * 100, 3, 3), ("a" * 100, 3, 7), ("a" * 5000, 1, 1)], "t string, i int, p int")
    assert [r.x for r in df.select(retrieval.wants_ocr(F.col("t"), F.col("i"), F.col("p")).alias("x")).collect()] == [True, False, True, False, False]


def test_run_log(spark, tmp_path):
    recs = spark.sql("""select 'gen' operation, string(id) run_id, if(id % 2 = 0, 'success', 'error') status, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) started_at,
        timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) completed_at, 'fetch failed' error_message, 10.06D * id total_ms, map('a', double(id), ' ', 1D) phases, map('k', ' v ') context from range(6)""")
    run_log.append(recs, f"{tmp_path}/log")
    run_log.append(recs, f"{tmp_path}/log")
    back = spark.read.json(f"{tmp_path}/log")
    assert back.count() == 12 and {r.error_category for r in back.collect()} == {"none", "provider-error"}
    got = run_log.drain(run_log.metrics(run_log.read(spark, f"{tmp_path}/log")), f"{tmp_path}/out", f"{tmp_path}/ck").collect()
    assert all(r.runs == 2 for r in got) and len(got) >= 4  # windows beyond the watermark are out


def test_presentation(spark):
    df = spark.createDataFrame([("jd_requirements_missing", "requirements"), ("word_report_employment_entry_empty", "employment"), ("word_report_employment_history_missing", ""), ("odd", None)], "code string, section string")
    got = {r.code: (r.title, r.section_label) for r in review.presented(df).collect()}
    assert got == {"jd_requirements_missing": ("JD requirements are missing", "JD Requirements"), "word_report_employment_entry_empty": ("Word employment entry needs review", "Employment History"), "word_report_employment_history_missing": ("Word employment history is missing", "General"), "odd": ("Review required", "General")}
