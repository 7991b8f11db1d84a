"""The cases: checks, choices, record sets, names, reports and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import text as T
from ..functions import values as X
from ..operators import briefing as B
from ..operators import checks, identity, normalised, report, requests, review, rich_text, scanners, sections, selection
from ..operators import records as C
from .cases import case_query

col = F.col
joined = lambda c: F.array_join(c, "|")


def columns(df, **made):
    """For a query whose columns come from the fields of its row."""
    return df.select("id", *[c.alias(n) for n, c in made.items()])


# --- lines and blocks

case_query(
    "q_split_lines", "text string", "paragraphs string, lines string",
    [
        (("a\r\n\r\nb\nc",), [("a|b\nc", "a|b|c")]), (("",), [("", "")]), ((None,), [("", "")]), (("  x  \n\n\n y z ",), [("x|y z", "x|y z")]), (("one\rtwo",), [("one\ntwo", "one|two")]),
    ],
    lambda df: columns(df, paragraphs=joined(T.paragraphs(col("text"))), lines=joined(T.non_empty_lines(col("text")))),
)


def _blocks(df):
    b = sections.blocks(df.select(col("id").alias("doc_id"), "kind", "text"))
    return b.select(col("doc_id").alias("id"), "block_id", "section_key", "section_label", "reason", F.replace("text", F.lit("\n"), F.lit("/")).alias("body"), joined(col("actions")).alias("done"), F.array_join("paragraphs", ",").alias("places"), "language_hint")


_BLOCK_CASES = [
    (("cv", "-- 1 of 3 --\n\nabc12345_defghij-klmnop9\n\nSome plain text that stays, 2."), [("cv-1", "overview", "Overview", "default_overview", "Some plain text that stays, 2.", "", "3", "en")]),
    (("cv", "Experience\n\n- did a thing, 1."), [("cv-1", "experience", "Experience", "inherited_context", "- did a thing, 1.", "", "2", "en")]),
    (("jd", "Requirements:\n\n- Five years of Python."), [("jd-1", "requirements", "Requirements:", "inherited_context", "- Five years of Python.", "", "2", "en")]),
    (("cv", "BSc Computing, Example University\n2010 - 2014\n\nWidget Ltd\nSoftware Engineer\n2015 - 2019\n\nSkills\n\nPython, SQL;"), [
        ("cv-1", "education", "Education", "structural_pattern", "BSc Computing, Example University/2010 - 2014", "", "1", "en"),
        ("cv-2", "experience", "Experience", "structural_pattern", "Widget Ltd/Software Engineer/2015 - 2019", "", "2", "en"),
        ("cv-3", "skills", "Skills", "inherited_context", "Python, SQL;", "", "4", "en"),
    ]),
    (("cv", "Experience\n• built a large\nsystem for users;\n\nand kept it running."), [("cv-1", "experience", "Experience", "inherited_context", "- built a large system for users; and kept it running.", "normalize_bullet_marker|normalize_wrapped_bullet_continuation|normalize_wrapped_block_continuation", "1,2", "en")]),
    (("cv", "Overview"), [("cv-1", "overview", "Overview", "default_overview", "Overview", "", "1", "en")]),
    (("cv", "  \n "), []),
    (("jd", None), []),
    (("cv", "项目经历\n\nWallet project 2020 - 2021\n- 负责 platform"), [("cv-1", "projects", "项目经历", "inherited_context", "Wallet project 2020 - 2021/- 负责 platform", "", "2", "mixed")]),
    (("guidance", "Use plain words, please."), [("guidance-1", "overview", "Overview", "default_overview", "Use plain words, please.", "", "1", "en")]),
    (("jd", "You must have five years, 1.\n\nYour duties: keep it up, 2."), [
        ("jd-1", "requirements", "Requirements", "structural_pattern", "You must have five years, 1.", "", "1", "en"),
        ("jd-2", "responsibilities", "Responsibilities", "structural_pattern", "Your duties: keep it up, 2.", "", "2", "en"),
    ]),
]
case_query("q_block_model", "kind string, text string", "block_id string, section_key string, section_label string, reason string, body string, done string, places string, language_hint string", _BLOCK_CASES, _blocks)


def _manifest(df):
    m = sections.manifest(df.select(col("id").alias("doc_id"), "kind", "text"))
    return m.select(col("doc_id").alias("id"), "rule_id", "action", "paragraph", "line", "after")


case_query(
    "q_block_manifest", "kind string, text string", "rule_id string, action string, paragraph int, line int, after string",
    [
        (("cv", "-- 1 of 3 --\n\nabc12345_defghij-klmnop9\n\nSome plain text that stays, 2."), [("strip_page_marker", "strip", 1, 1, ""), ("strip_opaque_pdf_artifact", "strip", 2, 1, "")]),
        (("cv", "Experience\n• built a large\nsystem for users;\n\nand kept it running."), [
            ("normalize_bullet_marker", "normalize", 1, 2, "- built a large"), ("normalize_wrapped_bullet_continuation", "normalize", 1, 2, "- built a large system for users;"),
            ("normalize_wrapped_block_continuation", "normalize", 2, 1, "- built a large system for users; and kept it running."),
        ]),
        (("cv", "-----\n\nplain, 1."), [("strip_decoration_only_line", "strip", 1, 1, "")]),
    ],
    _manifest,
)

case_query(
    "q_extraction_text", "label string, text string", "taken string",
    [(("Experience", "did it"), [("did it",)]), (("Widget Works", "did it"), [("Widget Works\ndid it",)]), (("did it", "did it"), [("did it",)]), (("", "x"), [("x",)]), ((None, None), [("",)]), (("General", "x"), [("x",)])],
    lambda df: columns(df, taken=sections.extraction_text(col("label"), col("text"))),
)


def _preferred(df):
    b = sections.blocks(df.select(col("id").alias("doc_id"), F.lit("cv").alias("kind"), "text"))
    return sections.preferred_lines(b, ["experience"], ["projects"]).select(col("doc_id").alias("id"), joined(col("lines")).alias("lines"))


case_query(
    "q_section_lines", "text string", "lines string",
    [
        (("Projects\n\n- made p, 1.\n\nExperience\n\n- did e, 2.\n- did f, 3.",), [("- did e, 2.|- did f, 3.",)]), (("Projects\n\n- made p, 1.\n\nSkills\n\nSQL;",), [("- made p, 1.",)]),
        (("Skills\n\nSQL;\n\nLanguages\n\nEnglish;",), [("SQL;|English;",)]), (("",), []),
    ],
    _preferred,
)

# --- predicates

case_query(
    "q_name_flags", "name string", "flags string",
    [
        (("",), [("candidate_name_missing_or_generic",)]), (("CV 12",), [("candidate_name_missing_or_generic",)]), (("Jane Example",), [("",)]), (("张三",), [("",)]), (("Jane 张",), [("",)]),
        (("jane example",), [("candidate_name_missing_or_generic",)]), (("Email: x",), [("candidate_name_embedded_metadata",)]), (("Jane 2",), [("candidate_name_missing_or_generic",)]),
        (("Jane Example Engineer",), [("candidate_name_heading_or_table_header|candidate_name_embedded_role_or_banner",)]), (("Work Experience",), [("candidate_name_missing_or_generic",)]), ((None,), [("candidate_name_missing_or_generic",)]),
    ],
    lambda df: columns(df, flags=joined(C.name_flags(col("name")))),
)

case_query(
    "q_education_validity", "degree string, school string, start string", "faults string, noise boolean, parsed_degree string, field string",
    [
        (("BSc in Computing", "Example University", ""), [("", False, "BSc", "Computing")]),
        (("Example University", "BSc", ""), [("degree_names_school|school_names_degree|degree_from_job", True, "Example University", "")]),
        (("BSc", "", "2010"), [("school_blank", False, "BSc", "")]),
        (("Skills", "College", ""), [("degree_is_label", False, "Skills", "")]),
        (("Summary", "Overview", ""), [("no_education_word|degree_is_label|school_is_label", False, "Summary", "")]),
        (("Degree: x", "y", ""), [("", False, "Degree: x", "")]),
        (("Master", "Master", ""), [("degree_equals_school|school_names_degree", True, "Master", "")]),
        (("Senior Engineer", "Example College", ""), [("degree_from_job", False, "Senior Engineer", "")]),
        (("MBA", "Widget Bank", ""), [("school_from_job", False, "MBA", "")]),
        ((None, None, None), [("degree_blank|school_blank|no_education_word", False, "", "")]),
    ],
    lambda df: columns(df, faults=joined(C.education_faults(col("degree"), col("school"))), noise=C.education_noise(col("degree"), col("school"), col("start"), F.lit("")), parsed_degree=C.degree_and_field(col("degree"))["degree"], field=C.degree_and_field(col("degree"))["field"]),
)

case_query(
    "q_employment_validity", "title string, company string, duties array<string>", "title_faults string, company_faults string, noise string, score int",
    [
        (("Engineer", "Widget Ltd", ["a", "b"]), [("", "", "", 44)]),
        (("Title: Engineer", "Company Name: Widget Ltd.", []), [("", "", "", 42)]),
        (("", "Widget Ltd", []), [("blank", "", "no_title", 6)]),
        (("Skills", "", []), [("section_label", "blank", "title_is_label", 6)]),
        (("Widget Bank", "", []), [("company", "blank", "title_is_company", 6)]),
        (("Engineer", "", ["Project: x"]), [("", "blank", "duties_of_project", 7)]),
        (("Engineer", "", ["Widget Ltd"]), [("", "blank", "duties_name_company", 7)]),
        (("PMP", "Widget Ltd", []), [("", "", "", 42)]),
        (("PMP", "2020", []), [("", "date", "certificate", 12)]),
        (("Engineer", "Led the team.", []), [("", "sentence", "company_sentence", 12)]),
        (("Engineer", "Project Alpha Engineer", []), [("", "role", "company_project", 12)]),
        (("Example University", "Widget Ltd", []), [("company|institution", "", "", 12)]),
        ((None, None, None), [("blank", "blank", "no_title", None)]),
    ],
    lambda df: columns(df, title_faults=joined(C.title_faults(col("title"))), company_faults=joined(C.company_faults(C.company_name(col("company")))), noise=joined(normalised.employment_noise(col("title"), col("company"), col("duties"))), score=C.employment_score(col("title"), col("company"), F.lit(""), F.lit(""), col("duties"))),
)

case_query(
    "q_project_suspicion", "name string", "odd boolean, odd_in_report boolean",
    [
        (("Wallet Platform",), [(False, False)]), (("",), [(True, True)]), (("and more",), [(True, True)]), (("Languages: English",), [(True, True)]), (("2020.1 platform",), [(True, False)]), (("AWS",), [(True, False)]),
        (("March 2020",), [(True, False)]), (("Senior Engineer",), [(True, False)]), (("built a wallet",), [(True, True)]), (("Built a wallet",), [(True, False)]), (("Search engine.",), [(True, False)]),
        (("Engineer of the Search platform",), [(False, False)]), (("Trading exchange for retail users using queues",), [(True, False)]), (("负责交易平台",), [(True, False)]),
    ],
    lambda df: columns(df, odd=B.suspicious_project(col("name")), odd_in_report=B.suspicious_report_project(col("name"))),
)

case_query(
    "q_company_as_title", "title string, company string", "company_as_title boolean",
    [(("Widget Bank", ""), [(True,)]), (("Widget Bank", "x"), [(False,)]), (("Bank Manager", ""), [(False,)]), (("SKILLS: Go", ""), [(True,)]), (("WIDGET", None), [(True,)]), (("Widget", None), [(False,)]), (("", ""), [(False,)]), (("技能：Go", ""), [(True,)])],
    lambda df: columns(df, company_as_title=normalised.company_as_title(col("title"), col("company"))),
)

# --- record sets

_JOB = "struct<title:string,company:string,start:string,end:string,duties:array<string>>"


def _rows(df, name):
    return df.select("id", F.posexplode(name).alias("ord", "r")).select("id", "ord", "r.*")


case_query(
    "q_normalised_employment", f"jobs array<{_JOB}>", "place int, title string, company string, start string, until string, duties string, flags string",
    [
        (([("Engineer", "Widget Ltd", "2015", "2018", ["a ", ""]), ("engineer", "WIDGET LTD", "2015", "2018", ["b"]), ("Manager", "Other Bank", "2019", "Present", None)],), [(1, "Engineer", "Widget Ltd", "2015", "2018", "a", ""), (2, "Manager", "Other Bank", "2019", "Present", "", "")]),
        (([("Ltd Engineer", "Widget", "2015", "2016", []), ("Acme Corp Software Engineer", "", "2017", "2018", []), ("Freelance consultant", "", "2019", "2020", [])],), [(1, "Freelance consultant", "Self-employed", "2019", "2020", "", ""), (2, "Software Engineer", "Acme Corp", "2017", "2018", "", ""), (3, "Engineer", "Widget Ltd", "2015", "2016", "", "")]),
        (([("Engineer", "Widget Ltd", "2018", "2015", []), ("Engineer", "", "2018", "2015", [])],), [(1, "Engineer", "Widget Ltd", "2018", "2015", "", "employment_chronology_invalid")]),
        (([("Engineer", "", "2010", "2011", ["did it all"])],), [(1, "Engineer", "", "2010", "2011", "did it all", "employment_entry_missing_core_fields")]),
        (([("", "Widget Ltd", "2010", "2011", []), ("Skills", "", "", "", []), ("PMP", "2020", "", "", [])],), []),
        (([],), []),
        ((None,), []),
    ],
    lambda df: normalised.employment(_rows(df, "jobs"), ["id"]).select("id", "place", "title", "company", "start", col("end").alias("until"), joined(col("duties")).alias("duties"), joined(col("flags")).alias("flags")),
)

case_query(
    "q_normalised_education", "rows array<struct<degree:string,school:string,start:string,end:string>>", "place int, degree string, field string, school string, until string, flags string",
    [
        (([("MSc in Trade", "Sample University", "2013", "2014"), ("Bachelor", "Example College", "2009", "2013"), ("msc in trade", "sample university", "2013", "2014")],), [(1, "MSc", "Trade", "Sample University", "2014", ""), (2, "Bachelor", "", "Example College", "2013", "")]),
        (([("Example University", "BSc", "", "")],), []),
        (([("BSc", "", "", "2010"), ("PhD", "Other Institute", None, None)],), [(1, "BSc", "", "", "2010", "education_entry_malformed"), (2, "PhD", "", "Other Institute", "", "")]),
        ((None,), []),
    ],
    lambda df: normalised.education(_rows(df, "rows"), ["id"]).select("id", "place", "degree", "field", "school", col("end").alias("until"), joined(col("flags")).alias("flags")),
)


def _projects(df):
    out = normalised.projects(_rows(df, "works"), _rows(df, "jobs"), ["id"])
    return out.select("id", "place", "name", "summary", joined(col("technologies")).alias("technologies"), "job", joined(col("flags")).alias("flags"))


case_query(
    "q_normalised_projects", "works array<struct<name:string,start:string,end:string,bullets:array<string>>>, jobs array<struct<start:string,end:string>>", "place int, name string, summary string, technologies string, job int, flags string",
    [
        (([("Wallet Platform", "2016", "2017", ["Tech Stack: Go, SQL", "made it "]), ("wallet platform", "2016", "2017", []), ("built it", "2016", "", ["x"])], [("2015", "2018"), ("2019", "Present")]), [(1, "Wallet Platform", "made it", "Go|SQL", 0, "")]),
        (([("Wallet Platform", "2016", "2017", None)], [("2015", "2018"), ("2016", "2019")]), [(1, "Wallet Platform", "", "", None, "project_role_ambiguous")]),
        (([("Wallet Platform", "2011", "", None), ("Indexer Service", "Mar 2020", "", None)], [("2015", "2018"), ("2019", "Present")]), [(1, "Wallet Platform", "", "", None, ""), (2, "Indexer Service", "", "", 1, "")]),
        (([("built a wallet platform", "2016", "2017", ["a"]), ("did things", "2016", "2017", ["a"]), ("made an app", "", "", [])], []), [(1, "built a wallet platform", "a", "", None, "project_name_suspicious")]),
        ((None, None), []),
    ],
    _projects,
)

case_query(
    "q_canonical_validation", "name string, role string, schooling array<struct<degree:string,school:string,flags:array<string>>>, jobs array<struct<flags:array<string>>>, works array<struct<flags:array<string>>>, n int", "issues string, state string",
    [
        (("Jane Example", "Staff Engineer", [("BSc", "Example College", [])], [([],)], [([],)], 3), [("", "green")]),
        (("Jane Example", "Staff Engineer", [], [([],)], [(["project_role_ambiguous"],)], 3), [("project_role_ambiguous@projects:0", "amber")]),
        (("", "Role", [("BSc", "", [])], [([],), (["employment_entry_missing_core_fields", "employment_chronology_invalid"],)], [(["project_name_suspicious"],)], 0), [
            ("candidate_name_missing_or_generic@identity|role_title_missing_or_generic@role|education_entry_malformed@education:0|employment_entry_missing_core_fields@employment:1|employment_chronology_invalid@employment:1|project_name_suspicious@projects:0|jd_requirements_missing@requirements", "red"),
        ]),
        ((None, None, None, None, None, None), [("candidate_name_missing_or_generic@identity|role_title_missing_or_generic@role|jd_requirements_missing@requirements", "red")]),
    ],
    lambda df: df.withColumn("i", normalised.validation(col("name"), col("role"), col("schooling"), col("jobs"), col("works"), col("n"))).select("id", joined(F.transform("i", lambda x: F.concat(x["code"], F.lit("@"), x["section"], F.coalesce(F.concat(F.lit(":"), x["entry"].cast("string")), F.lit(""))))).alias("issues"), normalised.validation_state(col("i")).alias("state")),
)

_H1, _H2, _H3 = [("Engineer", "A", "2010", "", ["x"])], [("Engineer", "A", "2010", "", ["x", "y"])], [("Engineer", "", "", "", []), ("Lead", "", "", "", [])]
case_query(
    "q_history_choice", f"a array<{_JOB}>, b array<{_JOB}>, c array<{_JOB}>", "score int, chosen_score int, whole_text boolean",
    [((_H1, _H2, []), [(37, 41, False)]), ((_H1, _H2, _H3), [(37, 40, False)]), (([], _H3, _H1), [(0, 40, True)]), (([("", "A", "", "", [])], _H3, []), [(8, 40, True)]), (([], [], []), [(0, 0, False)])],
    lambda df: df.select("id", normalised.history_score(col("a")).alias("score"), normalised.history_score(normalised.preferred_history(col("a"), col("b"), col("c"))).alias("chosen_score"), normalised.full_text_history(col("a"), col("b")).alias("whole_text")),
)

case_query(
    "q_evidence_lines", "matches array<struct<evidence:string,score:double>>", "lines string",
    [(([("Built it", 0.5), ("built it", 0.9), ("", 0.9), ("Ran it", 0.2), ("Saw it", 0.1)],), [("Built it|Ran it",)]), (([],), [("",)])],
    lambda df: columns(df, lines=joined(normalised.evidence_lines(col("matches"), 0.2))),
)

# --- names and titles

_FOUND = lambda df: identity.identified(df.select(col("id").alias("doc_id"), "kind", "text", "file_name")).select(col("doc_id").alias("id"), "found")
case_query(
    "q_candidate_names", "kind string, text string, file_name string", "found string",
    [
        (("cv", "Curriculum Vitae\nName: Jane Example\nx@y.org", "cv.pdf"), [("Jane Example",)]),
        (("cv", "Resume\nJane Example\nEmail: x@y.org", "cv.pdf"), [("Jane Example",)]),
        (("cv", "个人简历\n张三 男 | 1990\n电话: 1", "cv.pdf"), [("张三",)]),
        (("cv", "Jane\nExample\nx@y.org", "cv.pdf"), [("Jane Example",)]),
        (("cv", "张三丰 Sam Zhang\nx", "cv.pdf"), [("张三丰 Sam Zhang",)]),
        (("cv", "J a n e E x a m p l e\nx", "cv.pdf"), [("Jane Example",)]),
        (("cv", "Senior Engineer\nWork Experience\n2010 - 2012", "Jane_Example_CV.pdf"), [("Jane Example",)]),
        (("cv", "Senior Engineer\n2010 - 2012", "resume.docx"), [("Candidate",)]),
        (("cv", "李四\n2010 - 2012", "张三简历.pdf"), [("张三",)]),
        (("cv", "Jane Example\nx", "张三的简历.pdf"), [("张三",)]),
        (("cv", "Page | 1 Name: Dr. Jane Example Age: 30\nx", "cv.pdf"), [("Jane Example",)]),
        (("cv", None, None), [("Candidate",)]),
        (("cv", "姓名：王小明 性别：男\nx", "cv.pdf"), [("王小明",)]),
    ],
    _FOUND,
)

case_query(
    "q_role_titles", "kind string, text string, file_name string", "found string",
    [
        (("jd", "About us\nJob Title: Staff Engineer\nx", "jd.pdf"), [("Staff Engineer",)]),
        (("jd", "Role: Overview\nThe Head of Data is responsible for all of it", "jd.pdf"), [("Head of Data",)]),
        (("jd", "Overview\n- bullet line\nCompany: Widget\nStaff Engineer, Data\nmore", "jd.pdf"), [("Staff Engineer, Data",)]),
        (("jd", "Role\nx\n", "data_engineer-2.pdf"), [("data engineer 2",)]),
        (("jd", "", "job_description.pdf"), [("Role",)]),
        (("jd", "岗位名称：数据工程师", "a.txt"), [("数据工程师",)]),
        (("jd", None, "Data Lead.docx"), [("Data Lead",)]),
    ],
    _FOUND,
)

case_query(
    "q_name_fragments", "text string", "found string",
    [(("张三丰 高级工程师",), [("张三丰",)]), (("工作经验 李四",), [("李四",)]), (("平台 大学",), [("平台",)]), (("资深软件工程师",), [("",)]), (("no han at all",), [("",)]), ((None,), [("",)]), (("个人简历",), [("",)]), (("欧阳修文武 王五",), [("王五",)])],
    lambda df: columns(df, found=identity.best_fragment(col("text"))),
)

case_query(
    "q_identity_choice", "a string, b string, p string, q string, r string, s string", "name string, name_from string, place string, place_from string, role string, role_from string",
    [
        (("Jane Example", "John", "Berlin", "Paris", "Staff Engineer", "Lead"), [("Jane Example", "section", "Berlin", "section", "Staff Engineer", "section")]),
        (("Candidate CV", "John", "", "Paris", "Job Description", "Lead"), [("John", "fallback", "Paris", "fallback", "Lead", "fallback")]),
        ((None, "", None, None, "Role", ""), [("", "none", "", "none", "", "none")]),
        (("cv_12", "", " Oslo ", "", "x", "y"), [("", "none", "Oslo", "section", "x", "section")]),
    ],
    lambda df: df.withColumn("i", identity.identity((col("a"), col("b")), (col("p"), col("q")), (col("r"), col("s")))).select("id", *[F.col(f"i.{k}.{v}").alias(n) for k, x in (("name", "name"), ("location", "place"), ("role", "role")) for v, n in (("value", x), ("source", f"{x}_from"))]),
)

# --- checks

_SETTINGS = "provider string, base_url string, model string, api_key string, key_status string, temperature double, max_tokens bigint, system_prompt string, template_mode string, template_path string, template_extension string, output_path string, output_extension string"
case_query(
    "q_settings_errors", _SETTINGS, "errors string",
    [
        (("openai", "https://x", "m", "k", "", 0.5, 1000, "p", "default", "", "", "", ""), [("",)]),
        (("openai", "ftp://x", "m", "", "", 3.0, 100, "p", "default", "", "", "", ""), [("Base URL must start with http:// or https://.|API key is required.|Temperature must be between 0 and 2.|Max tokens must be between 128 and 8192.",)]),
        (("ollama_deepseek_r1", "http://localhost", "m", "", "", 0.0, 100, "p", "", "", "", "", ""), [("",)]),
        (("openai", "https://x", "m", "", "secure-storage-read-failed", 0.0, 128, "p", "local-file", "", "", "", ""), [(checks.KEY_STATUS["secure-storage-read-failed"] + "|Choose a local reference template file or switch back to the built-in default template.",)]),
        (("openai", "https://x", "m", "k", "", 0.0, 8192, "p", "other", "/t.txt", ".TXT", "/o.pdf", ".pdf"), [("Reference template mode must be `default` or `local-file`.|The reference template must be a Markdown (.md) document.|The hiring-manager output template must be a Word .docx or .dotx document.",)]),
        (("", "", "", "k", "", 1.0, 500, "", "default", "/t.md", ".MD", "/o.docx", ".DOCX"), [("Provider is required.|Base URL is required.|Base URL must start with http:// or https://.|Model is required.|System prompt is required.",)]),
    ],
    lambda df: columns(df, errors=joined(checks.settings_errors(F.struct(*[col(c.split(" ")[0]) for c in _SETTINGS.split(", ")])))),
)

case_query(
    "q_payload_errors", "summary string, cv_name string, cv_path string, jd_name string, jd_path string", "error string, mode string, is_workspace boolean",
    [
        (("s", "a.pdf", "", "b.pdf", "/b.pdf"), [(None, "named", False)]), ((" ", "a.pdf", "", "b.pdf", ""), [("A generated recruiter summary is required.", "named", False)]), (("s", "", "", "b.pdf", ""), [("Candidate CV file metadata must include a name or absolute path.", "named", False)]),
        (("s", "a", "x/a.pdf", "b", ""), [("Candidate CV file path must be an absolute path.", "named", False)]), (("anonymous", "a", None, None, "b.pdf"), [("Job description file path must be an absolute path.", "anonymous", False)]), (("0123456789abcdeF", "a", "", "b", ""), [(None, "named", True)]),
    ],
    lambda df: df.select("id", checks.draft_errors(F.struct("summary", "cv_name", "cv_path", "jd_name", "jd_path"), True).alias("error"), checks.output_mode(col("summary")).alias("mode"), checks.workspace_id(col("summary")).alias("is_workspace")),
)

case_query(
    "q_briefing_errors", "name string, title string, fit_summary string, recommended_next_step string", "errors string",
    [(("a", "b", "c", "d"), [("",)]), (("", " ", None, "d"), [("|".join(t for _, t in checks.REQUIRED[:3]),)]), (("a", "b", "c", ""), [(checks.REQUIRED[3][1],)])],
    lambda df: columns(df, errors=joined(checks.briefing_errors(F.struct("name", "title", "fit_summary", "recommended_next_step")))),
)

case_query(
    "q_coerced_lists", "text string", "strings string, pairs string, languages string",
    [(("- Go -> built it\n* SQL\n\n",), [("Go -> built it|SQL", "Go=built it|SQL=", "- Go -> built it * SQL")]), (("English, 中文; English / French",), [("English, 中文; English / French", "English, 中文; English / French=", "English|中文|French")]), ((None,), [("", "", "")]), (("-> only evidence",), [("> only evidence", "> only evidence=", "-> only evidence")])],
    lambda df: columns(df, strings=joined(checks.strings(col("text"))), pairs=joined(F.transform(checks.match_pairs(col("text")), lambda m: F.concat(m["requirement"], F.lit("="), m["evidence"]))), languages=joined(checks.languages(col("text")))),
)

# --- reports

_WHOLE = "{{candidate_name}} for {{ role_title }}: {{Candidate_Summary}}\n{{#employment_history}}{{job_title}}{{/employment_history}}"
case_query(
    "q_template_contract", "template string", "found string, missing string, bars string",
    [
        ((_WHOLE,), [("candidate_name|role_title|Candidate_Summary|#employment_history|job_title|/employment_history", "", "")]), (("{{candidate_name}} {{x}}",), [("candidate_name", "role_title|candidate_summary or fit_summary|employment_history or employment_experience or employment_experience_entries or relevant_experience", "")]),
        (("{{field_of_study}} | {{institution_name}} {{linked_job_title}}|{{linked_company_name}} {{a}} | {{b}}",), [("field_of_study|institution_name|linked_job_title|linked_company_name", "candidate_name|role_title|candidate_summary or fit_summary|employment_history or employment_experience or employment_experience_entries or relevant_experience", "education field and institution|project linked role and company")]),
        (("{{Hiring Manager}}{{Canddidate_Gender}}",), [("Hiring Manager|Canddidate_Gender", "candidate_name|role_title|candidate_summary or fit_summary|employment_history or employment_experience or employment_experience_entries or relevant_experience", "")]),
        ((None,), [("", "candidate_name|role_title|candidate_summary or fit_summary|employment_history or employment_experience or employment_experience_entries or relevant_experience", "")]),
    ],
    lambda df: columns(df, found=joined(report.supported(report.tags(col("template")))), missing=joined(report.missing_groups(col("template"))), bars=joined(report.separators(col("template")))),
)

case_query(
    "q_rendered_reports", "template string, data map<string,string>", "text string, populated string, blank string",
    [
        (("{{candidate_name}} | {{ role_title }}\n{{University}}", {"candidate_name": "Jane", "role_title": "Lead", "university": "X"}), [("Jane | Lead\nX", "candidate_name|role_title|University", "")]),
        (("{{candidate_name}} | {{role_title}}\nx", {"candidate_name": "Jane"}), [("Jane\nx", "candidate_name", "role_title")]),
        (("{{candidate_name}} | {{unknown}} | {{role_title}}", {"candidate_name": "A", "role_title": "B"}), [("A | B", "candidate_name|role_title", "")]),
        (("plain", {}), [("plain", "", "")]),
    ],
    lambda df: df.select("id", F.regexp_replace(report.rendered(col("template"), col("data")), r" ?\| ?", " | ").alias("text"), joined(report.population(col("template"), col("data"))["populated"]).alias("populated"), joined(report.population(col("template"), col("data"))["blank"]).alias("blank")),
)

case_query(
    "q_report_faults", "said string, required array<array<string>>, forbidden array<string>", "faults string",
    [
        (("Jane Example, Staff  Engineer at Widget", [["jane example"], ["nothing", "Staff Engineer"]], ["John"]), [("",)]), (("x {{name}} | | y", [["Jane", "John"]], ["X"]), [("tag: name;missing: Jane or John;forbidden: X;separator: ||",)]),
        ((None, [["a"]], []), [("missing: a",)]), (("a", [], ["", "b"]), [("",)]),
    ],
    lambda df: columns(df, faults=F.array_join(report.report_faults(col("said"), col("required"), col("forbidden")), ";")),
)

_DATA = "struct<candidate_name:string,role_title:string,candidate_summary:string,fit_summary:string,relevant_experience:string,candidate_original_name:string,candidate_english_name:string,employment:array<struct<title:string,company:string,duties:array<string>>>>"
case_query(
    "q_report_payload", f"compatible boolean, data {_DATA}", "version string, required string, forbidden string",
    [
        ((True, ("Anonymous Candidate", "Lead", "Did it.", "Fits.", "", "Jane Example", "", [("Engineer", "Widget", ["", "made it"]), ("Lead", "", []), ("Third", "", [])])), [("1.0", "Anonymous Candidate;Lead;Did it.|Fits.;Engineer|Widget|made it|Lead", "Jane Example")]),
        ((True, ("Jane", "", "x" * 100, None, "Ran it", "Jane Example", "", None)), [("1.0", "Jane;" + "x" * 80 + ";Ran it", "")]),
        ((False, ("Jane", "", "", "", "", "", "", [])), [(None, None, None)]),
        ((None, ("anonymous candidate", "", "", "", "", "Anonymous Candidate", "Sam", [])), [(None, None, None)]),
    ],
    lambda df: df.withColumn("p", report.payload(F.struct(F.lit("a").alias("id"), F.lit("1").alias("version"), F.lit("t").alias("template"), col("compatible")), col("data"), F.lit("r"))).select("id", F.col("p.payload_version").alias("version"), F.array_join(F.transform("p.required", joined), ";").alias("required"), joined(F.col("p.forbidden")).alias("forbidden")),
)

case_query(
    "q_output_names", "path string", "named string",
    [(("/a/b.docx",), [("/a/b.docx",)]), (("/a/b.DOCX ",), [("/a/b.DOCX",)]), (("/a/b.pdf",), [("/a/b.docx",)]), (("/a/b.v2",), [("/a/b.v2.docx",)]), (("",), [(".docx",)])],
    lambda df: columns(df, named=report.output_name(col("path"))),
)

case_query(
    "q_issue_presentation", "code string, section string", "title string, label string",
    [
        (("candidate_name_missing_or_generic", "identity"), [("Candidate name needs review", "Candidate Identity")]), (("word_report_education_entry_empty", "education"), [("Word education entry needs review", "Education")]), (("word_report_employment_entry_empty", "employment"), [("Word employment entry needs review", "Employment History")]),
        (("word_report_project_experience_unreliable", "projects"), [("Word project section needs review", "Project Experiences")]), (("other", "x"), [("Review required", "General")]), (("word_report_employment_history_missing", "requirements"), [("Word employment history is missing", "JD Requirements")]), ((None, None), [("Review required", "General")]),
    ],
    lambda df: review.presented(df).select("id", "title", review.section_label(col("section")).alias("label")),
)

# --- requests

_MATCHES = "array<struct<requirement:string,evidence:string>>"
case_query(
    "q_bullet_lines", f"lines array<string>, matches {_MATCHES}, language string", "bullets string, pairs string, hints string",
    [
        ((["- a", "• b"], [("Go", "built it"), ("SQL", "")], "en"), [("- a\n- b", "- Go -> built it\n- SQL", "- Requirement: Go\n  Evidence hint: built it")]), (([], [], "zh"), [(requests.EMPTY["zh"], requests.NO_MATCHES["zh"], requests.NO_HINTS)]), ((None, [("", "e")], "en"), [(requests.EMPTY["en"], "- e", "- Requirement: \n  Evidence hint: e")]),
    ],
    lambda df: columns(df, bullets=requests.bullets(col("lines"), col("language")), pairs=requests.match_lines(col("matches"), col("language")), hints=requests.hints(col("matches"))),
)

case_query(
    "q_summary_request", f"name string, role string, blocks array<struct<block_id:string,section_label:string,text:string>>, matches {_MATCHES}, mode string", "roles string, asked string",
    [
        (("Jane", "Lead", [("cv-1", "Skills", "Go"), ("cv-2", "X", "Y")], [("Go", "built it")], "named"), [("system|user", "Candidate:\nJane\n\nTarget role:\nLead\n\nCandidate CV source blocks:\n[cv-1] Skills\nGo\n\n[cv-2] X\nY\n\nJob description source blocks:\njd\n\nTemplate:\ng\n\nRequirement-to-evidence hints:\n- Requirement: Go\n  Evidence hint: built it\n\nConstraints:\n" + "\n".join([*requests.CONSTRAINTS["named"], *requests.CONSTRAINTS[""]]))]),
        (("", "Lead", [], [], "anonymous"), [("system|user", "Candidate:\n\n\nTarget role:\nLead\n\nCandidate CV source blocks:\n\n\nJob description source blocks:\njd\n\nTemplate:\ng\n\nRequirement-to-evidence hints:\n" + requests.NO_HINTS + "\n\nConstraints:\n" + "\n".join([*requests.CONSTRAINTS["anonymous"], *requests.CONSTRAINTS[""]]))]),
    ],
    lambda df: df.withColumn("m", requests.messages(F.lit("s"), requests.summary_prompt(col("name"), col("role"), requests.source_context(col("blocks")), F.lit("jd"), F.lit("g"), col("matches"), col("mode")))).select("id", joined(F.transform("m", lambda x: x["role"])).alias("roles"), F.get("m", F.lit(1))["content"].alias("asked")),
)

_DRAFT = f"struct<candidate:struct<name:string,location:string,languages:array<string>,notice_period:string>,role:struct<title:string,company:string>,fit_summary:string,relevant_experience:array<string>,potential_concerns:array<string>,recommended_next_step:string,match_requirements:{_MATCHES},employment:array<struct<title:string,company:string,duties:array<string>>>,summary:string>"
_D1 = (("Jane", "Oslo", ["English"], ""), ("Lead", "Widget"), "Fits", ["- a", "b", "", "c", "d", "e"], ["x"], "Go on", [("Go", "built it")], [("Engineer", "Widget", ["did"])] * 4, "Sum")
_D2 = (("", None, None, None), ("", ""), None, None, None, None, None, None, None)
case_query(
    "q_email_facts", f"draft {_DRAFT}, mode string", "name string, role string, company string, points string, concerns string",
    [((_D1, "named"), [("Jane", "Lead", "Widget", "a|b|c|d", "x")]), ((_D2, "anonymous"), [("Anonymous Candidate", "the role", "(not specified)", "", "")]), ((_D2, "named"), [("the candidate", "the role", "(not specified)", "", "")])],
    lambda df: df.withColumn("f", requests.email_facts(col("draft"), col("mode"))).select("id", "f.name", "f.role", "f.company", F.coalesce(joined(col("f.points")), F.lit("")).alias("points"), F.coalesce(joined(col("f.concerns")), F.lit("")).alias("concerns")),
)

case_query(
    "q_translatable", f"draft {_DRAFT}", "payload string, batches string",
    [
        ((_D1,), [('{"candidate":{"location":"Oslo","languages":["English"],"notice_period":""},"role":{"title":"Lead"},"fit_summary":"Fits","relevant_experience":["- a","b","","c","d","e"],"potential_concerns":["x"],"recommended_next_step":"Go on","match_requirements":[{"requirement":"Go","evidence":"built it"}],"employment":[{"title":"Engineer","duties":["did"]},{"title":"Engineer","duties":["did"]},{"title":"Engineer","duties":["did"]},{"title":"Engineer","duties":["did"]}],"summary":"Sum"}', "3|1")]),
        ((_D2,), [('{"candidate":{},"role":{"title":""}}', "")]),
    ],
    lambda df: df.select("id", requests.translatable(col("draft")).alias("payload"), F.coalesce(joined(F.transform(requests.translation_batches(F.coalesce(col("draft.employment"), F.array())), lambda b: F.size(b).cast("string"))), F.lit("")).alias("batches")),
)

case_query(
    "q_reply_json", "reply string", "payload string",
    [(('Here: {"a": 1} done',), [('{"a": 1}',)]), (("none",), [(None,)]), (('{"a":\n{"b": 2}}',), [('{"a":\n{"b": 2}}',)]), ((None,), [(None,)])],
    lambda df: columns(df, payload=requests.reply_json(col("reply"))),
)

# --- drafts, lines and dates

case_query(
    "q_summary_sections", "summary string", "candidate string, target_role string, fit_summary string, next_step string, tidy string",
    [
        (("Candidate: Jane\nTarget Role: Lead\n## Fit Summary\nGood.\n---\n### Recommended Next Step\nGo on",), [("Jane", "Lead", "Good.", "Go on", "Candidate: Jane\nTarget Role: Lead\n## Fit Summary\nGood.\n---\n### Recommended Next Step\nGo on")]),
        (("# Candidate Profile Summary\n**Candidate**\nJane\n\n\n\nWhy this candidate may be a fit\nx",), [("", "", "", "", "Candidate: Jane\n\n## Fit Summary\nx")]),
        ((None,), [("", "", "", "", "")]),
    ],
    lambda df: B.parsed_summaries(df.withColumn("tidied", F.pandas_udf(lambda s: s.map(B.tidy_summary), "string")(col("summary")))).select("id", *[F.coalesce(F.element_at("sections", k), F.lit("")).alias(n) for k, n in (("candidate", "candidate"), ("target_role", "target_role"), ("fit_summary", "fit_summary"), ("recommended_next_step", "next_step"))], col("tidied").alias("tidy")),
)

case_query(
    "q_line_pieces", "text string", "bullet string, technologies string, degree string, field string, softer string",
    [
        (("- Tech Stack: Go, SQL / Rust",), [("Tech Stack: Go, SQL / Rust", "", "- Tech Stack: Go, SQL / Rust", "", "- Tech Stack: Go, SQL / Rust")]), (("Tech Stack: Go，SQL",), [("Tech Stack: Go，SQL", "Go|SQL", "Tech Stack: Go，SQL", "", "Tech Stack: Go，SQL")]),
        (("MSc in Data Science",), [("MSc in Data Science", "", "MSc", "Data Science", "MSc in Data Science")]), (("• the ideal candidate, a 100% match",), [("the ideal candidate, a 100% match", "", "• the ideal candidate, a 100% match", "", "• the strong candidate, a strong match")]), ((None,), [("", "", "", "", "")]),
    ],
    lambda df: columns(df, bullet=T.strip_bullet(col("text")), technologies=joined(B.technologies(F.array("text"))), degree=C.degree_and_field(col("text"))["degree"], field=C.degree_and_field(col("text"))["field"], softer=B.soften(col("text"))),
)

case_query(
    "q_date_pieces", "text string, start string, end string", "range_start string, range_end string, formatted string, wrong boolean, year int",
    [
        (("Mar 2015 - 2018", "2015", "2018"), [("2015", "2018", "2015 - 2018", False, 2015)]), (("2015.3 至 至今", "2018", "2015"), [("2015", "至今", "2018 - 2015", True, 2015)]), (("none", "2015", ""), [("", "", "2015", None, None)]), (("2015", None, "2018"), [("", "", "2018", None, 2015)]), (("1999/12 to PRESENT", "", ""), [("1999", "PRESENT", "", None, 1999)]),
    ],
    lambda df: columns(df, range_start=X.date_range(col("text"))["start"], range_end=X.date_range(col("text"))["end"], formatted=X.format_range(col("start"), col("end")), wrong=C.chronology_wrong(col("start"), col("end")), year=X.year_of(col("text"))),
)

case_query(
    "q_anonymous_prose", "text string, name string, file_name string", "told string, variants string",
    [
        (("Anonymous Candidate's plan. I met Anonymous Candidate (Sam).", "Jane M. Example (Sam)", "jane_example_cv.pdf"), [("The candidate's plan. I met the candidate.", "Jane M. Example|jane example|Jane|Example|jane|example")]), (("Candidate: Anonymous Candidate (x)\nanonymous", "Al Bo", "x.pdf"), [("Candidate: Anonymous Candidate\nanonymous", "Al Bo")]), ((None, None, None), [("", "")]),
    ],
    lambda df: columns(df, told=T.narrative(col("text")), variants=joined(T.name_variants(col("name"), col("file_name")))),
)

case_query(
    "q_filled_text", "template string, a string", "filled string",
    [(("x {{a}} y {{b}}", "1"), [("x 1 y ",)]), (("{{a}}{{a}}", None), [("",)]), (("no tag", "1"), [("no tag",)])],
    lambda df: columns(df, filled=T.fill_template(col("template"), {"a": col("a")})),
)


def _scan(df, what, *cols):
    return scanners.scan(df.select(col("id").alias("doc_id"), "lines"), what).select(col("doc_id").alias("id"), "ord", *cols)


case_query(
    "q_education_scan", "lines array<string>", "ord int, degree string, school string, started string, ended string",
    [
        ((["Education", "Bachelor of Business", "Example National University", "2011 - 2015", "MSc in Trade", "Sample University (UK)", "2013 - 2014"],), [(0, "Bachelor of Business", "Example National University", "2011", "2015"), (1, "MSc in Trade", "Sample University (UK)", "2013", "2014")]),
        ((["示例大学 | 本科 | 2010 - 2014"],), [(0, "本科", "示例大学", "2010", "2014")]), ((["won a prize", "2010 - 2011"],), []), (([],), []), ((None,), []),
    ],
    lambda df: _scan(df, "education", "degree", "school", col("start").alias("started"), col("end").alias("ended")),
)

case_query(
    "q_project_scan", "lines array<string>", "ord int, name string, started string, ended string, bullets string",
    [
        ((["Projects", "Wallet Platform (2020 - 2021) Tech Stack: Go, SQL", "- built it", "and kept on", "Indexer Service", "- did more"],), [(0, "Wallet Platform", "2020", "2021", "Tech Stack: Go, SQL|built it and kept on"), (1, "Indexer Service", "", "", "did more")]), (([],), []),
    ],
    lambda df: _scan(df, "projects", "name", col("start").alias("started"), col("end").alias("ended"), joined(col("bullets")).alias("bullets")),
)

case_query(
    "q_requirement_match", "wanted array<string>, offered array<string>", "place bigint, requirement string, offered_place bigint",
    [
        ((["Go", "SQL skills", "Rust"], ["sql", "GO!", "Java"]), [(0, "Go", 1), (1, "SQL skills", 0), (2, "Rust", 2)]), ((["Go"], ["Java", "SQL"]), [(0, "Go", None)]), ((["Go", "go"], ["go", "Go"]), [(0, "Go", 0), (1, "go", 1)]), (([], ["x"]), []),
    ],
    lambda df: C.matched(df.select(col("id").alias("doc_id"), "wanted", "offered")).select(col("doc_id").alias("id"), "place", "requirement", "offered_place"),
)


def _merged(df):
    kind = "array<struct<title:string,company:string,start:string,end:string,duties:array<string>>>"

    @F.pandas_udf("array<string>")
    def of(rows):
        return rows.map(lambda x: ["; ".join([r["title"], r["company"], r["start"], r["end"], "/".join(r["duties"])]) for r in C.merge_employment(list(x))])

    return df.select("id", joined(of(col("rows").cast(kind))).alias("merged"))


case_query(
    "q_employment_merge", f"rows array<{_JOB}>", "merged string",
    [
        (([("Engineer", "Widget Ltd", "2015", "2018", ["a"]), ("", "Widget (Ltd)", "2015", "2018", ["b"]), ("Lead", "Other", "2019", "", [])],), [("Engineer; Widget Ltd; 2015; 2018; a|; Widget (Ltd); 2015; 2018; b|Lead; Other; 2019; ; ",)]),
        (([("", "Widget Ltd", "2015", "2018", ["Built it all"]), ("Engineer", "Widget, Ltd", "2015", "2018", ["built it all", "Ran it"])],), [("Engineer; Widget Ltd; 2015; 2018; Built it all/Ran it",)]),
        (([("Engineer", "A", "2015", "2018", ["负责系统开发工作"]), ("Engineer", "A", "2015", "2018", ["Ran the system"])],), [("Engineer; A; 2015; 2018; 负责系统开发工作",)]),
        (([],), [("",)]),
    ],
    _merged,
)

# --- lookups and choices

case_query(
    "q_line_predicates", "text string", "contact boolean, duty boolean, heading boolean, extractable boolean",
    [
        (("jane@x.org",), [(True, False, False, True)]), (("+49 170 123",), [(True, False, False, True)]), (("- did it",), [(False, True, False, True)]), (("l did it",), [(False, True, False, True)]), (("Key Results:",), [(False, False, True, True)]),
        (("Senior Engineer",), [(False, False, False, True)]), (("Led the team",), [(False, False, True, False)]), (("Led the team\n2010 - 2012",), [(False, False, False, True)]), (("Name: Jane\nBSc, Example University\ndegree",), [(False, False, False, False)]),
        (("Name: Jane Engineer\nExample University",), [(False, False, False, True)]), (("",), [(False, False, False, False)]), ((None,), [(False, False, False, False)]),
    ],
    lambda df: columns(df, contact=selection.contact_line(col("text")), duty=selection.duty_line(col("text")), heading=selection.subheading(col("text")), extractable=selection.extractable(col("text"))),
)

case_query(
    "q_file_roles", "files array<struct<name:string,extension:string>>", "name string, jd_score int, cv_score int",
    [
        (([("Jane CV.pdf", ".pdf"), ("job description.docx", ".docx")],), [("Jane CV.pdf", 0, 10), ("job description.docx", 15, 0)]), (([("JD.docx", ".docx"), ("x.docx", ".docx")],), [("JD.docx", 10, 0), ("x.docx", 2, 0)]), (([("CV_x.pdf", ".pdf")],), [("CV_x.pdf", 0, 2)]), (([("resume.docx", ".docx")],), [("resume.docx", 2, 8)]), (([],), []),
    ],
    lambda df: selection.file_roles(df.select("id", F.explode("files").alias("f")).select("id", "f.*"), ["id"]).select("id", "name", "jd_score", "cv_score"),
)

case_query(
    "q_label_values", "lines array<string>", "value string",
    [((["x", "Location: Berlin"],), [("Berlin",)]), ((["Location:", "Oslo"],), [("Oslo",)]), ((["location", "Rome"],), [("Rome",)]), ((["Current Location Paris", "Location: x"],), [("Paris",)]), ((["none"],), [("",)]), ((["Location"],), [("",)]), (([],), [("",)])],
    lambda df: columns(df, value=selection.label_value(col("lines"), ["current location", "location"])),
)

case_query(
    "q_date_lines", "text string", "first string, last string",
    [
        (("2015 - 2018 | Engineer",), [("2015/2018/Engineer", None)]), (("Engineer, 2015.3 – Present",), [(None, "2015.3/Present/Engineer")]), (("2020 –",), [("2020/Present/", None)]), (("2015 to now",), [("2015/now/", None)]), (("since 2015",), [(None, None)]), ((None,), [(None, None)]), (("2015 - 至今 开发",), [("2015/至今/开发", None)]),
    ],
    lambda df: columns(df, first=F.when(selection.dates_first(col("text")).isNotNull(), F.concat_ws("/", *[selection.dates_first(col("text"))[k] for k in ("start", "end", "rest")])), last=F.when(selection.dates_last(col("text")).isNotNull(), F.concat_ws("/", *[selection.dates_last(col("text"))[k] for k in ("start", "end", "rest")]))),
)

_EDITED = "name string, title string, fit_summary string, next_step string, experience array<string>, concerns array<string>, matches array<struct<requirement:string,evidence:string>>"


def _overridden(df):
    kind = df.select(F.struct(*[c.split(" ")[0] for c in _EDITED.split(", ")]).alias("d")).schema["d"].dataType
    d = B.parsed_summaries(df).withColumn("o", selection.overridden(F.struct(*[f.name for f in kind]), col("sections"), kind))
    return d.select("id", "o.name", "o.title", "o.fit_summary", "o.next_step", joined(col("o.experience")).alias("experience"), joined(F.transform("o.matches", lambda m: F.concat(m["requirement"], F.lit("="), m["evidence"]))).alias("matches"))


case_query(
    "q_summary_overrides", f"{_EDITED}, summary string", "name string, title string, fit_summary string, next_step string, experience string, matches string",
    [
        (("Jane", "Lead", "old", "go", ["a"], [], [("Go", "x")], "Candidate: Sam\n## Fit Summary\nnew\n## Relevant Experience\n- b\n- c\n## Match Against Key Requirements\n- SQL -> y\n- Rust"), [("Sam", "Lead", "new", "go", "b|c", "SQL=y|Rust=")]),
        (("Jane", "Lead", "old", "go", ["a"], [], [("Go", "x")], ""), [("Jane", "Lead", "old", "go", "a", "Go=x")]), (("Jane", "Lead", "old", "go", ["a"], [], [], "Target Role: Chief\n## Recommended Next Step\nstop"), [("Jane", "Chief", "old", "stop", "a", "")]),
    ],
    _overridden,
)

case_query(
    "q_first_blocks", "refs array<struct<block_ids:array<string>>>, blocks array<struct<block_id:string,text:string>>", "ord int, text string",
    [(([(["x", "b"],), (["a"],), ([],)], [("a", "A"), ("b", "B")]), [(0, "B"), (1, "A"), (2, None)]), (([(["b", "a"],)], [("a", "A"), ("b", "B")]), [(0, "B")]), (([], [("a", "A")]), [])],
    lambda df: selection.first_block(_rows(df, "refs"), df.select("id", F.explode("blocks").alias("b")).select("id", "b.*"), ["id"]),
)

case_query(
    "q_requirement_choice", "a array<string>, b array<string>", "rows string, source string",
    [((["x"], ["y"]), [("x", "section")]), (([], ["y"]), [("y", "fallback")]), ((None, []), [("", "none")])],
    lambda df: df.withColumn("c", selection.chosen_requirements(col("a"), col("b"))).select("id", joined(col("c.rows")).alias("rows"), "c.source"),
)

_PATHS = "array<struct<path:string>>"
case_query(
    "q_remaining_files", f"files {_PATHS}, selected {_PATHS}, loaded {_PATHS}", "others string, stale string",
    [(([("a",), ("b",), ("c",)], [("b",)], [("b",), ("z",)]), [("a|c", "z")]), (([("a",)], [], []), [("a", "")]), (([], [("a",)], [("a",)]), [("", "a")])],
    lambda df: df.select("id").join(selection.other_files(*[df.select("id", F.explode(c).alias("p")).select("id", "p.path") for c in ("files", "selected")], ["id"]).groupBy("id").agg(joined(F.sort_array(F.collect_list("path"))).alias("others")), "id", "left")
    .join(selection.stale(*[df.select("id", F.explode(c).alias("p")).select("id", "p.path") for c in ("loaded", "files")], ["id"]).groupBy("id").agg(joined(F.sort_array(F.collect_list("path"))).alias("stale")), "id", "left").na.fill("", ["others", "stale"]),
)

case_query(
    "q_profile_projections", "name string, place string, langs array<string>, degree string, rows array<struct<degree:string,school:string,start:string,end:string>>", "name string, place string, languages string, degrees string",
    [((" Jane ", None, ["English", "", None], "BSc", []), [("Jane", "", "English", "BSc")]), (("", " x", None, "", [("MSc", "S", "1", "2"), ("PhD", "T", "", "")]), [("", "x", "", "MSc|PhD")])],
    lambda df: df.select("id", "rows", "degree", selection.derived_profile(F.struct(*[(col({"candidate_name": "name", "candidate_location": "place"}[c]) if c in ("candidate_name", "candidate_location") else F.lit(" x ")).alias(c) for c in selection.PROFILE_FIELDS], col("langs").alias("candidate_languages"))).alias("p")).select("id", F.col("p.candidate_name").alias("name"), F.col("p.candidate_location").alias("place"), joined(F.col("p.candidate_languages")).alias("languages"), joined(F.transform(selection.legacy_education(col("rows"), F.struct("degree", F.lit("").alias("school"), F.lit("").alias("start"), F.lit("").alias("end"))), lambda r: r["degree_name"])).alias("degrees")),
)

# --- tokens, working text, warnings and merges

case_query(
    "q_token_cases", "text string", "every string, kept string, distinct_kept string",
    [
        (("The 区块链 wallet a b2",), [("the|区块|块链|wallet|a|b2", "区块|块链|wallet|b2", "区块|块链|wallet|b2")]), (("链",), [("链", "", "")]), (("a中文b",), [("a中|中文|文b", "a中|中文|文b", "a中|中文|文b")]), (("Go, go; GO!",), [("go|go|go", "go|go|go", "go")]), (("of the",), [("of|the", "", "")]), ((None,), [("", "", "")]),
    ],
    lambda df: columns(df, every=joined(T.all_tokens(col("text"))), kept=joined(T.tokens(col("text"))), distinct_kept=joined(T.distinct_tokens(col("text")))),
)

case_query(
    "q_working_text", "text string, kind string", "working string, hint string",
    [
        (("负责 platform", "cv"), [("responsible for platform", "mixed")]), (("工作经历：", "jd"), [("Experience :", "zh")]), (("a，b（c）", "cv"), [("a, b(c)", "en")]), (("负责", "guidance"), [("", "zh")]), (("plain\n\n text ", "jd"), [("plain\ntext", "en")]), ((None, "cv"), [("", "unknown")]), (("12", "cv"), [("12", "unknown")]),
    ],
    lambda df: columns(df, working=T.working_text(col("text"), col("kind")), hint=T.language_hint(col("text"))),
)

_WHOLE_SUMMARY = {"fit_summary": "a", "relevant_experience": "b", "match_requirements": "c", "recommended_next_step": "d"}
_SUPPORT = "Several requirement matches do not include clear supporting evidence."
case_query(
    "q_draft_warnings", "sections map<string,string>, jobs int, matches int, supported int, name string, role string, prose string, anonymous boolean, sources int", "n int, first string, last string",
    [
        ((_WHOLE_SUMMARY, 1, 2, 1, "Jane", "Lead", "good fit", False, 3), [(0, "", "")]),
        (({}, 1, 2, 2, "Jane", "Lead", "", False, 1), [(4, B.MISSING[0][1], B.MISSING[3][1])]),
        ((_WHOLE_SUMMARY, 0, 0, 0, "resume.pdf", "Job Description", "the ideal candidate", False, 0), [(6, "Hiring-manager briefing is missing employment history details.", "Source evidence is incomplete for this draft. Verify key claims manually before approval.")]),
        ((_WHOLE_SUMMARY, 1, 3, 1, "CV", "Lead", "", True, 1), [(1, _SUPPORT, _SUPPORT)]),
    ],
    lambda df: df.withColumn("w", B.draft_warnings(col("sections"), col("jobs"), col("matches"), col("supported"), col("name"), col("role"), col("prose"), col("anonymous"), col("sources"))).select("id", F.size("w").alias("n"), *[F.coalesce(F.regexp_replace(F.get("w", i), r"^(Several .*? evidence\.).*$", "$1"), F.lit("")).alias(n) for n, i in (("first", F.lit(0)), ("last", F.size("w") - 1))]),
)

_REQ = "array<struct<requirement:string,evidence:string,refs:array<string>>>"
case_query(
    "q_requirement_upsert", f"a {_REQ}, b {_REQ}", "ord int, requirement string, evidence string, refs string",
    [
        (([("Go", "", ["x"]), ("SQL", "e", [])], [("go ", "f", ["y", "x"]), ("Rust", "g", ["z"]), ("", "h", [])]), [(1, "Go", "f", "x|y"), (2, "SQL", "e", ""), (3, "Rust", "g", "z")]), (([], []), []), (([("A", "1", ["p"])], [("a", "2", ["q"])]), [(1, "A", "1", "p|q")]),
    ],
    lambda df: B.upsert_requirements(_rows(df, "a"), _rows(df, "b"), ["id"]).select("id", "ord", "requirement", "evidence", joined(F.sort_array("refs")).alias("refs")),
)

_NESTED = "struct<candidate:struct<name:string,skills:array<string>>,fit_summary:string,employment:array<struct<title:string>>>"


def _nested(df):
    kind = df.schema["p"].dataType
    filled, told = B.with_fallback(col("p"), col("f"), kind), B.report(col("p"), col("f"), kind)
    hidden = B.anonymised(col("p"), kind, F.array(F.lit("Jane")))
    titles = lambda c: joined(F.transform(c["employment"], lambda e: e["title"]))
    out = df.select("id", filled.alias("a"), told.alias("b"), hidden.alias("h"))
    return out.select("id", F.col("a.candidate.name").alias("name"), joined(F.col("a.candidate.skills")).alias("skills"), F.col("a.fit_summary").alias("fit"), titles(col("a")).alias("titles"), titles(col("b")).alias("report_titles"), F.col("h.candidate.name").alias("hidden_name"), F.col("h.fit_summary").alias("hidden_fit"))


case_query(
    "q_draft_merges", f"p {_NESTED}, f {_NESTED}", "name string, skills string, fit string, titles string, report_titles string, hidden_name string, hidden_fit string",
    [
        (((("Jane", ["Go"]), "Jane fits, a@b.org", [("Lead",)]), (("X", ["SQL", "Go"]), "other", [("Engineer",)])), [("Jane", "Go|SQL", "Jane fits, a@b.org", "Lead", "Engineer", "Anonymous Candidate", "The candidate fits, [email redacted]")]),
        (((("", None), " ", []), (("X", ["SQL"]), "other", [("Engineer",)])), [("X", "SQL", "other", "Engineer", "Engineer", "Anonymous Candidate", " ")]),
        (((("Jane", []), "f", [("Lead",)]), (("X", []), "o", [])), [("Jane", "", "f", "Lead", "Lead", "Anonymous Candidate", "f")]),
    ],
    _nested,
)

case_query(
    "q_rich_text", "text string", "blocks string, html string",
    [
        (("# Title\n- a\n* b <c>\n\nplain line one\nand two. x\nName: Jane Doe\nKey Skills:\n-- 1 of 2 --\n- z",), [("heading:Title|list:a/b <c>|paragraph:plain line one and two. x|label:Jane Doe|heading:Key Skills|list:z", "<h3>Title</h3>\n<ul><li>a</li><li>b &lt;c&gt;</li></ul>\n<p>plain line one and two. x</p>\n<p><strong>Name:</strong> Jane Doe</p>\n<h3>Key Skills</h3>\n<ul><li>z</li></ul>")]),
        (("",), [("", "<p>No readable content available yet.</p>")]), ((None,), [("", "<p>No readable content available yet.</p>")]), (("one.\r\n\r\n\r\n\r\ntwo.",), [("paragraph:one.|paragraph:two.", "<p>one.</p>\n<p>two.</p>")]),
    ],
    lambda df: columns(df, blocks=joined(F.transform(rich_text.blocks(col("text")), lambda b: F.concat(b["kind"], F.lit(":"), F.replace(b["text"], F.lit("\n"), F.lit("/"))))), html=rich_text.html(col("text"))),
)

case_query(
    "q_place_lines", "text string", "company boolean, place boolean",
    [
        (("Widget Ltd",), [(True, False)]), (("IBM",), [(True, False)]), (("CTO Manager",), [(False, False)]), (("London",), [(False, True)]), (("Oslo, Norway",), [(False, True)]), (("南京市",), [(False, True)]), (("Oslo 2",), [(False, False)]), (("Manager, Oslo",), [(False, False)]), (("",), [(False, False)]), ((None,), [(False, False)]),
    ],
    lambda df: columns(df, company=selection.company_line(col("text")), place=selection.location_line(col("text"))),
)


def _reviews(df):
    issues = df.select(col("id").alias("doc_id"), F.explode("issues").alias("i")).select("doc_id", "i.*")
    said = df.select(col("id").alias("doc_id"), F.posexplode("decisions").alias("at", "d")).select("doc_id", "at", "d.*")
    out = api.render_review(df.select(col("id").alias("doc_id")), issues, said)
    return out.select(col("doc_id").alias("id"), "raw_state", "state", "posture", "exportable")


_KEY = "::project_role_ambiguous::projects::::::::::::::::"
case_query(
    "q_render_review", "issues array<struct<code:string,severity:string,section:string>>, decisions array<struct<issue_key:string,decision_type:string>>", "raw_state string, state string, posture string, exportable boolean",
    [
        (([("project_role_ambiguous", "amber", "projects")], []), [("amber", "amber", "review-required", False)]), (([("project_role_ambiguous", "amber", "projects")], [(_KEY, "keep-project-unlinked")]), [("amber", "amber", "allowed", True)]),
        (([("role_title_missing_or_generic", "red", "role")], [("::role_title_missing_or_generic::role::::::::::::::::", "mark-reviewed")]), [("red", "red", "blocked", False)]), (([], []), [("green", "green", "allowed", True)]),
    ],
    _reviews,
)
