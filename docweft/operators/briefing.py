"""Drafts and reports: summary sections, warnings, softening, fit, requirement and project rules, report quality."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import nested
from ..functions import text as T
from ..functions import vocabulary as V
from . import records as C
from . import relational as R

# Labels and headings of a summary.
SUMMARY_FIELDS = {"candidate": "candidate", "candidate name": "candidate", "target role": "target_role", "候选人": "candidate", "目标职位": "target_role"}
SUMMARY_SECTIONS = {
    "fit summary": "fit_summary", "relevant experience": "relevant_experience", "match against key requirements": "match_requirements", "potential concerns / gaps": "potential_concerns",
    "recommended next step": "recommended_next_step", "匹配概述": "fit_summary", "相关经验": "relevant_experience", "与关键要求的匹配": "match_requirements", "潜在顾虑 / 差距": "potential_concerns", "建议下一步": "recommended_next_step",
}
# Claims that are too strong, and what softens them.
STRONG = [
    r"(?i)(?<![A-Za-z0-9_])100%\s+(?:fit|match)(?![A-Za-z0-9_])", r"(?i)(?<![A-Za-z0-9_])(?:definitely|guarantee(?:d|s)?|ideal candidate|perfect (?:candidate|fit|match)|undoubtedly|without question)(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])(?:fully meets all requirements|meets every requirement|no gaps?)(?![A-Za-z0-9_])", "百分之百匹配|保证匹配|毫无疑问|完全匹配|没有任何差距",
]
SOFTER = [
    (r"(?i)\bideal candidate\b", "strong candidate"), (r"(?i)\bperfect (candidate|fit|match)\b", "strong $1"), (r"(?i)\b100%\s+(fit|match)\b", "strong $1"),
    (r"(?i)\b(?:fully meets all requirements|meets every requirement)\b", "addresses the core requirements well"),
]
# Labels of drafts that name nothing, and texts of warnings.
DRAFT_CANDIDATE = ["candidate", "candidate cv", "candidate profile", "candidate resume", "cv", "profile", "resume"]
DRAFT_ROLE = ["about the job", "information", "job", "job description", "job summary", "overview", "position", "role", "岗位信息", "岗位描述", "职位", "职位信息", "职位描述", "信息"]
MISSING = [
    ("fit_summary", "Recruiter summary is missing the fit summary section."), ("relevant_experience", "Recruiter summary is missing the relevant experience section."),
    ("match_requirements", "Recruiter summary is missing the match against key requirements section."), ("recommended_next_step", "Recruiter summary is missing the recommended next step section."),
]
NEXT_STEP = [
    "Recommend moving this candidate into recruiter review with follow-up questions focused on current scope, team fit, and role context.",
    "Recommend a recruiter screen to validate the strongest matched experience areas and close the remaining evidence gaps before manager sharing.",
    "Recommend further recruiter review before sharing, as the current CV does not yet provide enough direct evidence against the role requirements.",
]
# Hints of project names.
SIGNAL = C._words("app|automation|blockchain|browser|cloud|engine|exchange|feed|framework|marketplace|module|nas|netbackup|phibox|phicoin|platform|portal|product|project|search|service|solution|storage|system|taas|testing|trading|vcf|wallet")
CERTIFICATE = r"(?i)^(?:certificate|certificates|certification|certifications)$|(?<![A-Za-z0-9_])(?:acp|aws|azure|ccna|ccnp|cet-\d|gcp|ielts|istqb|oracle|pmp|rhce|rhcsa|toefl)(?![A-Za-z0-9_])"
MONTH_YEAR = r"(?i)(?<![A-Za-z0-9_])(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+(?:19|20)\d{2}(?![A-Za-z0-9_])"
DID = r"(?i)^(?:achieved|architected|built|contributed|delivered|designed|developed|handled|implemented|integrated|migrated|optimized|reduced)(?![A-Za-z0-9_])"
VERB = C._words("include(?:s|d)?|integrating|is|mainly|provides?|redirect|responsible|used?|using|was|were")
TECH = r"(?i)^(?:tech stack|使用技术)\s*[:：]\s*"


def heading_key(s: str) -> str:
    plain = re.sub(r"[*_`]+", "", re.sub(r"^#+\s*", "", s.strip()))
    return re.sub(r"[:：]$", "", re.sub(r"\s*/\s*", " / ", plain)).lower().strip()


def summary_sections(text: str | None) -> dict[str, str]:
    """The fields and sections of a summary; a later section of a name replaces an earlier one, headings that name none stay content."""
    found: dict[str, str] = {}
    name, held = None, []

    def close() -> None:
        if name:
            found[name] = "\n".join(held).strip()
        held.clear()

    for line in (text or "").replace("\r\n", "\n").strip().split("\n"):
        if re.fullmatch(r"\s*(?:[-*_]\s*){3,}\s*", line):
            continue
        label = re.match(r"([^:：]+)[:：]\s*(.+)$", line)
        field = SUMMARY_FIELDS.get(heading_key(label[1])) if label else None
        marked = re.match(r"##+\s+(.+)$", line)
        section = SUMMARY_SECTIONS.get(heading_key(marked[1] if marked else line))
        if field:
            close()
            found[field], name = label[2].strip(), None
        elif section and (marked or not re.match(r"[-*•]\s*", line)):
            close()
            name = section
        elif name:
            held.append(line)
    close()
    return found


def parsed_summaries(df: DataFrame, text: str = "summary") -> DataFrame:
    """Adds ``sections``, a map of what summary_sections() finds."""

    @F.pandas_udf("map<string,string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(summary_sections)

    return df.withColumn("sections", of(F.col(text)))


def tidy_summary(text: str | None) -> str:
    """A generated summary without emphasis marks and title, with single blank lines, and with candidate and role as labelled lines."""
    lines = [" ".join(x.replace("**", "").replace("__", "").split()) for x in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out, waiting = [], None
    for line in lines:
        heading = re.sub(r"^#+\s*", "", line).strip().lower()
        if waiting:
            if line:
                out.append(f"{waiting}: {line}")
                waiting = None
        elif not line:
            if not out or out[-1]:
                out.append("")
        elif heading in ("candidate", "target role"):
            waiting = heading.title()
        elif heading == "why this candidate may be a fit":
            out.append("## Fit Summary")
        elif heading not in ("candidate profile summary", "候选人摘要"):
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def strong_claim(c: Column) -> Column:
    x = T.clean_line(c)
    return reduce(lambda a, b: a | b, [x.rlike(p) for p in STRONG])


def soften(c: Column) -> Column:
    return reduce(lambda a, p: F.regexp_replace(a, p[0], p[1]), SOFTER, T.some(c))


def generic_draft_label(c: Column, names: list[str]) -> Column:
    x = T.loose_key(c)
    return x.rlike(r"\.(pdf|doc|docx|txt)$") | x.isin(names)


def draft_warnings(sections: Column, n_employment: Column, n_matches: Column, n_supported: Column, name: Column, role: Column, narrative: Column, anonymous: Column, n_sources: Column) -> Column:
    """The warnings of a draft, in order. ``n_sources`` is the smaller count of the two retrieval manifests."""
    gone = lambda k: T.clean_line(F.element_at(sections, k)) == ""
    return F.array_compact(
        F.array(
            *[F.when(gone(k), told) for k, told in MISSING],
            F.when(n_employment == 0, "Hiring-manager briefing is missing employment history details."),
            F.when(n_matches == 0, "Hiring-manager briefing is missing requirement-to-evidence matches.").when(n_supported < F.ceil(n_matches / 2), "Several requirement matches do not include clear supporting evidence. Recheck the draft before approval."),
            F.when(~anonymous & generic_draft_label(name, DRAFT_CANDIDATE), "Candidate name looks generic or file-derived. Recheck the loaded CV before sharing."),
            F.when(generic_draft_label(role, DRAFT_ROLE), "Role title looks generic or source-derived. Recheck the loaded JD before sharing."),
            F.when(strong_claim(narrative), "The draft uses strong certainty language. Verify that the evidence supports those claims before approval."),
            F.when(n_sources == 0, "Source evidence is incomplete for this draft. Verify key claims manually before approval."),
        )
    )


def fit(matches: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope, from (place, requirement, evidence, score): strengths (score of 0.2 or more), gaps, experience lines (0.18 or more, without repeats, four) and the next step."""
    rows = matches.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("place", "requirement", "evidence", "score"))).alias("m"))
    strong, weak = F.filter("m", lambda x: x["score"] >= 0.2), F.filter("m", lambda x: x["score"] < 0.2)
    told = F.transform(F.filter("m", lambda x: (x["score"] >= 0.18) & (T.some(x["evidence"]) != "")), lambda x: x["evidence"])
    n_strong, n_weak = F.size(strong), F.size(weak)
    step = F.when((n_strong >= 3) & (n_weak <= 1), NEXT_STEP[0]).when(n_strong >= 1, NEXT_STEP[1]).otherwise(NEXT_STEP[2])
    names = lambda m, n: F.slice(F.transform(m, lambda x: x["requirement"]), 1, n)
    return rows.select(*scope, n_strong.alias("n_strengths"), n_weak.alias("n_gaps"), names(strong, 3).alias("strengths"), names(weak, 3).alias("gaps"), F.slice(R.union_keep_first(told), 1, 4).alias("experience"), step.alias("next_step"))


def requirements(df: DataFrame, scope: list[str], text: str = "requirement", title: str = "role_title") -> DataFrame:
    """The requirements that say something: without bullets and repeats, not the role's title, no label, of two words or four CJK characters in a row. Columns: scope, ord, text, title."""
    plain = F.regexp_replace(T.clean_line(F.col(text)), r"^[-*•]\s*", "")
    rows = df.withColumn(text, T.clean_line(plain)).withColumn("key", T.loose_key(F.col(text)))
    first = R.keep_first(rows, ["key"], [F.col("ord")], scope)
    empty = (F.col("key") == T.loose_key(F.col(title))) | F.col(text).rlike(r"(?i)^role\s*[:：]") | F.col("key").isin(*C.GENERIC_ROLE, "岗位信息", "基础工作信息")
    return first.filter(~empty & (F.col("key").contains(" ") | F.col("key").rlike("[一-鿿]{4,}"))).drop("key")


def upsert_requirements(primary: DataFrame, fallback: DataFrame, scope: list[str]) -> DataFrame:
    """Both sources by requirement in any case: the first non-empty evidence stays, references are united. Columns: scope, ord, requirement, evidence, refs array<string>."""
    both = primary.withColumn("src", F.lit(0)).unionByName(fallback.withColumn("src", F.lit(1)))
    both = both.withColumn("requirement", T.clean_line(F.col("requirement"))).withColumn("key", F.lower("requirement")).filter("key <> ''")
    g = both.groupBy(*scope, "key").agg(F.array_sort(F.collect_list(F.struct("src", "ord", "requirement", T.clean_line(F.col("evidence")).alias("evidence"), "refs"))).alias("x"))
    first = lambda c: F.get(F.filter(F.transform("x", lambda r: r[c]), lambda v: v != ""), F.lit(0))
    merged = g.select(*scope, F.struct(F.get("x", F.lit(0))["src"], F.get("x", F.lit(0))["ord"]).alias("place"), first("requirement").alias("requirement"), F.coalesce(first("evidence"), F.lit("")).alias("evidence"), F.array_distinct(F.flatten(F.transform("x", lambda r: F.coalesce(r["refs"], F.array().cast("array<string>"))))).alias("refs"))
    return merged.withColumn("ord", F.row_number().over(Window.partitionBy(*scope).orderBy("place"))).drop("place")


def suspicious_project(c: Column) -> Column:
    """A name that is more likely a fragment, a label, a date, a certificate, a degree or a role than a project."""
    x = T.clean_line(c)
    n_words, n = F.size(F.split(x, " ")), F.char_length(x)
    what = (x == "") | x.rlike(C.PREFIX) | x.rlike(C.LABEL) | x.rlike(C.DATES) | x.rlike(CERTIFICATE) | x.rlike(r"(?i)^(?:technical points?|recommendation)(?![A-Za-z0-9_])[:：]?") | x.rlike(MONTH_YEAR)
    what = what | ((x.rlike(C.EDUCATION) | x.rlike(C.ROLE)) & ~x.rlike(SIGNAL)) | x.rlike("^[a-z]") | x.rlike(DID) | ((n_words > 5) & x.rlike(VERB))
    return what | (n > 90) | x.rlike("[。.!?]$|。|掌握|熟练|能够|负责|使用") | ((n > 60) & ~x.rlike("[()（）]")) | ((n_words > 8) & x.rlike("[，,;；:：]"))


def technologies(bullets: Column) -> Column:
    """What the first "Tech Stack:" bullet lists."""
    first = F.get(F.filter(F.transform(bullets, T.clean_line), lambda b: b.rlike(TECH)), F.lit(0))
    return F.coalesce(F.filter(F.transform(F.split(F.regexp_replace(first, TECH, ""), "[,，/]"), T.clean_line), lambda x: x != ""), F.array().cast("array<string>"))


def project_summary(bullets: Column) -> Column:
    """The first bullet that says something else."""
    return F.coalesce(F.get(F.filter(F.transform(bullets, T.clean_line), lambda b: (b != "") & ~b.rlike(TECH)), F.lit(0)), F.lit(""))


EMPLOYMENT = "valid int, malformed int, score int, structured int, broken int, n int"


def choose_employment(s: str, f: str, bounded: Column) -> Column:
    """'section', 'fallback' or 'none' for two candidate sets, given as structs of counts (EMPLOYMENT); ``bounded`` if sections are reliable boundaries."""
    a, b = F.col(s), F.col(f)
    section, fallback = F.lit("section"), F.lit("fallback")
    structured = (a["structured"] >= 3) & (b["broken"] >= 2)
    clean = (a["valid"] >= 3) & (a["malformed"] == 0)
    loose = F.when((a["n"] == 0) & (b["n"] == 0), "none").when(a["n"] == 0, fallback).when(b["n"] == 0, section)
    loose = loose.when((a["valid"] > 0) & (b["malformed"] >= a["malformed"] + 2) & (a["valid"] >= F.greatest(F.lit(2), b["valid"] - 1)), section).when((clean & (b["malformed"] > 0)) | structured, section).otherwise(fallback)
    by_score = F.when(a["score"] >= b["score"], section).otherwise(fallback)
    neither = (a["valid"] == 0) & (b["valid"] == 0)
    strict = F.when(neither, by_score).when(structured, section).when(a["valid"] > b["valid"], section).when(a["valid"] < b["valid"], fallback).when(a["malformed"] < b["malformed"], section).when(a["malformed"] > b["malformed"], fallback).otherwise(by_score)
    return F.when(bounded, strict).otherwise(loose)


def employment_counts(title: Column, company: Column, start: Column, end: Column, duties: Column) -> Column:
    """The struct of counts of a set, as an aggregate over its rows."""
    t, c = T.clean_line(title), T.clean_line(company)
    score = C.employment_score(title, company, start, end, duties)
    valid = C.plausible_company(company) & C.plausible_title(title)
    dated = (T.clean_line(start) != "") | (T.clean_line(end) != "")
    count = lambda cond: F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("int")), F.lit(0)).cast("int")
    return F.struct(count(score.isNotNull() & valid).alias("valid"), count(score.isNotNull() & ~valid).alias("malformed"), F.coalesce(F.sum(score), F.lit(0)).cast("int").alias("score"), count((t != "") & (c != "") & dated).alias("structured"), count((t == "") | (c == "")).alias("broken"), F.count(F.lit(1)).cast("int").alias("n"))


def report_issues(name: Column, role: Column, education: Column, employment: Column, projects: Column) -> Column:
    """The codes of a report's issues, in order. education: array<struct<degree, school>>, employment: array<struct<title, company>>, projects: array<string>."""
    skills, caps = r"(?i)^(?:skills?|technical skills|tech stack|专业技能|技能|技术栈)\s*[:：]?", r"^[A-Z][A-Z0-9&.\s-]{2,}$"

    def of_education(e: Column) -> Column:
        d, s = T.clean_line(e["degree"]), T.clean_line(e["school"])
        either = (d == "") | (s == "")
        merged = F.when(either & F.concat_ws(" ", d, s).contains("|"), "word_report_education_entry_merged_fields")
        leaked = F.when((s == "") & C.polluted(d) & ~d.rlike(C.EDUCATION), "word_report_education_entry_polluted")
        return F.when((d == "") & (s == ""), F.array(F.lit("word_report_education_entry_empty"))).otherwise(F.array_compact(F.array(merged, leaked)))

    def of_employment(e: Column) -> Column:
        t, c = T.clean_line(e["title"]), T.clean_line(e["company"])
        swapped = (t != "") & (c == "") & (t.rlike(skills) | (~t.rlike(C.ROLE) & (t.rlike(C.COMPANY) | t.rlike(caps))))
        codes = F.array_compact(F.array(F.when(t.rlike(skills), "word_report_employment_role_skill_heading"), F.when(swapped, "word_report_employment_role_looks_like_company")))
        return F.when((t == "") & (c == ""), F.array(F.lit("word_report_employment_entry_empty"))).otherwise(codes)

    n, odd = F.size(projects), F.size(F.filter(projects, suspicious_report_project))
    one = lambda cond, code: F.array_compact(F.array(F.when(cond, code)))
    return F.concat(
        one(generic_draft_label(name, DRAFT_CANDIDATE), "word_report_candidate_name_generic"),
        one(generic_draft_label(role, DRAFT_ROLE), "word_report_role_title_generic"),
        one(F.size(education) > 6, "word_report_education_overflow"),
        F.flatten(F.transform(education, of_education)),
        one(F.size(employment) == 0, "word_report_employment_history_missing"),
        F.flatten(F.transform(employment, of_employment)),
        one((n > 12) & (odd >= F.greatest(F.lit(2), F.ceil(n * 0.2))), "word_report_project_experience_over_expanded"),
        one((odd >= 3) & (odd >= F.ceil(n * 0.4)), "word_report_project_experience_unreliable"),
    )


def suspicious_report_project(c: Column) -> Column:
    x = T.clean_line(c)
    return (x == "") | x.rlike(C.PREFIX) | x.rlike(C.LABEL) | x.rlike("^[a-z]") | (F.char_length(x) > 90) | ((F.size(F.split(x, " ")) > 8) & x.rlike("[，,;；:：]"))


def clipboard_text(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Subject: "), T.clean_line(subject), F.lit("\n\n"), F.trim(T.some(body)))


def escape_html(c: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, T.some(c))


# What a report takes from the deterministic draft first, and what it unites.
FACTS = frozenset({"education", "employment", "employment_history", "projects", "project_experiences"})
UNITED = frozenset({"skills", "certifications", "languages"})


def with_fallback(primary: Column, fallback: Column, kind: StructType) -> Column:
    """A draft with its gaps filled from the deterministic one, field by field."""
    return nested.merge(primary, fallback, kind, unite=UNITED)


def report(primary: Column, fallback: Column, kind: StructType) -> Column:
    """The same for a report: dated records always come from the deterministic draft, prose from the written one."""
    return nested.merge(primary, fallback, kind, unite=UNITED, facts=FACTS)


def anonymised(briefing: Column, kind: StructType, names: Column) -> Column:
    """A whole draft without personal data, after all merging: the candidate's name is replaced, prose speaks of the candidate."""

    def leaf(value: Column, path: str) -> Column:
        return F.lit(V.ANONYMOUS) if path == "candidate.name" else F.when(value.isNotNull(), T.narrative(T.redact(value, names)))

    return nested.map_strings(briefing, kind, leaf)


def residual_warnings(briefing: Column, kind: StructType) -> Column:
    """Kinds of personal data that any string of a draft still holds."""
    text = F.array_join(nested.all_strings(briefing, kind), "\n")
    return F.array_compact(F.array(*[F.when(found, name) for name, found in T.residual(text).items()]))


def view_model(briefing: Column, language: Column) -> Column:
    """The keys of a report, flat: first rows of the record lists, joined lists, and counts. briefing: struct<candidate: struct<name, location>, role: struct<title, company>, fit_summary, education, employment, skills>."""
    first = lambda a, k: F.coalesce(F.get(briefing[a], F.lit(0))[k], F.lit(""))
    lines = lambda a, of: F.array_join(F.transform(briefing[a], of), "\n")
    between = F.when(language == "zh", " 至 ").otherwise(" - ")
    dates = lambda x: F.when((T.some(x["start"]) == "") | (T.some(x["end"]) == ""), F.concat(T.some(x["start"]), T.some(x["end"]))).otherwise(F.concat(x["start"], between, x["end"]))
    joined = lambda *c: F.concat_ws(", ", *[F.when(T.some(x) != "", x) for x in c])
    return F.struct(
        T.clean_line(briefing["candidate"]["name"]).alias("candidate_name"),
        T.clean_line(briefing["candidate"]["location"]).alias("candidate_location"),
        joined(briefing["role"]["title"], briefing["role"]["company"]).alias("role_line"),
        T.some(briefing["fit_summary"]).alias("fit_summary"),
        first("education", "degree").alias("degree_name"),
        first("education", "school").alias("institution_name"),
        lines("education", lambda x: F.concat_ws(" | ", joined(x["degree"], x["school"]), F.when(dates(x) != "", dates(x)))).alias("education_lines"),
        first("employment", "title").alias("current_title"),
        first("employment", "company").alias("current_company"),
        lines("employment", lambda x: F.concat_ws(" | ", joined(x["title"], x["company"]), F.when(dates(x) != "", dates(x)))).alias("employment_lines"),
        F.array_join(briefing["skills"], ", ").alias("skills_line"),
        F.size(briefing["employment"]).alias("n_employment"),
    )
