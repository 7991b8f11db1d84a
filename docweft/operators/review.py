"""Validation issues, review decisions, states and export gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_line
from . import relational as R

# Codes of issues, their severity and section.
ISSUES = [
    ("candidate_name_missing_or_generic", "red", "identity"), ("candidate_name_embedded_metadata", "red", "identity"), ("candidate_name_heading_or_table_header", "red", "identity"),
    ("candidate_name_embedded_role_or_banner", "red", "identity"), ("role_title_missing_or_generic", "red", "role"), ("education_entry_malformed", "red", "education"),
    ("employment_entry_missing_core_fields", "red", "employment"), ("employment_chronology_invalid", "red", "employment"), ("project_name_suspicious", "red", "projects"),
    ("project_role_ambiguous", "amber", "projects"), ("jd_requirements_missing", "red", "requirements"),
]
# Titles of issues and what to do about them, by code.
PRESENTATION = {
    "candidate_name_missing_or_generic": ("Candidate name needs review", "Verify the candidate name in the loaded CV before approval or export."),
    "candidate_name_embedded_metadata": ("Candidate name contains profile metadata", "Review the candidate identity line and remove demographic, contact, or profile details from the name field."),
    "candidate_name_heading_or_table_header": ("Candidate name looks like extracted content", "Review the candidate identity line and replace section-heading, table-row, or narrative text with the actual person name."),
    "candidate_name_embedded_role_or_banner": ("Candidate name contains role or banner text", "Review the candidate identity line and keep only the person name, not the recruiter banner or role label."),
    "role_title_missing_or_generic": ("Role title needs review", "Verify the target role title in the loaded JD before approval or export."),
    "education_entry_malformed": ("Education entry is incomplete", "Review the flagged education row and confirm the degree and institution details."),
    "employment_entry_missing_core_fields": ("Employment row is incomplete", "Review the flagged employment row and restore the missing role or company details."),
    "employment_chronology_invalid": ("Employment chronology is invalid", "Review the flagged employment dates and correct the chronology before sharing."),
    "project_name_suspicious": ("Project title looks unreliable", "Review the flagged project title and remove section spillover or sentence fragments."),
    "project_role_ambiguous": ("Project-role linkage is ambiguous", "Review the flagged project against the competing employment rows and confirm the correct linkage."),
    "jd_requirements_missing": ("JD requirements are missing", "Review the loaded JD and confirm the key requirements were extracted correctly."),
    "word_report_candidate_name_generic": ("Word candidate name looks generic", "Review the candidate identity fields before export. The current Word payload does not look reliable."),
    "word_report_role_title_generic": ("Word role title looks generic", "Review the role title fields before export. The current Word payload does not look reliable."),
    "word_report_education_overflow": ("Word education section looks over-expanded", "Review the education extraction before export. Too many education rows were produced."),
    "word_report_employment_history_missing": ("Word employment history is missing", "Review the employment extraction before export. The current Word payload is missing employment history."),
}
# The same for groups of codes, by what they begin with, and for all others.
PRESENTATION_OF_GROUPS = [
    ("word_report_education_entry_", "Word education entry needs review", "Review the flagged education row in the report payload before export."),
    ("word_report_employment_", "Word employment entry needs review", "Review the flagged employment row in the report payload before export."),
    ("word_report_project_experience_", "Word project section needs review", "Review the project extraction before export. The current Word payload is not reliable yet."),
    ("", "Review required", "Review the flagged section before approval or export."),
]
SECTION_NAMES = {"identity": "Candidate Identity", "role": "Role", "education": "Education", "employment": "Employment History", "projects": "Project Experiences", "requirements": "JD Requirements"}


def severity(c: Column) -> Column:
    return F.when(clean_line(c) == "amber", "amber").otherwise("red")


def section_label(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SECTION_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, clean_line(c)), F.lit("General"))


def decision_type(c: Column) -> Column:
    """One of the two decisions, else ''."""
    x = clean_line(c)
    return F.when(x.isin("keep-project-unlinked", "mark-reviewed"), x).otherwise("")


def allowed(issue_severity: Column, code: Column, decision: Column) -> Column:
    """Amber issues can be marked as reviewed; ambiguous links can also be kept as they are."""
    ambiguous = clean_line(code) == "project_role_ambiguous"
    return (clean_line(issue_severity) == "amber") & ((decision_type(decision) == "mark-reviewed") | (ambiguous & (decision_type(decision) == "keep-project-unlinked")))


def issue_key(df: DataFrame) -> Column:
    """The parts that tell issues apart, joined by ::; columns that df lacks count as ''."""
    parts = ["source", "code", "section", "entry_index", "project_name", "project_start", "project_end", "source_path", "block_id", "field_path", "value"]
    return F.concat_ws("::", *[clean_line(F.col(p).cast("string")) if p in df.columns else F.lit("") for p in parts])


def normal_decisions(decisions: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """The first valid decision of each issue."""
    valid = decisions.withColumn("issue_key", clean_line(F.col("issue_key"))).withColumn("decision_type", decision_type(F.col("decision_type"))).filter("issue_key <> '' and decision_type <> ''")
    return R.keep_first(valid, ["issue_key"], order, scope)


def applied(issues: DataFrame, decisions: DataFrame, scope: list[str]) -> DataFrame:
    """Issues with the decision that applies to each (null if none) and the posture that follows."""
    d = decisions.select(*scope, "issue_key", F.col("decision_type").alias("decision"))
    joined = issues.join(d, [*scope, "issue_key"], "left")
    fits = F.coalesce(allowed(F.col("severity"), F.col("code"), F.col("decision")), F.lit(False))
    joined = joined.withColumn("decision", F.when(fits, F.col("decision")))
    posture = F.when(F.col("decision").isNotNull(), "allowed").when(severity(F.col("severity")) == "red", "blocked").otherwise("review-required")
    return joined.withColumn("posture", posture)


def review_state(resolved: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope: state from severities, posture from what is left to do, and counts."""
    count = lambda p: F.sum((F.col("posture") == p).cast("bigint"))
    red, amber = (F.max((severity(F.col("severity")) == s).cast("int")) for s in ("red", "amber"))
    out = resolved.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_issues"), count("blocked").alias("n_blocked"), count("review-required").alias("n_review"), count("allowed").alias("n_allowed"), red.alias("red"), amber.alias("amber"),
        F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"),
    )
    state = F.when(F.col("red") == 1, "red").when(F.col("amber") == 1, "amber").otherwise("green")
    posture = F.when(F.col("n_blocked") > 0, "blocked").when(F.col("n_review") > 0, "review-required").otherwise("allowed")
    return out.select(*scope, state.alias("state"), posture.alias("posture"), "n_issues", "n_blocked", "n_review", "n_allowed", "sections")


def gate(states: DataFrame) -> DataFrame:
    """What may be exported."""
    return states.filter(F.col("posture") == "allowed")


def over_expanded(n_projects: Column, n_suspicious: Column) -> tuple[Column, Column]:
    """(over-expanded, unreliable) for the projects of a report."""
    return (n_projects > 12) & (n_suspicious >= F.greatest(F.lit(2), F.ceil(n_projects * 0.2))), (n_suspicious >= 3) & (n_suspicious >= F.ceil(n_projects * 0.4))


def presented(issues: DataFrame) -> DataFrame:
    """Adds title and action of each issue's code, and its section's label."""
    known = issues.sparkSession.createDataFrame([(c, *t) for c, t in PRESENTATION.items()], "code string, own_title string, own_action string")
    code = clean_line(F.col("code"))
    other = [F.when(code.startswith(p), F.struct(F.lit(t).alias("title"), F.lit(a).alias("action"))) for p, t, a in PRESENTATION_OF_GROUPS]
    joined = issues.withColumn("code", code).join(F.broadcast(known), "code", "left").withColumn("other", F.coalesce(*other))  # a fixed list
    return joined.select(*[F.col(f"`{c}`") for c in issues.columns], F.coalesce("own_title", "other.title").alias("title"), F.coalesce("own_action", "other.action").alias("action"), section_label(F.col("section")).alias("section_label"))
