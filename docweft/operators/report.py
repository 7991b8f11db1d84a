"""Report templates and rendered reports: the tags a template needs, what they get, rendering, and what a rendered report must and mustn't say.

Templates and reports are texts, or Word files whose XML parts are read one by one. Rows are
templates or reports, so nothing is shuffled.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T
from ..functions import vocabulary as V

# The tags of reports.
TAGS = """candidate_name hiring_manager hiring_manager_name role_title employment_history employment_experience_entries fit_summary employment_experience relevant_experience match_requirements
match_requirement_entries match_requirement_text potential_concerns recommended_next_step candidate_summary key_summary candidate_english_name candidate_original_name candidate_gender candidate_date_of_birth
candidate_nationality candidate_location candidate_current_location candidate_preferred_location candidate_languages candidate_skills candidate_certifications candidate_language_1 candidate_language_2
notice_period education_entries education_summary degree_name field_of_study education_field_institution_line university institution_name start_year end_year education_start_year education_end_year
education_location education_date_location_line job_title company_name start_date end_date employment_start_date employment_end_date responsibilities responsibility_bullets responsibility responsibility_text
responsibility_original_text job_responsibility_1 job_responsibility_2 project_experience_entries project_name linked_job_title linked_company_name project_role_company_line project_start_date
project_end_date project_timeline_basis project_bullets project_bullet_text project_bullet_original_text original_authoritative_appendix generation_date generation_timestamp""".split()
# Older spellings of tags; lower case and "_" for blanks make them the tags above, but for the first.
OLD_SPELLINGS = [
    "Canddidate_Gender", "Candidate_Name", "Hiring Manager", "Candidate_Summary", "Candidate_nationality", "Candidate_Location", "Candidate_Preferred_Location", "Candidate_Languages",
    "Candidate_Language 1", "Candidate_Language 2", "Notice_Period", "Education_Summary", "Degree_Name", "University", "Start Year", "End_Year", "Job Title", "Company Name", "Start_date",
    "End_Date", "Job_responsibility_1", "Job_responsibility_2",
]
# Groups of tags of which a template needs one each, and pairs that leave a separator behind where one is blank.
NEEDED = [["candidate_name"], ["role_title"], ["candidate_summary", "fit_summary"], ["employment_history", "employment_experience", "employment_experience_entries", "relevant_experience"]]
SEPARATED = {("field_of_study", "institution_name"): "education field and institution", ("education_end_year", "education_location"): "education years and location", ("linked_job_title", "linked_company_name"): "project linked role and company"}
MAIN_PART = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
PAYLOAD_VERSION = "1.0"

_ALIASES = {s: s.lower().replace(" ", "_").replace("canddidate", "candidate") for s in OLD_SPELLINGS}
_TAG = r"\{\{\s*([^}]+?)\s*\}\}"


def logical(tag: Column) -> Column:
    """A tag without its loop mark, under the name that reports use."""
    plain = F.trim(F.regexp_replace(tag, "^[/#]", ""))
    names = F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(names, plain), plain)


def tags(template: Column) -> Column:
    """The distinct tags of a template's text, as they stand."""
    return F.array_distinct(F.transform(F.regexp_extract_all(T.some(template), F.lit(_TAG), 1), F.trim))


def supported(found: Column) -> Column:
    known = F.array(*map(F.lit, TAGS))
    return F.filter(found, lambda t: F.array_contains(known, logical(t)))


def missing_groups(template: Column) -> Column:
    """The groups of needed tags that a template has none of, each as "a or b"."""
    have = F.transform(supported(tags(template)), logical)
    return F.array_compact(F.array(*[F.when(~F.arrays_overlap(have, F.array(*map(F.lit, g))), " or ".join(g)) for g in NEEDED]))


def separators(template: Column) -> Column:
    """Labels of the pairs of optional tags that a template joins by a bar."""
    pairs = F.regexp_extract_all(T.some(template), F.lit(_TAG + r"\s*\|\s*\{\{\s*[^}]+?\s*\}\}"), 0)
    ends = F.transform(pairs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(_TAG), 1), logical))
    named = lambda e: F.coalesce(*[F.when((F.get(e, F.lit(0)) == a) & (F.get(e, F.lit(1)) == b), label) for (a, b), label in SEPARATED.items()])
    return F.array_compact(F.transform(ends, named))


def population(template: Column, values: Column) -> Column:
    """struct<populated, blank>: the supported tags of a template that get something, and those that don't. values: map<string,string>."""
    found = supported(tags(template))
    filled = lambda t: F.trim(F.coalesce(F.element_at(values, logical(t)), F.lit(""))) != ""
    return F.struct(F.filter(found, filled).alias("populated"), F.filter(found, lambda t: ~filled(t)).alias("blank"))


def rendered(template: Column, values: Column) -> Column:
    """Every tag replaced by its value, or by nothing; a bar that nothing is left of on one side goes with it."""
    parts = F.split(T.some(template), _TAG, -1)
    names = F.regexp_extract_all(T.some(template), F.lit(_TAG), 1)
    put = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.element_at(values, logical(F.get(names, i))), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.array_join(put, ""), r"(?m)^[ \t]*\|[ \t]*|[ \t]*\|[ \t]*$", ""), r"\|[ \t]*\|", "|")


def snippet(c: Column, most: int = 80) -> Column:
    return F.trim(F.substring(T.clean_line(c), 1, most))


def required_texts(data: Column) -> Column:
    """Groups of texts of which a report must hold one each. data: struct<candidate_name, role_title, candidate_summary, fit_summary, relevant_experience: string, employment: array<struct<title, company: string, duties: array<string>>>>."""
    some = lambda *xs: F.array_distinct(F.filter(F.array(*xs), lambda x: x != ""))
    none = F.array().cast("array<string>")
    duty = lambda e: F.coalesce(F.get(F.filter(F.coalesce(e["duties"], none), lambda d: T.clean_line(d) != ""), F.lit(0)), F.lit(""))
    jobs = F.flatten(F.transform(F.slice(F.coalesce(data["employment"], F.array()), 1, 2), lambda e: F.array(snippet(e["title"], 120), snippet(e["company"], 120), snippet(duty(e)))))
    work = F.array_distinct(F.filter(F.concat(F.array(snippet(data["relevant_experience"])), jobs), lambda x: x != ""))
    groups = F.array(some(snippet(data["candidate_name"], 120)), some(snippet(data["role_title"], 120)), some(snippet(data["candidate_summary"]), snippet(data["fit_summary"])), work)
    return F.filter(groups, lambda g: F.size(g) > 0)


def forbidden_texts(name: Column, *originals: Column) -> Column:
    """The real names that a report of an anonymous candidate mustn't hold."""
    anonymous = lambda c: F.lower(T.clean_line(c)) == V.ANONYMOUS.lower()
    real = F.filter(F.array(*map(T.clean_line, originals)), lambda x: (x != "") & ~anonymous(x))
    return F.when(anonymous(name), real).otherwise(F.array().cast("array<string>"))


def report_faults(report: Column, required: Column, forbidden: Column) -> Column:
    """What is wrong with a rendered report's text: tags left, needed texts missing, forbidden ones there, separators side by side."""
    plain = F.lower(T.clean_line(report))
    held = lambda s: plain.contains(F.lower(snippet(s, 120)))
    kind = lambda code, xs: F.transform(xs, lambda x: F.concat(F.lit(code + ": "), x))
    missing = F.transform(F.filter(required, lambda g: ~F.exists(g, held)), lambda g: F.array_join(g, " or "))
    bars = F.when(plain.rlike(r"\|\s*\|"), F.array(F.lit("separator: ||"))).otherwise(F.array().cast("array<string>"))
    return F.concat(kind("tag", tags(report)), kind("missing", missing), kind("forbidden", F.filter(forbidden, lambda s: (snippet(s, 120) != "") & held(s))), bars)


def payload(adapter: Column, data: Column, review: Column) -> Column:
    """The versioned payload of a report; null without a compatible adapter. adapter: struct<id, version, template: string, compatible: boolean>."""
    body = F.struct(adapter["id"].alias("adapter_id"), adapter["version"].alias("adapter_version"), F.lit(PAYLOAD_VERSION).alias("payload_version"), adapter["template"].alias("template"), review.alias("review"), required_texts(data).alias("required"), forbidden_texts(data["candidate_name"], data["candidate_original_name"], data["candidate_english_name"]).alias("forbidden"))
    return F.when(F.coalesce(adapter["compatible"], F.lit(False)), body)


# --- Word files


def _parts(z: zipfile.ZipFile) -> list[str]:
    return [n for n in z.namelist() if re.fullmatch(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes)\.xml", n)]


def _paragraph_text(xml: str) -> str:
    return unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", xml)), {"&quot;": '"', "&apos;": "'"})


def word_text(data: bytes) -> str:
    """The text of all parts of a Word file, a line for each paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = [z.read(n).decode("utf-8") for n in _parts(z)]
    return "\n".join(_paragraph_text(p) for x in xml for p in re.findall(r"<w:p[ >].*?</w:p>", x, re.S))


def fill_word(data: bytes, values: dict[str, str]) -> bytes:
    """A Word template with its tags filled. A tag that is broken over runs is put together in the run where it begins; templates (.dotx) become documents."""
    names = _ALIASES
    value = lambda t: values.get(names.get(t := t.strip().lstrip("/#").strip(), t)) or ""

    def paragraph(m: re.Match) -> str:
        runs = list(re.finditer(r"(<w:t(?: [^>]*)?>)([^<]*)(</w:t>)", m[0]))
        texts = [unescape(r[2]) for r in runs]
        whole, bounds = "".join(texts), [0]
        for t in texts:
            bounds.append(bounds[-1] + len(t))
        found = list(re.finditer(_TAG, whole))
        if not found:
            return m[0]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            piece, at = "", a
            for t in found:
                if t.start() < b and t.end() > at:
                    piece += whole[at : max(at, t.start())] + (value(t[1]) if a <= t.start() else "")
                    at = min(b, t.end())
            out.append(piece + whole[at:b])
        done, last = "", 0
        for r, text in zip(runs, out, strict=True):
            lines = "</w:t><w:br/><w:t xml:space=\"preserve\">".join(escape(x) for x in text.split("\n"))
            done += m[0][last : r.start()] + '<w:t xml:space="preserve">' + lines + "</w:t>"
            last = r.end()
        return done + m[0][last:]

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        parts = set(_parts(z))
        for n in z.namelist():
            body = z.read(n)
            if n in parts:
                body = re.sub(r"<w:p[ >].*?</w:p>", paragraph, body.decode("utf-8"), flags=re.S).encode()
            elif n == "[Content_Types].xml":
                body = body.replace(b"wordprocessingml.template.main+xml", b"wordprocessingml.document.main+xml")
            to.writestr(zipfile.ZipInfo(n), body)
    return out.getvalue()


def word_faults(data: bytes) -> list[str]:
    """What a written Word file lacks."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            types = z.read("[Content_Types].xml").decode() if "[Content_Types].xml" in names else ""
    except zipfile.BadZipFile:
        return ["no Word package"]
    checks = [(bool(types), "[Content_Types].xml is missing"), (MAIN_PART in types, "the main part is no document"), ("word/document.xml" in names, "word/document.xml is missing")]
    return [told for fits, told in checks if not fits]


def word_reports(df: DataFrame, template: str = "template", values: str = "values") -> DataFrame:
    """Adds ``document``, the filled template, and ``text``, what it says; templates are the bytes of Word files."""

    @F.pandas_udf("document binary, text string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for templates, maps in batches:
            out = [fill_word(bytes(t), dict(m or {})) for t, m in zip(templates, maps, strict=True)]
            yield pd.DataFrame({"document": out, "text": [word_text(d) for d in out]})

    return df.withColumn("made", made(template, values)).select("*", "made.document", "made.text").drop("made")


def output_name(path: Column) -> Column:
    """A report's path with .docx as its only extension."""
    plain = F.trim(T.some(path))
    return F.when(plain.rlike(r"(?i)\.docx$"), plain).otherwise(F.concat(F.regexp_replace(plain, r"(?i)\.(?:docx?|dotx?|pdf|txt|md)$", ""), F.lit(".docx")))


def fields(kind: StructType, prefix: str = "") -> list[str]:
    """The scalar fields of a draft's type, by path."""
    out = []
    for f in kind.fields:
        if isinstance(f.dataType, StructType):
            out += fields(f.dataType, f"{prefix}{f.name}.")
        elif not isinstance(f.dataType, ArrayType):
            out.append(prefix + f.name)
    return out
