"""Lookups and choices between files, blocks, drafts and workspaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import values as X
from . import checks
from . import records as C
from . import relational as R

# What names of files say, and how much it counts.
JD_NAME, CV_NAME = r"(?i)(?<![A-Za-z0-9_])(?:jd|job description|job)(?![A-Za-z0-9_])", r"(?i)(?<![A-Za-z0-9_])(?:cv|resume|candidate)(?![A-Za-z0-9_])"
JOB_WORDS = r"(?i)(?<![A-Za-z0-9_])(?:job|description)(?![A-Za-z0-9_])"
# What the blocks of a section show.
DATED = r"(?i)(?:19|20)\d{2}.*(?:19|20)\d{2}|(?:19|20)\d{2}.*(?:present|current|now|至今|现在)"
PROFILE_HEAD = "(?i)^(?:candidate summary|summary|personal information|个人信息|基本信息)$"
PROFILE = r"(?i)\b(?:candidate summary|name|gender|nationality|current residence|year of birth|marital status|language|education|certificate|motivation|availability)\b[:：]?"
SCHOOLING = r"(?i)\b(?:bachelor|master|phd|degree|diploma|university|college|school|institute)\b|本科|硕士|博士|学士|大学|学院|学校|研究院|教育背景"
WORK = r"(?i)\b(?:engineer|developer|manager|lead|director|architect|consultant|analyst|specialist|officer|president|vice president|vp)\b|工程师|开发|经理|总监|负责人|架构师|顾问|分析师|研究员"
DID = r"(?i)^(?:fully|led|built|designed|developed|implemented|optimized|supported|worked|collaborated|responsible)\b|^(?:负责|参与|实现|优化|支持|搭建|构建)"
CONTACT = r"@|https?://|linkedin|^\+?[\d()\s-]{7,}$"
DUTY = r"(?i)^(?:[-*•–—]|l(?=\s))\s*"
_YEARS = r"(?:19|20)\d{2}(?:[./-]\d{1,2})?"
RANGE = rf"(?i)({_YEARS})\s*(?:–|-|—|~|to|至)\s*(present|current|now|至今|目前|现在|{_YEARS})"
OPEN = rf"(?i)^({_YEARS})\s*(?:–|-|—|~)\s*$"


def extractable(text: Column) -> Column:
    """Whether a block of an experience section tells of jobs: no profile with schooling alone, and no undated narrative."""
    lines = T.non_empty_lines(text)
    head, first = F.array_join(F.slice(lines, 1, 12), " "), F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    profile = (first.rlike(PROFILE_HEAD) | head.rlike(PROFILE)) & head.rlike(SCHOOLING) & ~head.rlike(WORK)
    narrative = ~F.exists(lines, lambda x: x.rlike(DATED)) & first.rlike(DID)
    return (F.size(lines) > 0) & ~profile & ~narrative


def contact_line(c: Column) -> Column:
    return T.some(c).rlike(CONTACT)


def duty_line(c: Column) -> Column:
    """A bullet; a lone "l" is one that was read wrongly."""
    return F.trim(T.some(c)).rlike(DUTY)


def subheading(c: Column) -> Column:
    """A short line in title case inside a section: no known heading, bullet, date, role or company."""
    x = F.regexp_replace(F.trim(T.some(c)), r":\s*$", "")
    other = C.generic_section(x) | duty_line(x) | x.rlike(C.DATES) | x.rlike(C.ROLE) | x.rlike(C.COMPANY)
    return ~other & (F.char_length(x) <= 64) & x.rlike(r"^[A-Z][A-Za-z0-9/&(),'\- ]+$") & ~x.rlike("[.?!]$")


def jd_score(name: Column, extension: Column, n_files: Column, n_docx: Column) -> Column:
    """How much a file looks like a job description among ``n_files`` of which ``n_docx`` are Word files."""
    points = [(name.rlike(JD_NAME), 8), (name.rlike(JOB_WORDS), 3), (extension == ".docx", 2), ((extension == ".docx") & (n_docx == 1) & (n_files > 1), 2)]
    return reduce(lambda a, b: a + b, [F.when(fits, n).otherwise(0) for fits, n in points])


def cv_score(name: Column, extension: Column) -> Column:
    return F.when(name.rlike(CV_NAME), 8).otherwise(0) + F.when(extension == ".pdf", 2).otherwise(0)


def file_roles(files: DataFrame, scope: list[str]) -> DataFrame:
    """files: scope, name, extension -> with jd_score and cv_score; a folder's counts come from a window over it."""
    w = R.Window.partitionBy(*scope)
    n, docx = F.count(F.lit(1)).over(w), F.sum((F.col("extension") == ".docx").cast("int")).over(w)
    every, word = R.fresh(files, "every", "word")
    counted = files.withColumn(every, n).withColumn(word, docx)
    return counted.select("*", jd_score(F.col("name"), F.col("extension"), F.col(every), F.col(word)).alias("jd_score"), cv_score(F.col("name"), F.col("extension")).alias("cv_score")).drop(every, word)


def other_files(files: DataFrame, selected: DataFrame, scope: list[str]) -> DataFrame:
    """The files of a folder that are not its selected job description (scope, path)."""
    return files.join(selected.select(*scope, "path"), [*scope, "path"], "left_anti")


def stale(loaded: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """Loaded documents (scope, path) whose files are gone."""
    return loaded.join(files.select(*scope, "path").distinct(), [*scope, "path"], "left_anti")


def recent_match(stored: DataFrame, selection: DataFrame) -> DataFrame:
    """For each selection (id, folder, jd_path, cv_path) the newest workspace with a draft of the same three paths; null without one."""
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(T.some(F.col(x))), F.lit("")) for x in c])
    have = stored.filter(F.trim(T.some(F.col("summary"))) != "").select(first("folder").alias("f"), first("loaded_jd_path", "jd_path").alias("j"), first("loaded_cv_path", "cv_path").alias("c"), "workspace_id", "updated_at")
    newest = R.keep_first(have.dropna(subset=["f", "j", "c"]), ["f", "j", "c"], [F.col("updated_at").desc(), F.col("workspace_id")])
    wanted = selection.select("id", first("folder").alias("f"), first("jd_path").alias("j"), first("cv_path").alias("c"))
    return wanted.join(newest, ["f", "j", "c"], "left").select("id", "workspace_id")


def touched(stored: DataFrame, key: str, wanted: str, at: str, now: Column) -> DataFrame:
    """The stored rows with the wanted one's time set to ``now``; a missing key raises when the rows are computed."""
    found = F.max((F.col(key) == wanted).cast("int")).over(R.Window.partitionBy(F.lit(0)))
    checked = F.when(found == 1, F.col(at)).otherwise(F.raise_error(F.lit(f"no workspace {wanted}")).cast("string"))
    # a store has a dozen rows, so that one window is one small task
    return stored.withColumn(at, F.when(F.col(key) == wanted, now).otherwise(checked))


def first_block(refs: DataFrame, blocks: DataFrame, scope: list[str]) -> DataFrame:
    """refs: scope, ord, block_ids array<string>; blocks: scope, block_id, text -> scope, ord and the text of the first reference that resolves, null if none does."""
    each = refs.select(*scope, "ord", F.posexplode("block_ids").alias("place", "block_id")).join(blocks, [*scope, "block_id"])
    hit = each.groupBy(*scope, "ord").agg(F.min_by("text", "place").alias("text"))
    return refs.join(hit, [*scope, "ord"], "left").select(*scope, "ord", "text")


def chosen_requirements(of_section: Column, of_fallback: Column) -> Column:
    """struct<rows, source>."""
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    return F.struct(F.when(n(of_section) > 0, of_section).otherwise(of_fallback).alias("rows"), F.when(n(of_section) > 0, "section").when(n(of_fallback) > 0, "fallback").otherwise("none").alias("source"))


def label_value(lines: Column, labels: list[str]) -> Column:
    """The value of the first line with a label: what follows it, or the next line where the label stands alone."""
    pattern = r"(?i)^(?:" + "|".join(labels) + r")\s*[:：]?\s*([^\s:：].*)$"
    alone = F.array(*[F.lit(x.lower()) for x in labels])
    told = F.transform(lines, lambda x, i: F.when(x.rlike(pattern), F.trim(F.regexp_extract(x, pattern, 1))).when(F.array_contains(alone, T.heading_key(x)), F.trim(F.get(lines, i + 1))))
    return F.coalesce(F.get(F.filter(told, lambda v: v != ""), F.lit(0)), F.lit(""))


def dates_first(c: Column) -> Column:
    """struct<start, end, rest> of a line that begins with a range of dates, or is one without an end; null for others."""
    x = T.clean_line(c)
    at_start = x.rlike("^" + RANGE.replace("(?i)", "(?i:") + ")")
    rest = F.trim(F.regexp_replace(F.regexp_replace(x, "^(?:" + RANGE + ")", ""), r"^\s*[|,/-]\s*", ""))
    return F.when(at_start, F.struct(F.regexp_extract(x, RANGE, 1).alias("start"), F.regexp_extract(x, RANGE, 2).alias("end"), rest.alias("rest"))).when(x.rlike(OPEN), F.struct(F.regexp_extract(x, OPEN, 1).alias("start"), F.lit("Present").alias("end"), F.lit("").alias("rest")))


def dates_last(c: Column) -> Column:
    """struct<start, end, rest> of a line in which something stands before a range of dates; null for others."""
    x = T.clean_line(c)
    whole = "^(.+?)" + RANGE.replace("(?i)", "")
    rest = F.trim(F.regexp_replace(F.regexp_extract(x, "(?i)" + whole, 1), r"[|,/-]\s*$", ""))
    return F.when((rest != "") & ~x.rlike("(?i)^" + RANGE.replace("(?i)", "")), F.struct(F.regexp_extract(x, RANGE, 1).alias("start"), F.regexp_extract(x, RANGE, 2).alias("end"), rest.alias("rest")))


def overridden(draft: Column, sections: Column, kind: StructType) -> Column:
    """A draft with what an edited summary says in its place. Fields: name, title, fit_summary, next_step: string, experience, concerns: array<string>, matches: array<struct<requirement, evidence>>."""
    told = lambda k: T.some(F.element_at(sections, k))
    text = lambda k, field: F.when(F.trim(told(k)) != "", told(k)).otherwise(draft[field]).alias(field)
    listed = lambda k, field: F.when(F.size(checks.strings(told(k))) > 0, checks.strings(told(k))).otherwise(draft[field]).alias(field)
    pairs = checks.match_pairs(told("match_requirements"))
    made = {
        "name": text("candidate", "name"), "title": text("target_role", "title"), "fit_summary": text("fit_summary", "fit_summary"), "next_step": text("recommended_next_step", "next_step"),
        "experience": listed("relevant_experience", "experience"), "concerns": listed("potential_concerns", "concerns"), "matches": F.when(F.size(pairs) > 0, pairs).otherwise(draft["matches"]).alias("matches"),
    }
    return F.struct(*[made.get(f.name, draft[f.name].alias(f.name)) for f in kind])


PROFILE_FIELDS = ["candidate_name", "role_title", "candidate_location", "candidate_preferred_location", "candidate_nationality", "notice_period", "job_title", "company_name"]


def derived_profile(profile: Column) -> Column:
    """The nine fields that a workspace shows of a profile, trimmed; languages without blanks."""
    listed = F.filter(F.coalesce(profile["candidate_languages"], F.array().cast("array<string>")), lambda x: T.some(x) != "")
    return F.struct(*[F.trim(T.some(profile[c])).alias(c) for c in PROFILE_FIELDS], listed.alias("candidate_languages"))


def legacy_education(rows: Column, profile: Column) -> Column:
    """Education rows under the names that reports use; without rows, one of the profile's own fields."""
    named = lambda d, s, a, b: F.struct(d.alias("degree_name"), s.alias("university"), a.alias("start_year"), b.alias("end_year"))
    own = F.array(named(*[profile[c] for c in ("degree", "school", "start", "end")]))
    return F.when(F.greatest(F.size(rows), F.lit(0)) > 0, F.transform(rows, lambda r: named(r["degree"], r["school"], r["start"], r["end"]))).otherwise(own)


def in_order(df: DataFrame, scope: list[str], sequence: Column) -> DataFrame:
    """Events that are not older than one already seen: of answers that overtake each other the later request's stays."""
    before = F.max(sequence).over(R.Window.partitionBy(*scope).orderBy("seen_at", sequence).rowsBetween(R.Window.unboundedPreceding, -1))
    (last,) = R.fresh(df, "last")
    return df.withColumn(last, before).filter(F.col(last).isNull() | (sequence >= F.col(last))).drop(last)


def cache_key(*parts: Column) -> Column:
    """The key of a cached result: a hash of what it was made of."""
    return F.sha2(F.concat_ws("\u001f", *[T.some(p.cast("string")) for p in parts]), 256)


def cached(requests: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached results, requests that have to be computed); both tables have a column ``key``."""
    have = R.keep_first(results, ["key"], [F.col("made_at").desc()])
    return requests.join(have, "key"), requests.join(have.select("key"), "key", "left_anti")


def year_key(c: Column) -> Column:
    return F.coalesce(X.year_of(c), F.lit(0))


# Places that stand alone on a line.
PLACES = [
    "beijing", "china", "dubai", "france", "germany", "hong kong", "india", "japan", "london", "new york", "paris", "san francisco", "shanghai", "shenzhen", "singapore", "sydney", "tokyo",
    "united arab emirates", "united kingdom", "united states", "北京", "上海", "深圳", "香港", "新加坡", "中国",
]


def company_line(c: Column) -> Column:
    """A line that names a company, or an acronym of one."""
    x = F.trim(T.some(c))
    return (x != "") & (x.rlike(C.COMPANY) | (~x.rlike(C.ROLE) & x.rlike(r"^[A-Z][A-Z0-9&.-]{1,11}$")))


def location_line(c: Column) -> Column:
    """A known place, a CJK name of one, or up to five words of names with commas between."""
    x = F.trim(T.some(c))
    part = r"[A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*)*"
    named = F.lower(x).isin(PLACES) | x.rlike("^[一-鿿]{1,7}(?:市|省|区|县|国)$|^[一-鿿]{2,3}特别行政区$")
    return ~x.rlike(r"\d") & (named | (x.rlike(rf"^{part}(?:\s*,\s*{part})+$") & (F.size(F.split(x, r"\s+")) <= 5) & ~x.rlike(C.ROLE)))
