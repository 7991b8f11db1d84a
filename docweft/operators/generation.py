"""A draft from a CV and a job description, as two steps around a model: what is asked, and what is made of the replies.

``requested()`` reads pairs of documents, retrieves the blocks that go into the request, finds the facts that need no model
(names, requirements with their best evidence, dated records) and writes the requests. ``drafted()`` takes
the replies, which may be broken, empty or missing: a briefing that is no JSON is replaced by its repair, and
that by the draft of facts; gaps are filled from the latter. What is missing from a summary comes from the briefing.

Columns of pairs: pair_id, cv_text, cv_file, jd_text, jd_file, mode (named or anonymous). A null text counts as empty.
Evidence is looked for inside a pair's own CV, in its row; nothing is paired over documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import briefing as B
from . import checks, identity, requests, retrieval, scanners, sections

#: A draft, and the shape that a reply has to have.
DRAFT = (
    "candidate struct<name:string,skills:array<string>>, role struct<title:string>, fit_summary string, relevant_experience array<string>, "
    "match_requirements array<struct<requirement:string,evidence:string>>, recommended_next_step string, employment_history array<struct<title:string,company:string,start:string,end:string>>"
)
SHAPE = '{"candidate": {"name": "", "skills": []}, "role": {"title": ""}, "fit_summary": "", "relevant_experience": [], "match_requirements": [{"requirement": "", "evidence": ""}], "recommended_next_step": "", "employment_history": [{"title": "", "company": "", "start": "", "end": ""}]}'
#: Sections of a summary: title, and the draft's field that stands in for a missing one.
SECTIONS = [("fit_summary", "Fit Summary"), ("relevant_experience", "Relevant Experience"), ("match_requirements", "Match Against Key Requirements"), ("recommended_next_step", "Recommended Next Step")]
EVIDENCE = 0.18


def _chosen(blocks: DataFrame, asked: DataFrame, kind: str, preferred: list[str], name: str) -> DataFrame:
    """doc_id, the blocks of each document that go into its request, in order."""
    found = retrieval.select_blocks(blocks.join(asked, "doc_id"), F.col("asked"), F.col("section_key").isin(preferred), F.lit(kind))
    one = F.struct("order", "block_id", "section_label", "text")
    shown = F.transform(F.array_sort(F.collect_list(one)), lambda b: F.struct(b["block_id"].alias("block_id"), b["section_label"].alias("section_label"), b["text"].alias("text")))
    return found.groupBy("doc_id").agg(shown.alias(name))


def _matches(jd: DataFrame, cv: DataFrame, roles: DataFrame) -> DataFrame:
    """doc_id and, for each requirement in order, the sentence of the CV that holds most of it."""
    lines = sections.preferred_lines(jd, ["requirements"], ["responsibilities"]).join(roles, "doc_id").select("doc_id", "role_title", F.posexplode("lines").alias("ord", "requirement"))
    sentences = cv.select("doc_id", F.transform(T.sentences(F.col("cv_text")), lambda s: F.struct(s.alias("s"), T.distinct_tokens(s).alias("ts"))).alias("said"))
    wanted = B.requirements(lines, ["doc_id"]).join(sentences, "doc_id", "left").withColumn("qs", T.distinct_tokens(F.col("requirement")))
    scored = F.transform("said", lambda x, i: F.struct((F.size(F.array_intersect(x["ts"], F.col("qs"))) / F.greatest(F.size("qs"), F.lit(1))).alias("score"), (-i).alias("place"), x["s"].alias("s")))
    best = wanted.select("doc_id", F.col("ord").alias("place"), "requirement", F.array_max(scored).alias("best"))
    good = F.coalesce(F.col("best.score"), F.lit(0.0)) >= EVIDENCE
    return best.select("doc_id", "place", "requirement", F.when(good, F.col("best.s")).otherwise("").alias("evidence"), F.when(good, F.col("best.score")).otherwise(0.0).alias("score"))


def requested(pairs: DataFrame, guidance: str = "", system: str = "You write factual summaries of candidates for recruiters.") -> DataFrame:
    """One row per pair: name, role, mode, matches, counts of retrieved blocks, the two requests, and the draft of facts."""
    p = pairs.select(F.col("pair_id").alias("doc_id"), *[T.some(F.col(c)).alias(c) for c in ("cv_text", "cv_file", "jd_text", "jd_file")], checks.output_mode(F.col("mode")).alias("mode"))
    named = p.select("*", identity.candidate_name(F.col("cv_text"), F.col("cv_file")).alias("name"), identity.role_title(F.col("jd_text"), F.col("jd_file")).alias("role_title"))
    cv, jd = (sections.blocks(p.select("doc_id", F.lit(kind).alias("kind"), F.col(f"{kind}_text").alias("text"))) for kind in ("cv", "jd"))
    tokens = lambda c: p.select("doc_id", T.distinct_tokens(F.col(c)).alias("asked"))
    of_cv = _chosen(cv, tokens("jd_text"), "cv", ["experience", "projects", "skills"], "cv_blocks")
    of_jd = _chosen(jd, tokens("cv_text"), "jd", ["requirements", "responsibilities"], "jd_blocks")
    matches = _matches(jd, p.select("doc_id", "cv_text"), named.select("doc_id", "role_title"))
    pairs_of = matches.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "requirement", "evidence"))), lambda m: F.struct(m["requirement"].alias("requirement"), m["evidence"].alias("evidence"))).alias("matches"))
    jobs = scanners.scan(sections.preferred_lines(cv, ["experience"], ["projects"]), "employment")
    jobs = jobs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "company", "start", "end"))), lambda j: F.struct(*[j[c].alias(c) for c in ("title", "company", "start", "end")])).alias("jobs"))
    out = named
    for other in (of_cv, of_jd, pairs_of, B.fit(matches, ["doc_id"]), jobs):
        out = out.join(other, "doc_id", "left")
    none = F.array().cast("array<string>")
    no_blocks, no_matches, no_jobs = (F.array().cast(f"array<struct<{', '.join(f'{c}:string' for c in cs)}>>") for cs in (("block_id", "section_label", "text"), ("requirement", "evidence"), ("title", "company", "start", "end")))
    out = out.select("*", F.coalesce("cv_blocks", no_blocks).alias("cv_shown"), F.coalesce("jd_blocks", no_blocks).alias("jd_shown"), F.coalesce("matches", no_matches).alias("pairs_shown"))
    prompt = requests.summary_prompt(F.col("name"), F.col("role_title"), requests.source_context(F.col("cv_shown")), requests.source_context(F.col("jd_shown")), F.lit(guidance), F.col("pairs_shown"), F.col("mode"))
    strengths = F.coalesce("strengths", none)
    told = F.when(F.size(strengths) > 0, F.concat(F.lit("The CV shows: "), F.array_join(strengths, "; "), F.lit("."))).otherwise("The CV gives little direct evidence for the requirements.")
    facts = F.struct(
        F.struct(F.col("name").alias("name"), none.alias("skills")).alias("candidate"), F.struct(F.col("role_title").alias("title")).alias("role"), told.alias("fit_summary"), F.coalesce("experience", none).alias("relevant_experience"),
        F.col("pairs_shown").alias("match_requirements"), F.coalesce("next_step", F.lit(B.NEXT_STEP[2])).alias("recommended_next_step"), F.coalesce("jobs", no_jobs).alias("employment_history"),
    )
    return out.select(
        F.col("doc_id").alias("pair_id"), "mode", "cv_file", "name", F.col("role_title").alias("role"), F.size("cv_shown").alias("n_cv"), F.size("jd_shown").alias("n_jd"),
        requests.messages(F.lit(system), prompt).alias("summary_request"), requests.messages(F.lit(system), requests.briefing_prompt(prompt, SHAPE)).alias("briefing_request"), facts.alias("facts"),
    )


def repairs(wanted: DataFrame, replies: DataFrame) -> DataFrame:
    """pair_id and the request for a repair, of the replies whose briefing is no JSON of the wanted shape."""
    broken = replies.filter(_read("briefing").isNull())
    ask = requests.repair_prompt(F.col("briefing"), F.lit("it can't be parsed"), SHAPE)
    return wanted.select("pair_id").join(broken, "pair_id").select("pair_id", requests.messages(F.lit("You correct JSON."), ask).alias("repair_request"))


def _read(column: str):
    """The draft in a reply; null where there is none."""
    draft = F.from_json(requests.reply_json(F.col(column)), DRAFT, {"mode": "PERMISSIVE"})
    return F.when(draft["candidate"].isNotNull() | draft["role"].isNotNull() | (T.some(draft["fit_summary"]) != ""), draft)


def drafted(wanted: DataFrame, replies: DataFrame) -> DataFrame:
    """One row per pair: summary, briefing, where it is from (reply, repair or facts), errors, warnings and kinds of personal data left.

    Columns of replies: pair_id, summary, briefing, repair. Pairs without a reply get a draft of facts alone.
    """
    kind = wanted.schema["facts"].dataType
    tidy = F.pandas_udf(lambda s: s.map(B.tidy_summary), "string")
    d = wanted.join(replies.select("pair_id", tidy(T.some(F.col("summary"))).alias("written"), _read("briefing").alias("own"), _read("repair").alias("mended")), "pair_id", "left")
    d = d.withColumn("origin", F.when(F.col("own").isNotNull(), "reply").when(F.col("mended").isNotNull(), "repair").otherwise("facts"))
    d = d.withColumn("draft", B.with_fallback(F.coalesce("own", "mended", F.col("facts")), F.col("facts"), kind)).withColumn("written", T.some(F.col("written")))
    d = B.parsed_summaries(d, "written")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    stand_in = {"fit_summary": F.col("draft.fit_summary"), "relevant_experience": listed(F.col("draft.relevant_experience")), "match_requirements": requests.match_lines(F.col("draft.match_requirements"), F.lit("en")), "recommended_next_step": F.col("draft.recommended_next_step")}
    missing = [F.when((T.clean_line(F.element_at("sections", k)) == "") & (T.some(stand_in[k]) != ""), F.concat(F.lit(f"## {title}\n"), stand_in[k])) for k, title in SECTIONS]
    d = d.withColumn("summary", F.concat_ws("\n\n", F.nullif(F.col("written"), F.lit("")), *missing))
    hides, names = F.col("mode") == "anonymous", T.name_variants(F.col("name"), F.col("cv_file"))
    d = d.withColumn("briefing", F.when(hides, B.anonymised(F.col("draft"), kind, names)).otherwise(F.col("draft"))).withColumn("summary", F.when(hides, T.narrative(T.redact(B.soften(F.col("summary")), names))).otherwise(B.soften(F.col("summary"))))
    d = B.parsed_summaries(d, "summary")
    b = F.col("briefing")
    supported = F.size(F.filter(b["match_requirements"], lambda m: T.some(m["evidence"]) != ""))
    warnings = B.draft_warnings(F.col("sections"), F.size(b["employment_history"]), F.size(b["match_requirements"]), supported, b["candidate"]["name"], b["role"]["title"], F.col("summary"), hides, F.least("n_cv", "n_jd"))
    errors = checks.briefing_errors(F.struct(b["candidate"]["name"].alias("name"), b["role"]["title"].alias("title"), b["fit_summary"].alias("fit_summary"), b["recommended_next_step"].alias("recommended_next_step")))
    left = F.when(hides, B.residual_warnings(b, kind)).otherwise(F.array().cast("array<string>"))
    return d.select("pair_id", "mode", "summary", "briefing", "origin", errors.alias("errors"), warnings.alias("warnings"), left.alias("personal_data"))
