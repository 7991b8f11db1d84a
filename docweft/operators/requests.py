"""Requests to a language model, as columns: what is asked, of what sources, and what comes back.

No model is called here: a request is a list of messages, and a reply is text. Instructions
that a caller may want otherwise are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

# Placeholders where a section has nothing to say.
EMPTY = {"en": "- No evidence was captured in this section.", "zh": "- 本节暂无可用信息。"}
NO_MATCHES = {"en": "- No requirement-to-evidence matches were captured.", "zh": "- 暂未捕获岗位要求与证据匹配。"}
NO_HINTS = "- No strong evidence hints were extracted automatically."
HINTS, POINTS, CONCERNS, BATCH = 5, 4, 3, 3
#: What a summary must keep to, by mode of output.
CONSTRAINTS = {
    "named": ["- Use the candidate's name where the CV gives it."],
    "anonymous": [f"- Keep the draft anonymous and write {V.ANONYMOUS} for the name.", "- Leave out e-mail, phone, LinkedIn and street address."],
    "": ["- Say enough to explain the fit, without padding.", "- Where evidence is missing, name the gap."],
}

MESSAGE = "array<struct<role:string,content:string>>"


def messages(system: Column, prompt: Column) -> Column:
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(one("system", system), one("user", prompt))


def _by_language(language: Column, texts: dict[str, str]) -> Column:
    return F.when(language == "zh", texts["zh"]).otherwise(texts["en"])


def bullets(lines: Column, language: Column) -> Column:
    """A list as bullets, or a placeholder."""
    told = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), T.strip_bullet(x))), "\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, _by_language(language, EMPTY)).otherwise(told)


def match_lines(matches: Column, language: Column) -> Column:
    """array<struct<requirement, evidence>> as "- requirement -> evidence"."""
    part = lambda m: F.filter(F.array(T.clean_line(m["requirement"]), T.clean_line(m["evidence"])), lambda x: x != "")
    told = F.array_join(F.transform(matches, lambda m: F.concat(F.lit("- "), F.array_join(part(m), " -> "))), "\n")
    return F.when(F.coalesce(F.size(matches), F.lit(0)) <= 0, _by_language(language, NO_MATCHES)).otherwise(told)


def hints(matches: Column) -> Column:
    """The first five requirements with evidence, or a placeholder."""
    first = F.slice(F.filter(matches, lambda m: T.some(m["evidence"]) != ""), 1, HINTS)
    told = F.transform(first, lambda m: F.concat(F.lit("- Requirement: "), m["requirement"], F.lit("\n  Evidence hint: "), m["evidence"]))
    return F.when(F.size(first) > 0, F.array_join(told, "\n")).otherwise(NO_HINTS)


def source_context(blocks: Column) -> Column:
    """Blocks (array<struct<block_id, section_label, text>>) as a prompt shows them."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("["), b["block_id"], F.lit("] "), b["section_label"], F.lit("\n"), b["text"])), "\n\n")


def _constraints(mode: Column) -> Column:
    lines = lambda m: F.array(*map(F.lit, [*CONSTRAINTS[m], *CONSTRAINTS[""]]))
    return F.array_join(F.when(mode == "anonymous", lines("anonymous")).otherwise(lines("named")), "\n")


def summary_prompt(name: Column, role: Column, cv: Column, jd: Column, guidance: Column, matches: Column, mode: Column) -> Column:
    """name and role, both source contexts, the template's guidance, evidence hints and constraints, by sections."""
    section = lambda title, body: F.concat(F.lit(title + ":\n"), body)
    return F.concat_ws(
        "\n\n", section("Candidate", T.clean_line(name)), section("Target role", T.clean_line(role)), section("Candidate CV source blocks", cv), section("Job description source blocks", jd), section("Template", T.some(guidance)), section("Requirement-to-evidence hints", hints(matches)), section("Constraints", _constraints(mode))
    )


def briefing_prompt(prompt: Column, shape: str) -> Column:
    """A summary's prompt with the JSON shape that the reply has to have."""
    return F.concat(prompt, F.lit("\n\nReturn only valid JSON of this shape:\n" + shape))


def repair_prompt(reply: Column, error: Column, shape: str) -> Column:
    return F.concat(F.lit("The reply below is no valid JSON of the wanted shape ("), error, F.lit(").\nReturn only the corrected JSON.\n\nShape:\n" + shape + "\n\nReply:\n"), T.some(reply))


def translatable(draft: Column, with_summary: bool = True) -> Column:
    """What of a draft may be translated, as JSON: no names, companies, dates, references or skills."""
    nothing = F.lit(None)
    payload = F.struct(
        F.struct(*[draft["candidate"][k].alias(k) for k in ("location", "languages", "notice_period")]).alias("candidate"),
        F.struct(draft["role"]["title"].alias("title")).alias("role"),
        *[draft[k].alias(k) for k in ("fit_summary", "relevant_experience", "potential_concerns", "recommended_next_step")],
        F.transform(draft["match_requirements"], lambda m: F.struct(m["requirement"].alias("requirement"), m["evidence"].alias("evidence"))).alias("match_requirements"),
        F.transform(draft["employment"], lambda e: F.struct(e["title"].alias("title"), e["duties"].alias("duties"))).alias("employment"),
        (draft["summary"] if with_summary else nothing.cast("string")).alias("summary"),
    )
    return F.to_json(payload)


def translation_batches(employment: Column) -> Column:
    """Employment rows three at a time, as they are sent one after another."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(employment), F.lit(1)), F.lit(BATCH))
    return F.filter(F.transform(starts, lambda i: F.slice(employment, i, BATCH)), lambda b: F.size(b) > 0)


def email_facts(draft: Column, mode: Column) -> Column:
    """struct<name, role, company, points, concerns>: the facts that an e-mail may use."""
    name, role = T.clean_line(draft["candidate"]["name"]), T.clean_line(draft["role"]["title"])
    listed = lambda c, n: F.slice(F.filter(F.transform(c, T.strip_bullet), lambda x: x != ""), 1, n)
    return F.struct(
        F.when(name != "", name).when(mode == "anonymous", V.ANONYMOUS).otherwise("the candidate").alias("name"),
        F.when(role != "", role).otherwise("the role").alias("role"),
        F.coalesce(F.nullif(T.clean_line(draft["role"]["company"]), F.lit("")), F.lit("(not specified)")).alias("company"),
        listed(draft["relevant_experience"], POINTS).alias("points"),
        listed(draft["potential_concerns"], CONCERNS).alias("concerns"),
    )


def email_prompt(draft: Column, mode: Column) -> Column:
    f = email_facts(draft, mode)
    lines = [F.concat(F.lit(k + ": "), f[v]) for k, v in (("Candidate label", "name"), ("Target role", "role"), ("Company", "company"))]
    return F.concat_ws("\n", F.lit("Draft a recommendation e-mail to the hiring manager in plain text."), *lines, F.concat(F.lit("Output mode: "), mode), F.lit("Approved summary:"), T.some(draft["summary"]), F.lit("Facts:"), F.to_json(F.struct(f["points"].alias("points"), f["concerns"].alias("concerns"))))


def reply_json(reply: Column) -> Column:
    """The JSON object in a reply: what stands between its first and last brace; null without one."""
    return F.nullif(F.regexp_extract(T.some(reply), r"(?s)\{.*\}", 0), F.lit(""))


def mock_reply(name: Column, role: Column, matches: Column) -> Column:
    """A reply made of the request's own facts, for runs without a model."""
    return F.concat_ws("\n\n", F.concat(F.lit("Candidate: "), name), F.concat(F.lit("Target Role: "), role), F.concat(F.lit("## Match Against Key Requirements\n"), match_lines(matches, F.lit("en"))))
