"""Checks of settings, payloads and drafts: what is wrong with each, as arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Providers that need no key, the least number of tokens of the local one, and messages by status of the key.
KEYLESS, LOCAL, LOCAL_LEAST = ["ollama_deepseek_r1"], "ollama_deepseek_r1", 4096
KEY_STATUS = {
    "secure-storage-unavailable": "Secure storage is unavailable, so the saved API key could not be loaded. Re-enter the API key for this session.",
    "secure-storage-policy-blocked": "Secure credential storage is blocked by local policy or profile restrictions. Re-enter the API key or contact support.",
    "secure-storage-read-failed": "The saved API key could not be read from secure storage. Re-enter the API key or contact support.",
}
# What a draft has to hold.
REQUIRED = [
    ("name", "Candidate name is missing from the structured briefing."),
    ("title", "Role title is missing from the structured briefing."),
    ("fit_summary", "Fit summary is missing from the structured briefing."),
    ("recommended_next_step", "Recommended next step is missing from the structured briefing."),
]
MOST_CLIPBOARD = 200_000


def _told(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, told) for cond, told in pairs]))


def settings_errors(s: Column) -> Column:
    """s: struct<provider, base_url, model, api_key, key_status: string, temperature: double, max_tokens: bigint, system_prompt, template_mode, template_path, template_extension, output_path, output_extension: string>; already with defaults."""
    x = {k: F.trim(T.some(s[k])) for k in ("provider", "base_url", "model", "api_key", "key_status", "system_prompt", "template_path", "output_path")}
    mode, ext, out_ext = (F.trim(T.some(s[k])) for k in ("template_mode", "template_extension", "output_extension"))
    mode = F.when(mode == "", "default").otherwise(mode)
    status = F.create_map(*[F.lit(v) for kv in KEY_STATUS.items() for v in kv])
    tokens = F.when(x["provider"] == LOCAL, F.greatest(s["max_tokens"], F.lit(LOCAL_LEAST))).otherwise(s["max_tokens"])
    return _told(
        (x["provider"] == "", "Provider is required."),
        (x["base_url"] == "", "Base URL is required."),
        (~x["base_url"].rlike("(?i)^https?://"), "Base URL must start with http:// or https://."),
        (x["model"] == "", "Model is required."),
        ((x["api_key"] == "") & ~x["provider"].isin(KEYLESS), F.coalesce(F.element_at(status, x["key_status"]), F.lit("API key is required."))),
        (~s["temperature"].between(0, 2), "Temperature must be between 0 and 2."),
        (~tokens.between(128, 8192), "Max tokens must be between 128 and 8192."),
        (x["system_prompt"] == "", "System prompt is required."),
        (~mode.isin("default", "local-file"), "Reference template mode must be `default` or `local-file`."),
        ((mode == "local-file") & (x["template_path"] == ""), "Choose a local reference template file or switch back to the built-in default template."),
        ((x["template_path"] != "") & (F.lower(ext) != ".md"), "The reference template must be a Markdown (.md) document."),
        ((x["output_path"] != "") & ~F.lower(out_ext).isin(".docx", ".dotx"), "The hiring-manager output template must be a Word .docx or .dotx document."),
    )


def absolute(path: Column) -> Column:
    return F.trim(T.some(path)).startswith("/")


def document_errors(name: Column, path: Column, label: str) -> Column:
    """A document needs a name or an absolute path."""
    n, p = F.trim(T.some(name)), F.trim(T.some(path))
    return F.when((p != "") & ~absolute(p), F.lit(f"{label} file path must be an absolute path.")).when((p == "") & (n == ""), F.lit(f"{label} file metadata must include a name or absolute path."))


def draft_errors(payload: Column, require_summary: bool = False) -> Column:
    """The first thing that is wrong with a draft; null if nothing is. payload: struct<summary, cv_name, cv_path, jd_name, jd_path: string>."""
    summary = F.when(F.lit(require_summary) & (F.trim(T.some(payload["summary"])) == ""), "A generated recruiter summary is required.")
    return F.coalesce(summary, document_errors(payload["cv_name"], payload["cv_path"], "Candidate CV"), document_errors(payload["jd_name"], payload["jd_path"], "Job description"))


def workspace_id(c: Column) -> Column:
    return F.trim(T.some(c)).rlike("(?i)^[a-f0-9]{16}$")


def output_mode(c: Column) -> Column:
    return F.when(F.trim(T.some(c)) == "anonymous", "anonymous").otherwise("named")


def briefing_errors(b: Column) -> Column:
    """b: struct with the fields of REQUIRED."""
    return _told(*[(T.clean_line(b[k]) == "", told) for k, told in REQUIRED])


def strings(c: Column, separators: str = r"\n") -> Column:
    """A list of strings from a text: its parts, clean and not empty."""
    return F.filter(F.transform(F.split(T.some(c), separators), T.strip_bullet), lambda x: x != "")


def match_pairs(c: Column) -> Column:
    """array<struct<requirement, evidence>> from lines "requirement -> evidence"; lines without either are left out."""
    part = lambda x, i: T.clean_line(F.get(F.split(x, r"\s*->\s*", 2), F.lit(i)))
    return F.filter(F.transform(strings(c), lambda x: F.struct(part(x, 0).alias("requirement"), part(x, 1).alias("evidence"))), lambda m: (m["requirement"] != "") | (m["evidence"] != ""))


def languages(c: Column) -> Column:
    """A labelled list split at commas, slashes, semicolons and bars, without repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(T.some(c), r"[,，、/;；|]+"), T.clean_line), lambda x: x != ""))
