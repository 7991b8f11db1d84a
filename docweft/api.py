"""The data operations behind the public channels, each a function over tables or columns.

Pickers, shell calls, the clipboard and live model calls belong to a desktop; what those
channels compute or check is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import text as T
from .operators import briefing, checks, generation, identity, report, requests, review, selection
from .sources import scan, settings, store


def import_documents(spark: SparkSession, folder: str) -> DataFrame:
    return scan.documents(spark, folder)


def list_source_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder with how much each looks like a job description or a CV."""
    return selection.file_roles(scan.files(spark, folder).withColumn("folder", F.lit(folder)), ["folder"])


def derive_profile(docs: DataFrame) -> DataFrame:
    """Names and titles of documents (doc_id, kind, text, file_name)."""
    return identity.identified(docs)


def list_recent(stored: DataFrame) -> DataFrame:
    return store.summaries(store.meaningful(stored))


def load_snapshot(stored: DataFrame, workspace_id: str, now: Column) -> DataFrame:
    """The stored rows with the loaded workspace moved to the front; an unknown id raises."""
    return selection.touched(stored, "workspace_id", workspace_id, "updated_at", now).orderBy(F.col("updated_at").desc(), "workspace_id")


def save_snapshot(stored: DataFrame, fresh: DataFrame, path: str) -> None:
    store.save(stored, store.named(fresh), path)


def clear_recent(stored: DataFrame, path: str) -> None:
    stored.limit(0).coalesce(1).write.mode("overwrite").json(path)


def load_settings(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    return settings.load(spark, path, schema, defaults)


def save_settings(df: DataFrame, path: str) -> DataFrame:
    """Write settings that have no errors; the errors of all of them."""
    checked = df.withColumn("errors", checks.settings_errors(F.struct(*df.columns)))
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    if not valid.isEmpty():  # what is stored stays where nothing valid takes its place
        settings.save(valid, path)
    return checked.select("provider", "errors")


def summary_requests(pairs: DataFrame, guidance: str = "") -> DataFrame:
    """What a model is asked about pairs of a CV and a job description, with the facts that need no model."""
    return generation.requested(pairs, guidance)


def generate_summary(wanted: DataFrame, replies: DataFrame) -> DataFrame:
    """Drafts from a model's replies; pairs without a usable reply get one of facts."""
    return generation.drafted(wanted, replies)


def render_review(drafts: DataFrame, issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, state and posture before and after decisions, and whether the draft may go out.

    drafts: doc_id; issues: doc_id and the fields of an issue; decisions: doc_id, issue_key,
    decision_type, at. Drafts without issues are green and allowed.
    """
    keyed = issues.withColumn("issue_key", review.issue_key(issues))
    told = review.normal_decisions(decisions, ["doc_id"], [F.col("at")])
    states = lambda d: review.review_state(review.applied(keyed, d, ["doc_id"]), ["doc_id"]).select("doc_id", "state", "posture")
    raw, final = states(told.limit(0)), states(told)
    out = drafts.select("doc_id").join(raw.withColumnsRenamed({"state": "raw_state", "posture": "raw_posture"}), "doc_id", "left").join(final, "doc_id", "left")
    out = out.na.fill("green", ["raw_state", "state"]).na.fill("allowed", ["raw_posture", "posture"])
    return out.withColumn("exportable", F.col("posture") == "allowed")


def export_word_draft(reviewed: DataFrame, payloads: DataFrame) -> DataFrame:
    """Filled Word files of the drafts that may go out, with what is wrong with each. payloads: doc_id, template binary, values map, required, forbidden."""
    ready = payloads.join(reviewed.filter("exportable").select("doc_id"), "doc_id", "left_semi")
    made = report.word_reports(ready)
    return made.select("doc_id", "document", report.report_faults(F.col("text"), F.col("required"), F.col("forbidden")).alias("faults"))


def share_draft(draft: Column, mode: Column) -> Column:
    """The request for an e-mail about a draft."""
    return requests.messages(F.lit("You write professional recommendation e-mails in plain text."), requests.email_prompt(draft, mode))


def translate_output(draft: Column, language: Column) -> Column:
    """The request for a draft's translation."""
    ask = F.concat(F.lit("Translate the values of this JSON to "), F.when(language == "zh", "Simplified Chinese").otherwise("English"), F.lit(" and keep its keys.\n"), requests.translatable(draft))
    return requests.messages(F.lit("You translate documents faithfully."), ask)


def clipboard(subject: Column, body: Column) -> Column:
    """The text for a clipboard; null if it is longer than one takes."""
    text = briefing.clipboard_text(subject, body)
    return F.when(F.char_length(T.some(text)) <= checks.MOST_CLIPBOARD, text)
