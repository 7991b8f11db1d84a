"""Payloads of unknown shape made rows: VARIANT, names in either spelling, one thing where a list could be.

A payload is parsed once; nothing is assumed of its schema. Each field of an entity has the keys that
it can stand under, the first with something in it counts. Where a list is expected, a single thing is a
list of one, a text is a list of its lines. Entities without any value are dropped. What isn't
JSON has no entities. All are columns of the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as X


class Field(NamedTuple):
    name: str
    keys: tuple[str, ...]
    kind: str = "text"  # text, texts, start or end (of a range of dates, where the key itself isn't there), entities
    of: str = ""
    counts: bool = True  # whether a value here keeps the entity


_EVIDENCE = Field("evidence_refs", ("evidence_refs", "evidenceRefs"), "entities", "evidence", False)
# Fields and the keys that they can stand under.
ENTITIES: dict[str, list[Field]] = {
    "evidence": [Field(x, (x,)) for x in ("source", "section", "excerpt", "note")],
    "education": [
        Field("degree_name", ("degree_name", "degreeName", "degree")), Field("university", ("university", "institution")),
        Field("start_year", ("start_year", "startYear"), "start"), Field("end_year", ("end_year", "endYear"), "end"),
    ],
    "employment_history": [
        Field("job_title", ("job_title", "jobTitle", "title")), Field("company_name", ("company_name", "companyName", "employer")),
        Field("start_date", ("start_date", "startDate"), "start"), Field("end_date", ("end_date", "endDate"), "end"),
        Field("responsibilities", ("responsibilities",), "texts"), _EVIDENCE,
    ],
    "project_experiences": [
        Field("project_name", ("project_name", "projectName", "name")), Field("project_summary", ("project_summary", "projectSummary", "summary")),
        Field("project_start_date", ("project_start_date", "projectStartDate"), "start"), Field("project_end_date", ("project_end_date", "projectEndDate"), "end"),
        Field("project_timeline_basis", ("project_timeline_basis", "projectTimelineBasis", "timeline_basis"), counts=False),
        Field("linked_job_title", ("linked_job_title", "linkedJobTitle")), Field("linked_company_name", ("linked_company_name", "linkedCompanyName")),
        Field("project_bullets", ("project_bullets", "projectBullets", "bullets"), "texts"),
        Field("project_bullet_originals", ("project_bullet_originals", "projectBulletOriginals", "original_bullets", "project_bullet_original_text"), "texts", counts=False), _EVIDENCE,
    ],
}


def parsed(payload: Column) -> Column:
    """The payload as VARIANT; null where it is no JSON."""
    return F.try_parse_json(payload)


def _is_list(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def _raw(v: Column, keys: tuple[str, ...]) -> Column:
    """The text under the first key that has one."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys], F.lit(""))


def listed(v: Column) -> Column:
    """A list of VARIANT: the elements of a list, or the one thing that is there."""
    one = F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))
    return F.coalesce(F.when(_is_list(v), F.try_variant_get(v, "$", "array<variant>")), one, F.array().cast("array<variant>"))


def texts(v: Column) -> Column:
    """A list of texts without bullets and blanks; a text counts by its lines."""
    lines = F.flatten(F.transform(listed(v), lambda x: F.when(_is_list(v), F.array(F.try_variant_get(x, "$", "string"))).otherwise(F.split(T.some(F.try_variant_get(x, "$", "string")), r"\r?\n"))))
    return F.filter(F.transform(lines, lambda x: T.strip_bullet(T.some(x))), lambda x: x != "")


def _under(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in keys])


def entity(v: Column, name: str) -> Column:
    """struct of an entity's fields."""
    dates = X.date_range(F.try_variant_get(v, "$.dates", "string"))

    def value(f: Field) -> Column:
        if f.kind == "entities":
            return entities(_under(v, f.keys), f.of)
        if f.kind == "texts":
            return texts(_under(v, f.keys))
        own = _raw(v, f.keys)
        return T.clean_line(own if f.kind == "text" else F.when(own != "", own).otherwise(dates[f.kind]))

    return F.struct(*[value(f).alias(f.name) for f in ENTITIES[name]])


def entities(v: Column, name: str) -> Column:
    """array of the entities in a VARIANT that have any value."""
    fields = [f for f in ENTITIES[name] if f.counts]

    def has(e: Column) -> Column:
        found = F.lit(False)
        for f in fields:
            found = found | (F.size(e[f.name]) > 0 if f.kind in ("texts", "entities") else e[f.name] != "")
        return found

    return F.filter(F.transform(listed(v), lambda x: entity(x, name)), has)


def rows(df: DataFrame, payload: str, name: str, *keys: str) -> DataFrame:
    """``keys``, place (from 0) and the fields of each entity under the payload's key ``name``."""
    v = F.try_variant_get(F.col("__payload"), f"$.{name}", "variant")
    parsed_once = df.select(*keys, parsed(F.col(payload)).alias("__payload"))
    found = parsed_once.select(*keys, F.posexplode(entities(v, name)).alias("place", "__entity"))
    return found.select(*keys, "place", "__entity.*")


def schema_found(df: DataFrame, payload: str) -> DataFrame:
    """One row: the schema that holds all payloads, found by aggregation, with how many there are and how many are no JSON."""
    v = parsed(F.col(payload))
    return df.select(v.alias("v"), F.col(payload).alias("p")).agg(F.schema_of_variant_agg("v").alias("schema"), F.count(F.lit(1)).alias("n"), F.sum((F.col("p").isNotNull() & F.col("v").isNull()).cast("bigint")).alias("n_broken"))
