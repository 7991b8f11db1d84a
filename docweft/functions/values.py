"""Dates, numbers, maps, JSON and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import clean_line, some

PRESENT = 9999 * 12


def year_of(c: Column) -> Column:
    """The first year 1900 to 2099 in a text; null without one."""
    return F.regexp_extract(some(c), r"((?:19|20)\d{2})", 1).try_cast("int")


def month_ordinal(c: Column, boundary: str = "start") -> Column:
    """year * 12 + month (from 0) of a date text; the last month of a bare year for the boundary "end"; null if there is no date."""
    x = clean_line(c)
    named = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+((?:19|20)\d{2})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in V.MONTHS]), F.lower(F.substring(F.regexp_extract(x, named, 1), 1, 3))) - 1
    numeric = r"\b((?:19|20)\d{2})[./-](\d{1,2})\b"
    number = F.regexp_extract(x, numeric, 2).try_cast("int")
    end = 11 if boundary == "end" else 0
    return (
        F.when(x == "", F.lit(None))
        .when(x.rlike("(?i)present|current|now"), PRESENT + end)
        .when(x.rlike(named), F.regexp_extract(x, named, 2).try_cast("int") * 12 + month)
        .when(number.between(1, 12), F.regexp_extract(x, numeric, 1).try_cast("int") * 12 + number - 1)
        .otherwise(year_of(x) * 12 + end)
        .cast("int")
    )


def date_range(c: Column) -> Column:
    """struct<start, end> of the first range of years in a text; the end can be a word for the present."""
    pattern = r"(?i)((?:19|20)\d{2})(?:[./-]\d{1,2})?\s*(?:–|-|—|to|至)\s*(present|current|now|至今|目前|现在|(?:19|20)\d{2})"
    return F.struct(F.regexp_extract(some(c), pattern, 1).alias("start"), F.regexp_extract(some(c), pattern, 2).alias("end"))


def format_range(start: Column, end: Column, between: str = " - ") -> Column:
    a, b = clean_line(start), clean_line(end)
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(between), b))


def round_ms(c: Column) -> Column:
    """One decimal, halves up; 0 for what is negative or no number."""
    x = c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)
    return F.when(bad, 0.0).otherwise(F.floor(x * 10 + 0.5) / 10)


def phases(c: Column) -> Column:
    """A map of durations without blank keys and without values that are negative or no number; rounded."""
    fine = F.map_filter(c, lambda k, v: (F.trim(k) != "") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v >= 0))
    return F.transform_values(fine, lambda k, v: round_ms(v))


def error_category(c: Column) -> Column:
    x = F.lower(F.trim(some(c)))
    out = F.when(x == "", "unknown-error")
    for name, words in V.ERROR_CATEGORIES:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]), name)
    return out.otherwise("unknown-error")


def output_language(c: Column) -> Column:
    return F.when(F.lower(F.trim(some(c))).isin("zh", "zh-cn", "cn", "chinese"), "zh").otherwise("en")


def json_payload(c: Column) -> Column:
    """The fenced block of a reply, else from its first { to its last }, else all of it."""
    x = F.trim(some(c))
    fenced = F.regexp_extract(x, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", F.regexp_replace(fenced, r"^\s+|\s+$", "")).when(braces != "", braces).otherwise(x)


def number_or(c: Column, fallback: float) -> Column:
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(float(fallback))).otherwise(x)


def workspace_id(*paths: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the lower-case paths, joined by bars."""
    return F.substring(F.sha1(F.lower(F.concat_ws("|", *[F.trim(some(p)) for p in paths]))), 1, 16)


def base_name(c: Column) -> Column:
    return F.regexp_extract(some(c), r"([^/\\]*)[/\\]*$", 1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r"(\.[^.]+)$", 1))


def natural_key(c: Column) -> Column:
    """Sorts names by their numbers' values, in any case: runs of digits are padded to 20."""
    x = F.lower(some(c))
    parts = F.regexp_extract_all(x, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def mailto(subject: Column, body: Column) -> Column:
    """A mailto address, percent-encoded, with CRLF line ends."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("mailto:?subject="), encoded(some(subject)), F.lit("&body="), encoded(F.regexp_replace(some(body), r"\r?\n", "\r\n")))
