"""Text columns: cleaning, keys, tokens, line rules, redaction.

An empty string and a null mean the same: all functions take null as ''.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bound(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x) with x computed once, however often of() names it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def clean_line(c: Column) -> Column:
    """White space of any kind squeezed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(some(c), r"(?U)[\s\uFEFF]+", " "))


def normalise_whitespace(c: Column) -> Column:
    """No carriage returns, single blanks, at most one blank line in a row, nothing at the ends."""
    squeezed = F.regexp_replace(F.regexp_replace(F.replace(some(c), F.lit("\r"), F.lit("")), r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(squeezed, r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$", "")


def lines(c: Column) -> Column:
    return F.split(some(c), "\n", -1)


def non_empty_lines(c: Column) -> Column:
    return F.filter(F.transform(lines(F.regexp_replace(some(c), "\r\n?", "\n")), clean_line), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(some(c), "\r\n?", "\n"), r"\n{2,}", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(some(c), r"(?<=[.!?。！？])\s+|\n+", -1), clean_line), lambda x: x != "")


def loose_key(c: Column) -> Column:
    return F.lower(clean_line(c))


def comparison_key(c: Column, blank: str = "") -> Column:
    """Lower case, only a-z, 0-9 and CJK; everything else is replaced by blank."""
    return F.trim(F.regexp_replace(F.lower(some(c)), r"[^a-z0-9一-鿿]+", blank))


def strip_bullet(c: Column) -> Column:
    return F.trim(F.regexp_replace(clean_line(c), r"^[-*•]\s*", ""))


def _grams(token: Column) -> Column:
    """A token with CJK as its pairs of neighbours; other tokens as they are."""
    n = F.char_length(token)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(token, i, 2))
    return F.when(token.rlike(r"[一-鿿]"), F.when(n <= 1, F.array(token)).otherwise(pairs)).otherwise(F.array(token))


def all_tokens(c: Column) -> Column:
    """Tokens of a-z, 0-9 and CJK pairs; single characters and stop words included."""
    plain = F.trim(F.regexp_replace(F.lower(some(c)), r"[^a-z0-9一-鿿]+", " "))
    pairs = lambda x: F.filter(F.flatten(F.transform(F.split(x, " "), _grams)), lambda t: t != "")
    return bound(plain, lambda x: F.when(x == "", F.array().cast("array<string>")).when(x.rlike(r"[一-鿿]"), pairs(x)).otherwise(F.split(x, " ")))


def tokens(c: Column) -> Column:
    """Tokens of retrieval: longer than one character and no stop word."""
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.filter(all_tokens(c), lambda t: (F.char_length(t) > 1) & ~F.array_contains(stop, t))


def distinct_tokens(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.filter(F.array_except(all_tokens(c), stop), lambda t: F.char_length(t) > 1)


def preview(c: Column, most: int = V.PREVIEW, mark: str = "…") -> Column:
    """At most ``most`` characters, the mark among them."""
    x = clean_line(c)
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit(mark)))


def import_preview(c: Column, most: int = V.IMPORT_PREVIEW) -> Column:
    x = normalise_whitespace(c)
    return F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most)), F.lit("...")))


def language_hint(c: Column) -> Column:
    cjk, latin = some(c).rlike(r"[一-鿿]"), some(c).rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("unknown")


# --- line rules


def is_page_marker(line: Column) -> Column:
    return line.rlike(V.PAGE_MARKER) | line.rlike(V.PAGE_OF)


def is_opaque(line: Column) -> Column:
    return line.rlike(V.OPAQUE)


def is_decoration(line: Column) -> Column:
    return line.rlike(V.DECORATION)


def normalise_bullet(line: Column) -> Column:
    return F.regexp_replace(line, V.BULLET, "- ")


def line_rule(line: Column) -> Column:
    """The rule that a cleaned line falls under; null if none."""
    return (
        F.when(line == "", "drop_empty")
        .when(is_page_marker(line), "strip_page_marker")
        .when(is_opaque(line), "strip_opaque_pdf_artifact")
        .when(is_decoration(line), "strip_decoration_only_line")
        .when(normalise_bullet(line) != line, "normalize_bullet_marker")
    )


def heading_key(c: Column) -> Column:
    return loose_key(F.regexp_replace(F.regexp_replace(some(c), r"^#+\s*", ""), r"[:：]\s*$", ""))


def working_text(c: Column, kind: Column) -> Column:
    """English working text of CVs and job descriptions: punctuation and known terms replaced, lines cleaned."""
    x = F.trim(some(c))
    plain = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), V.PUNCTUATION, x)
    told = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(f" {p[1]} ")), V.WORKING_TEXT, plain)
    out = F.when(language_hint(x) == "en", plain).otherwise(told)
    return F.when(kind.isin("cv", "jd"), F.array_join(non_empty_lines(out), "\n")).otherwise("")


# --- personal data


def _phones(text: Column, pattern: str) -> Column:
    """Phone-like matches are replaced where they have 7 to 15 digits; the text is put together from what is between matches."""
    told = lambda m: F.when(F.length(F.regexp_replace(m, r"\D", "")).between(7, 15), F.lit("[phone redacted]")).otherwise(m)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.array_join(F.zip_with(between, found, lambda x, m: F.concat(x, F.coalesce(told(m), F.lit("")))), "")


def redact(c: Column, names: Column | None = None) -> Column:
    """E-mail, LinkedIn, labelled and street addresses, names, then phones.

    ``names`` is an array of literal names; CJK names are replaced wherever they stand,
    others at ASCII word edges and in any case. A pattern is tried only on texts that hold
    what all its matches hold.
    """
    steps: list[tuple[Callable[[Column], Column], Callable[[Column], Column]]] = [
        (lambda t: t.contains("@"), lambda t: F.regexp_replace(t, V.EMAIL, "[email redacted]")),
        (lambda t: t.rlike(r"(?i)edin\.com/"), lambda t: F.regexp_replace(t, V.LINKEDIN, "[LinkedIn redacted]")),
        (lambda t: t.rlike("(?i)addre"), lambda t: F.regexp_replace(t, V.LABELED_ADDRESS, "$1: [address redacted]")),
        (lambda t: t.rlike(f"[0-9][{V.BLANK}]"), lambda t: F.regexp_replace(t, V.STREET, "[address redacted]")),
    ]
    if names is not None:

        def replaced(text: Column, name: Column) -> Column:
            quoted = F.regexp_replace(F.regexp_replace(F.trim(name), r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"\\s+")
            edged = F.when(name.rlike(r"[一-鿿]"), quoted).otherwise(F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))
            return F.when(F.trim(name) == "", text).otherwise(F.regexp_replace(text, edged, F.lit(V.ANONYMOUS)))

        steps.append((lambda t: names.isNotNull(), lambda t: F.aggregate(names, t, replaced)))
    for p, hint in zip(V.PHONE_FORMS, (r"\+[0-9]", r"[0-9]{3}[-.\s]?[0-9]{3}", r"[0-9]{2}[-.\s][0-9]{3}"), strict=True):
        steps.append((lambda t, h=hint: t.rlike(h), lambda t, p=p: _phones(t, p)))
    return reduce(lambda x, step: bound(x, lambda t: F.when(step[0](t), step[1](t)).otherwise(t)), steps, some(c))


def name_variants(name: Column, file_name: Column) -> Column:
    """The names that redact() looks for: the whole name, its first and last word and the file's words of four letters or more."""
    whole = clean_line(F.regexp_replace(some(name), r"\([^)]*\)", " "))
    words = F.split(whole, " ")
    ends = F.filter(F.array(F.get(words, F.lit(0)), F.element_at(words, -1)), lambda w: F.char_length(w) >= 4)
    of_file = F.filter(F.split(F.regexp_replace(some(file_name), r"\.[^.]+$", ""), "[^A-Za-z]+"), lambda t: (F.char_length(t) >= 4) & ~F.lower(t).isin(V.GENERIC_FILE_TOKENS))
    joined = F.when(F.size(of_file) > 1, F.array(F.array_join(of_file, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(F.array(whole), joined, ends, of_file), lambda x: x != ""))


def narrative(c: Column) -> Column:
    """Anonymous labels inside prose as "the candidate"; a label line stays."""
    label = r"(?i)^\s*Candidate\s*:\s*Anonymous Candidate(?:\s*\(\s*[^)]*\s*\))?\s*$"

    def of(line: Column) -> Column:
        x = F.regexp_replace(line, r"\bAnonymous Candidate\s*\([^)]*\)", "Anonymous Candidate")
        x = F.regexp_replace(x, r"\bAnonymous Candidate's\b", "the candidate's")
        x = F.regexp_replace(x, r"\bAnonymous Candidate\b", "the candidate")
        x = F.regexp_replace(x, r"(?i)\bthe candidate\s*\([^)]*\)", "the candidate")
        x = F.regexp_replace(x, r"^the candidate\b", "The candidate")
        return F.when(F.trim(line) == "", line).when(F.trim(line).rlike(label), "Candidate: Anonymous Candidate").otherwise(x)

    return F.array_join(F.transform(lines(F.replace(some(c), F.lit("\r\n"), F.lit("\n"))), of), "\n")


def residual(c: Column) -> dict[str, Column]:
    """Which kinds of personal data are still there; phones count with any number of digits."""
    x = some(c)
    return {
        "has_email": x.rlike(V.EMAIL),
        "has_linkedin": x.rlike(V.LINKEDIN),
        "has_phone": reduce(lambda a, b: a | b, [x.rlike(p) for p in V.PHONE_FORMS]),
        "has_address": x.rlike(V.LABELED_ADDRESS) | x.rlike(V.STREET),
    }


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """{{key}} becomes its value; unknown keys become ''."""
    out = reduce(lambda a, kv: F.replace(a, F.lit("{{" + kv[0] + "}}"), some(kv[1])), values.items(), some(template))
    return F.regexp_replace(out, r"\{\{[a-z_]+\}\}", "")
