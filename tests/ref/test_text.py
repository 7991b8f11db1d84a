"""Text and value functions on inline cases."""

import re

import pytest
from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.functions import values as X


def one(spark, value, f, *more):
    df = spark.createDataFrame([(value, *more)], ", ".join(f"c{i} string" for i in range(1 + len(more))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [(None, ""), ("  a \t\n b  ", "a b"), ("a　b﻿", "a b")])
def test_clean_line(spark, value, want):
    assert one(spark, value, T.clean_line) == want


@pytest.mark.parametrize(("value", "want"), [("The Python engineers, and C", ["python", "engineers"]), ("区块链 x", ["区块", "块链"]), ("链", []), (None, [])])
def test_tokens(spark, value, want):
    assert one(spark, value, T.tokens) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("write to a.b@c-d.org now", "write to [email redacted] now"),
        ("see https://www.linkedin.com/in/me)", "see [LinkedIn redacted])"),
        ("Home Address: 1 Long Way\nnext", "Home Address: [address redacted]\nnext"),
        ("at 12 High Street today", "at [address redacted] today"),
        ("call +1 (743) 555-3824 or 555-123-4567.", "call [phone redacted] or [phone redacted]."),
        ("id +12345678901234567890 stays", "id +12345678901234567890 stays"),
        ("$1 and \\ stay", "$1 and \\ stay"),
    ],
)
def test_redact(spark, value, want):
    assert one(spark, value, T.redact) == want


def test_redact_names(spark):
    names = one(spark, "Jane (J.) Example", T.name_variants, "cv_Jane_Example_final.pdf")
    assert names == ["Jane Example", "Jane", "Example"]
    got = one(spark, "JANE  example met janet; 张三工作", lambda a, n: T.redact(a, F.array(F.lit("Jane Example"), F.lit("Jane"), F.lit("张三"))), "x")
    assert got == "Anonymous Candidate met janet; Anonymous Candidate工作"


def test_redact_phones_like_a_plain_version(spark, sf):
    patterns = [r"\+\d[\d()\s.-]{6,}\d", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\b\d{2,4}[-.\s]\d{3,4}[-.\s]\d{3,4}\b"]

    def plain(t):
        t = re.sub(r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[email redacted]", t, flags=re.A)
        for p in patterns:
            t = re.sub(p, lambda m: "[phone redacted]" if 7 <= len(re.sub(r"\D", "", m[0])) <= 15 else m[0], t, flags=re.A)
        return t

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.redact(F.col("text")).alias("r")).collect()
    assert sum(r.r != r.text for r in rows) > 0
    assert all(r.r == plain(r.text) for r in rows if not re.search(r"(?i)linkedin|address|street|\b(?:st|rd|way|dr|ct|ln)\b", r.text))


def test_narrative(spark):
    got = one(spark, "Candidate: Anonymous Candidate (x)\nAnonymous Candidate's work and Anonymous Candidate (y).\nAnonymous Candidate leads", T.narrative)
    assert got == "Candidate: Anonymous Candidate\nThe candidate's work and the candidate.\nThe candidate leads"


@pytest.mark.parametrize(
    ("value", "start", "end"),
    [("", None, None), ("Mar 2020", 24242, 24242), ("2020.3", 24242, 24242), ("2020-13", 24240, 24251), ("2019", 24228, 24239), ("Present", 119988, 119999), ("Sept 2021", 24260, 24260), ("至今", None, None)],
)
def test_month_ordinal(spark, value, start, end):
    assert (one(spark, value, X.month_ordinal), one(spark, value, lambda c: X.month_ordinal(c, "end"))) == (start, end)


@pytest.mark.parametrize(("value", "want"), [("a ```json\n{\"x\": 1}\n``` b", '{"x": 1}'), ("so {\"a\": {\"b\": 2}} there", '{"a": {"b": 2}}'), ("plain", "plain")])
def test_json_payload(spark, value, want):
    assert one(spark, value, X.json_payload) == want


@pytest.mark.parametrize(("value", "want"), [("", "unknown-error"), ("API key missing", "settings-error"), ("Failed to parse", "parse-error"), ("could not save", "export-error"), ("fetch failed", "provider-error"), ("odd", "unknown-error")])
def test_error_category(spark, value, want):
    assert one(spark, value, X.error_category) == want


def test_values(spark):
    assert one(spark, "/a/b/CV 10.PDF", X.base_name) == "CV 10.PDF" and one(spark, "/a/b/CV 10.PDF", X.extension) == ".pdf"
    names = ["b10", "B9", "a", "b1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["a", "b1", "B9", "b10"]
    assert one(spark, "a b", X.mailto, "x\ny") == "mailto:?subject=a%20b&body=x%0D%0Ay"
    r = spark.sql("select map('extract', 50.987D, 'x', 1000.444D, 'bad', double('NaN'), ' ', 1D, 'neg', -1D) m, 1234.567D t").select(X.phases(F.col("m")).alias("m"), X.round_ms(F.col("t")).alias("t")).first()
    assert r.m == {"extract": 51.0, "x": 1000.4} and r.t == 1234.6
    assert one(spark, "zh-CN", X.output_language) == "zh" and one(spark, "de", X.output_language) == "en"
    assert one(spark, "Hello {{name}}, {{other}}!", lambda c: T.fill_template(c, {"name": F.lit("X")})) == "Hello X, !"


def test_personal_data_next_to_letters_beyond_ascii(spark, tmp_path):
    """Edges of words are ASCII ones on both sides: texts of short pieces against SQL."""
    import random

    import duckdb

    from docweft import plans

    rng = random.Random(5)
    pieces = ["ß", "ä", "漢", "ſ", "\u212a", "\x0b", " ", "\n", ".", "-", "a@b.org", "a", "_", "7", "12 main st", "9 x Street", "555-2043", "(643)", "+1", "643 555 2043", "Address:", "addreſs: x", "lin\u212aedin.com/in/x", "http://", "linkedin.com/y"]
    texts = ["12 teen stß", "äa@b.orgß", "x ü555-204-3333é", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("q_residual_pii", "q_redact_labelled", "q_redact_pii"):
        mine = plans.QUERIES[name](spark, str(tmp_path))
        theirs = con.execute(f"select {', '.join(mine.columns)} from ({plans.ORACLES[name]}) order by doc_id").fetchall()
        wrong = [(texts[a[0]], tuple(a), b) for a, b in zip(mine.orderBy("doc_id").collect(), theirs, strict=True) if tuple(a) != b]
        assert not wrong, (name, len(wrong), wrong[:3])
