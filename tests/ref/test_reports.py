"""Word templates filled, redaction of texts with control characters, and orders of anonymising."""

import io
import zipfile

from pyspark.sql import functions as F

from docweft.functions import text as T
from docweft.operators import identity, report
from docweft.sources.scan import docx_bytes


def broken_over_runs() -> bytes:
    """A template whose tag is broken over two runs."""
    data, out = docx_bytes("Name: {{candidate_name}} & co"), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as to:
        for n in z.namelist():
            body = z.read(n).decode()
            body = body.replace("{{candidate_name}}", '{{candi</w:t></w:r><w:r><w:t xml:space="preserve">date_name}}').replace("document.main+xml", "template.main+xml")
            to.writestr(n, body)
    return out.getvalue()


def test_word_templates(spark):
    made = report.fill_word(broken_over_runs(), {"candidate_name": "Jane <&> Example\nsecond"})
    assert report.word_text(made) == "Name: Jane <&> Examplesecond & co" and "<w:br/>" in zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml").decode()
    assert report.word_faults(made) == [] and report.word_faults(b"x") == ["no Word package"]
    assert report.word_faults(broken_over_runs()) == ["the main part is no document"]
    df = spark.createDataFrame([(1, broken_over_runs(), {"candidate_name": "A"}), (2, docx_bytes("{{Candidate_Name}} {{unknown}}."), None)], "id int, template binary, values map<string,string>")
    assert [r.text for r in report.word_reports(df).orderBy("id").collect()] == ["Name: A & co", " ."]


def test_redaction_keeps_control_characters(spark):
    texts = ["a\x01b call +49 170 1234567 now", "x\x01", "tel 030-1234-5678, 555 123 4567; +1 2", "12345678901234567890", "mail a@b.org at 12 Long Street", "Address: x y\nz"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.redact(F.col("t"))).collect()]
    assert got == ["a\x01b call [phone redacted] now", "x\x01", "tel [phone redacted], [phone redacted]; +1 2", "12345678901234567890", "mail [email redacted] at [address redacted]", "Address: [address redacted]\nz"]
    plan = spark.createDataFrame([("x",)], "t string").select(T.redact(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 8000


def test_names_beside_files(spark):
    names = [("李四\nx", "王五简历.pdf"), ("Jane Example\nEngineer", "anything.pdf"), ("", "Jane_Example_CV_2020.pdf"), (None, None), ("", "cv.pdf")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, text string, file string")
    got = [r[0] for r in df.orderBy("i").select(identity.candidate_name(F.col("text"), F.col("file"))).collect()]
    assert got == ["王五", "Jane Example", "Jane Example", "Candidate", "Candidate"]
    scores = spark.createDataFrame([(0, ""), (1, "工程师")], "i int, s string").orderBy("i").select(identity.fragment_score(F.col("s"))).collect()
    assert scores[0][0] < 0 and scores[1][0] == 12 - 20 - 8
