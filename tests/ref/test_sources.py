"""Payloads of any shape, the data source, and table functions."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docweft.operators import coerce, scanners, table_functions
from docweft.plans import source_queries
from docweft.sources import data_source, scan


def payload(spark, value):
    return spark.createDataFrame([(1, value if isinstance(value, str) or value is None else json.dumps(value))], "id int, payload string")


CASES = [
    ({"employment_history": {"jobTitle": " Lead ", "employer": "A", "dates": "2019 – Present"}}, [("Lead", "A", "2019", "Present", [], 0)]),
    ({"employment_history": [{"title": "", "job_title": "x", "responsibilities": "- a\n\n• b"}, {}, None, {"note": "n"}, {"responsibilities": ["- c", " "]}]}, [("x", "", "", "", ["a", "b"], 0), ("", "", "", "", ["c"], 0)]),
    ({"employment_history": {"title": "t", "start_date": 2019, "evidence_refs": [{"source": "CV"}, {"other": 1}]}}, [("t", "", "2019", "", [], 1)]),
    ({"employment_history": "text"}, []),
    ({"employment_history": []}, []),
    ({"other": 1}, []),
    ("{broken", []),
    (None, []),
    ("", []),
]


@pytest.mark.parametrize(("value", "want"), CASES)
def test_coerced(spark, value, want):
    got = coerce.rows(payload(spark, value), "payload", "employment_history", "id").orderBy("place").collect()
    assert [(r.job_title, r.company_name, r.start_date, r.end_date, r.responsibilities, len(r.evidence_refs)) for r in got] == want


def test_other_entities_and_schema(spark):
    df = payload(spark, {"education": {"degreeName": "MSc", "institution": "U", "dates": "2010-2012"}, "project_experiences": [{"name": "P", "bullets": "b", "originalBullets": 1}]})
    assert [tuple(r)[1:] for r in coerce.rows(df, "payload", "education", "id").collect()] == [(0, "MSc", "U", "2010", "2012")]
    r = coerce.rows(df, "payload", "project_experiences", "id").first()
    assert (r.project_name, r.project_bullets) == ("P", ["b"])
    two = spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',), ("{",), (None,)], "payload string")
    got = coerce.schema_found(two, "payload").first()
    assert (got.schema, got.n, got.n_broken) == ("OBJECT<a: BIGINT, b: STRING>", 4, 1)
    assert coerce.schema_found(two.limit(0), "payload").first().n == 0


@pytest.fixture
def folder(tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    (where / "a.txt").write_text("plain text " * 40)
    (where / "b.docx").write_bytes(scan.docx_bytes("one\ntwo"))
    (where / "c.pdf").write_bytes(b"no pdf at all")
    (where / "d.doc").write_bytes(b"x")
    (where / "e.txt").write_text("\n")
    return str(where)


def as_rows(df):
    return sorted((r["name"], r["extension"], r["size"], r["text"], r["status"], tuple(r["warnings"])) for r in df.collect())


def test_files_are_read_as_before(spark, folder):
    want = as_rows(scan.documents(spark, folder))
    for most in ("1", "500", "100000000"):
        assert as_rows(data_source.documents(spark, folder, bytesPerPartition=most)) == want
    sizes = [(p, n) for _, p, n in data_source.listed(folder)]
    assert len(data_source.planned(sizes, 1)) == 5 and len(data_source.planned(sizes, 1 << 30)) == 1 and data_source.planned([], 5) == []


def test_no_files_and_empty_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert data_source.documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "empty.txt").write_text("")
    assert [(r.size, r.status) for r in data_source.documents(spark, str(tmp_path / "none")).collect()] == [(0, "warning")]


def test_files_are_streamed_once_each(spark, folder, tmp_path):
    def drain():
        q = data_source.arriving(spark, folder).select("name", "status").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert drain() == ["a.txt", "b.docx", "c.pdf", "d.doc", "e.txt"]
    with open(f"{folder}/f.txt", "w") as f:
        f.write("later")
    assert drain() == ["a.txt", "b.docx", "c.pdf", "d.doc", "e.txt", "f.txt"]


def test_log_is_whole_or_not_there(spark, tmp_path):
    data_source.register(spark)
    where = f"{tmp_path}/log"
    df = spark.range(20).select("id", F.struct(F.lit("é").alias("x")).alias("s"))
    for _ in range(2):
        df.repartition(3).write.format("docweft_log").mode("append").option("path", where).save()
    lines = [json.loads(line) for name in sorted(os.listdir(where)) for line in open(f"{where}/{name}", encoding="utf-8")]
    assert sorted(x["id"] for x in lines) == sorted([*range(20)] * 2) and lines[0]["s"] == {"x": "é"}
    broken = spark.range(20).repartition(3).select(F.udf(lambda i: 1 // (i - 5), "long")("id").alias("v"))
    with pytest.raises(Exception, match="ZeroDivision"):
        broken.write.format("docweft_log").mode("append").option("path", where).save()
    assert sum(not n.startswith("_") for n in os.listdir(where)) == 6


JOB = ["Some Company Ltd", "2010 - 2012", "Senior Engineer", "- did it"]


def test_table_functions(spark):
    table_functions.register(spark)
    docs = spark.createDataFrame([(1, JOB * 2), (2, []), (3, None), (None, JOB), (4, [None, "x"])], "doc_id bigint, lines array<string>")
    got = spark.sql("SELECT d.doc_id, r.ord, r.title FROM {d} d, LATERAL records(d.lines, 'employment') r", d=docs).collect()
    want = scanners.scan(docs, "employment").select("doc_id", "ord", "title").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) == 3
    lines = docs.select("doc_id", F.posexplode("lines").alias("place", "line"))
    by_line = "SELECT * FROM records_of_lines(TABLE(SELECT doc_id, place, line FROM {t}) PARTITION BY (doc_id) ORDER BY (place), 'employment')"
    got = spark.sql(by_line, t=lines).select("doc_id", "ord", "title").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert spark.sql(by_line, t=lines.limit(0)).collect() == []
    assert spark.sql("SELECT r.degree FROM (SELECT array('BSc in Arts', 'Some University', '2010 - 2012') AS l), LATERAL records(l, 'education') r").first().degree == "BSc in Arts"
    for wrong in ("records(array('x'), 'other')", "records_of_lines(TABLE(SELECT 1 AS id), 'employment')"):
        with pytest.raises(Exception, match="kind of records|column line"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_lines_are_gathered(spark, sf):
    """A large table's lines come to the table function as arrays, in order and with nulls, not a row a line (F10)."""
    lines = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, None), (2, 0, "x")], "doc_id int, place int, line string")
    assert sorted(map(tuple, table_functions.gathered(lines).collect())) == [(1, ["a", None, "c"]), (2, ["x"])]
    plan = source_queries.q_records_of_lines(spark, sf)._jdf.queryExecution().toString()
    assert "records(" in plan and "records_of_lines(" not in plan
