"""Nested values and the recent-state store."""

from pyspark.sql import functions as F

from docweft.functions import nested as N
from docweft.functions import text as T
from docweft.sources import store


def test_map_collect_merge(spark):
    df = spark.sql("""select named_struct('name', 'Jane', 'n', 1, 'tags', array('a@b.co', null), 'job', named_struct('title', 'x', 'notes', map('k', 'c@d.org'))) p,
        named_struct('name', ' ', 'n', cast(null as int), 'tags', array('z'), 'job', named_struct('title', 'y', 'notes', map('k', 'v'))) f""")
    kind = df.schema["p"].dataType
    hidden = df.select(N.map_strings(F.col("p"), kind, lambda c, path: F.lit("Anonymous") if path == "name" else T.redact(c)).alias("x")).first().x
    assert (hidden.name, hidden.n, hidden.tags, hidden.job.notes) == ("Anonymous", 1, ["[email redacted]", ""], {"k": "[email redacted]"})
    assert df.select(N.all_strings(F.col("p"), kind).alias("x")).first().x == ["Jane", "a@b.co", "x", "c@d.org"]
    m = df.select(N.merge(F.col("f"), F.col("p"), kind, frozenset({"tags"}), frozenset({"title"})).alias("x")).first().x
    assert (m.name, m.n, m.tags, m.job.title) == ("Jane", 1, ["z", "a@b.co", None], "x")


def test_store(spark, tmp_path):
    schema = "folder string, jd_path string, cv_path string, loaded_jd_path string, loaded_cv_path string, summary string, updated_at int"
    rows = spark.createDataFrame([(f"/f{i}", "/f/JD 1.pdf", "/f/cv.docx", "", "", "s" if i % 2 else "", i) for i in range(14)], schema)
    first, second = f"{tmp_path}/a", f"{tmp_path}/b"
    fresh = store.named(store.meaningful(rows))
    store.save(store.read(spark, first, fresh.schema), fresh, first)
    got = store.read(spark, first, fresh.schema)
    assert got.count() == 12
    store.save(got, store.named(rows.filter("folder = '/f5'").withColumn("updated_at", F.lit(99))), second)
    told = store.summaries(store.read(spark, second, fresh.schema)).collect()
    assert len(told) == 12 and told[0].updated_at == 99 and told[0].jd_name == "JD 1.pdf" and told[0].has_draft
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("no json\n")
    assert store.read(spark, f"{tmp_path}/bad", fresh.schema).count() == 0
