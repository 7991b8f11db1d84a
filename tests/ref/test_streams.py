"""Keyed state over several runs, settings and logs as files."""

from pyspark.sql.types import StructType

from docweft.sources import settings
from docweft.streaming import run_log

ROW = "k string, at int, v string"


def test_latest_state_goes_on(spark, tmp_path):
    said = []
    deliveries = [[("a", 1, "x"), ("b", 5, "y"), (None, 1, "n")], [("a", 3, "z"), ("b", 2, "old")], [("c", 1, "w")]]
    for n, rows in enumerate(deliveries):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = run_log.latest_state(stream, "k", "at", f"{tmp_path}/changes", f"{tmp_path}/ck")
        said.append({r.k: r.v for r in got.collect()})
    assert said == [{"a": "x", "b": "y", None: "n"}, {"a": "z", "b": "y", None: "n"}, {"a": "z", "b": "y", None: "n", "c": "w"}]
    import os

    # a batch writes what it has touched: two keys, of which one has changed nothing for its reader
    assert spark.read.parquet(f"{tmp_path}/changes").filter("epoch = 2").count() == 1 and "state" in os.listdir(f"{tmp_path}/ck")


def test_settings_without_secrets(spark, tmp_path):
    kind = StructType.fromDDL("provider string, model string, api_key string, temperature double")
    path = f"{tmp_path}/settings"
    defaults = {"provider": "local", "model": "m", "temperature": 0.2}
    assert tuple(settings.load(spark, path, kind, defaults).first()) == ("local", "m", None, 0.2)
    settings.save(spark.createDataFrame([("other", None, "secret", 1.0)], kind), path)
    assert tuple(settings.load(spark, path, kind, defaults).first()) == ("other", "m", None, 1.0)
    assert "secret" not in "".join(r.value for r in spark.read.text(path).collect())
    for line in ("one", "two"):
        settings.append_lines(spark.createDataFrame([(line,)], "line string"), f"{tmp_path}/log")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/log").collect()) == ["one", "two"]
