"""Settings and debug logs as files: JSON without secrets, and lines that are only added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fields that are never written.
SECRET = ["api_key"]


def save(settings: DataFrame, path: str) -> None:
    settings.drop(*SECRET).coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """The settings of a file with defaults in its gaps; a missing file has defaults alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    row = spark.createDataFrame([(0,)], "one int")
    if where.getFileSystem(conf).exists(where):
        row = row.join(spark.read.schema(schema).json(path).limit(1), how="left")
    value = lambda f: F.col(f.name) if f.name in row.columns else F.lit(None)
    return row.select(*[F.coalesce(value(f), F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def append_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Add text lines to a debug log; each call adds files, nothing is rewritten."""
    lines.select(column).write.mode("append").text(path)
