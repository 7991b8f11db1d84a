"""The recent-state store: JSON rows by key, newest first, a bounded number of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import values as X
from ..functions import vocabulary as V
from ..operators import relational as R

# The paths that name a workspace.
KEYS = ["folder", "jd_path", "cv_path", "loaded_jd_path", "loaded_cv_path"]


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a store; a missing store is empty, rows that are no JSON are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(conf).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).dropna("all")


def named(df: DataFrame) -> DataFrame:
    """Adds the id of a workspace, made of its paths."""
    return df.withColumn("workspace_id", X.workspace_id(*[F.col(k) for k in KEYS]))


def save(stored: DataFrame, fresh: DataFrame, path: str, key: str = "workspace_id", at: str = "updated_at", most: int = V.RECENT) -> None:
    """Fresh rows replace those of their key; the newest stay. ``path`` is not the one that ``stored`` is read from."""
    R.upsert_recent(stored, fresh, key, at, most).coalesce(1).write.mode("overwrite").json(path)


def summaries(df: DataFrame) -> DataFrame:
    """What a list of workspaces shows: names of the files and whether there is a draft."""
    name = lambda c: X.base_name(F.col(c)).alias(c.replace("path", "name"))
    return df.select("workspace_id", name("jd_path"), name("cv_path"), "updated_at", (F.trim(F.coalesce("summary", F.lit(""))) != "").alias("has_draft")).orderBy(F.col("updated_at").desc(), "workspace_id")


def meaningful(df: DataFrame) -> DataFrame:
    return df.filter(" or ".join(f"trim(coalesce({c}, '')) <> ''" for c in ("folder", "jd_path", "cv_path", "summary")))
