"""The folder that driver and executors share, and tables of few files over many cores."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROWS = 500_000  # that a task sorts or groups


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below a local one of our own only where that is unset and all tasks run in the driver's own process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file://" + os.path.join(tempfile.gettempdir(), f"docweft-{os.getpid()}")
    return f"{root.rstrip('/')}/docweft/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer files than there are cores, for work that is heavier than a shuffle of so small a table; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # counted in the JVM
    return df.repartition(cores) if 0 < files < cores else df


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as there are cores or partitions of a shuffle, for heavy work per row after it: AQE makes few tasks of rows that are small."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about ``rows`` rows dealt by keys to more tasks the more rows there are: with a number of partitions that is fixed, what a task sorts or groups grows with the table."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def handed_on(rows: Iterable[dict], names: list[str], most: int = 1000) -> Iterator[pd.DataFrame]:
    """Frames of at most ``most`` rows, so that a worker holds a few of a batch's results at a time, however many rows a batch makes."""
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield pd.DataFrame(held, columns=names)
