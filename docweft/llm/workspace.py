"""Scratch tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BROADCASTS = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_live: list["Workspace"] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session. A local one of our own only where none is set and all tasks run in the driver's own process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (root or "file://" + os.path.join(tempfile.gettempdir(), f"docweft-{os.getpid()}")).rstrip("/")


class Workspace:
    """A folder of Parquet tables that belong to one run of one operator.

    ``broadcast`` is the size up to which tables go through the driver to joins of what is written (-1: none); None leaves it to the session.
    """

    def __init__(self, spark: SparkSession, name: str, broadcast: int | None = None):
        self.spark, self.path, self.broadcast = spark, f"{shared_root(spark)}/docweft/{name}-{uuid.uuid4().hex}", broadcast
        _live.append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    @contextmanager
    def setting(self, key: str, value: object) -> Iterator[None]:
        """A setting of the session while something is written."""
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, value)
        try:
            yield
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def keep(self, df: DataFrame, name: str, batch: int = 1000, codec: str = "snappy", by: str | None = None) -> DataFrame:
        """Write df and read it back; the schema is passed on, so that empty tables work.

        Python operators in df get at most ``batch`` rows and some 8 MB at a time, as whole texts can be long.
        """
        with ExitStack() as held:
            for key, value in [(BATCH, batch), (BATCH_BYTES, 8 << 20), *[(b, self.broadcast) for b in BROADCASTS if self.broadcast is not None]]:
                held.enter_context(self.setting(key, value))
            df.write.mode("overwrite").parquet(self.at(name), compression=codec, partitionBy=by)
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; without names, the whole folder."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [self.at(n) for n in names] or [self.path]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)

    def release(self) -> None:
        """Shuffle files of steps that are over go now, not when the driver next collects its garbage."""
        self.spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for w in _live:
        try:
            if w.spark.sparkContext._jsc is not None:
                w.drop()
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
