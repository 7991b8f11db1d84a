"""Run logs as a stream: JSON lines in, metrics per window out; keyed state in RocksDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import values as X

RECORD = "operation string, run_id string, status string, started_at timestamp, completed_at timestamp, error_message string, total_ms double, phases map<string,double>, context map<string,string>"


def normal_records(df: DataFrame) -> DataFrame:
    """Rounded durations, phases without blanks and negatives, context without nulls, category of the error."""
    context = F.map_filter(F.transform_values("context", lambda k, v: F.trim(v)), lambda k, v: (F.trim(k) != "") & v.isNotNull())
    return df.select(
        F.trim("operation").alias("operation"), "run_id", "status", "started_at", "completed_at", X.round_ms(F.col("total_ms")).alias("total_ms"), X.phases(F.col("phases")).alias("phases"), context.alias("context"),
        F.when(F.col("status") == "success", "none").otherwise(X.error_category(F.col("error_message"))).alias("error_category"),
    )


def append(df: DataFrame, folder: str) -> None:
    """One JSON line per record, added to those in the folder."""
    normal_records(df).write.mode("append").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORD.replace("error_message", "error_category")).json(folder)


def metrics(records: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, failures and mean duration by operation and window; state of windows older than the watermark is dropped."""
    seen = records.withWatermark("completed_at", late).groupBy(F.window("completed_at", window), "operation")
    out = seen.agg(F.count(F.lit(1)).alias("runs"), F.sum((F.col("status") != "success").cast("bigint")).alias("failed"), F.avg("total_ms").alias("mean_ms"), F.max("total_ms").alias("max_ms"))
    return out.select(F.col("window.start").alias("start"), "operation", "runs", "failed", "mean_ms", "max_ms")


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is now, into Parquet, and read that."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def changes(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update", partitions: int | None = None) -> DataFrame:
    """Run a stream with state over all there is now; the rows that each batch has put out, with the batch's number, over any number of runs.

    ``partitions`` of state are made with the first run, and stay as they are.

    State is kept in RocksDB below the checkpoint, so a batch writes what it has touched and
    nothing else. A batch that is repeated after a failure writes its own folder again.
    """
    spark = stream.sparkSession

    def emit(changed: DataFrame, number: int) -> None:
        changed.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/epoch={number}")

    own = STATE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return written(spark, folder, stream.schema)


def _files(spark: SparkSession, folder: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, where, where.getFileSystem(conf)


def _epochs(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the folders that count: the last compaction (-1 - the batch it goes up to) and the batches after it."""
    _, where, fs = _files(spark, folder)
    if not fs.exists(where):
        return []
    found = sorted(int(n.split("=")[1]) for n in (f.getPath().getName() for f in fs.listStatus(where)) if n.startswith("epoch="))
    return [found[0], *(n for n in found if n > -1 - found[0])] if found and found[0] < 0 else found


def written(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows that the batches have put out so far."""
    schema = StructType([*schema.fields, StructField("batch", IntegerType())])
    own = [f"{folder}/epoch={n}" for n in _epochs(spark, folder)]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def compact(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> None:
    """Only the last state of each key stays, in one folder; what came before it goes.

    The new folder gets its name by one rename when it is whole, and readers leave out what it
    covers, so a run that is lost in between loses and repeats nothing.
    """
    epochs = _epochs(spark, folder)
    if len(epochs) < 2:
        return
    jvm, where, fs = _files(spark, folder)
    last, at = max(epochs), f"{folder}/_compacting"
    newest(written(spark, folder, schema), keys, batch=True).write.mode("overwrite").parquet(at)
    fs.rename(jvm.org.apache.hadoop.fs.Path(at), jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch={-1 - last}"))
    for f in fs.listStatus(where):
        name = f.getPath().getName()
        if name.startswith("epoch=") and -1 - last < int(name.split("=")[1]) <= last:
            fs.delete(f.getPath(), True)


def newest(changed: DataFrame, keys: list[str], batch: bool = False) -> DataFrame:
    """The last state of each key among its changes; the batch it is from, if asked for."""
    rest = [c for c in changed.columns if c not in keys and (batch or c != "batch")]
    return changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def latest_state(stream: DataFrame, key: str, at: str, folder: str, checkpoint: str, compacted: bool = False) -> DataFrame:
    """The row of each key with the largest ``at``, over any number of runs; ``compacted`` keeps one row a key on disk after each run."""
    rest = [c for c in stream.columns if c != key]
    keyed = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("row")).select(key, "row.*")
    changes(keyed, folder, checkpoint)
    if compacted:
        compact(stream.sparkSession, folder, keyed.schema, [key])
    return newest(written(stream.sparkSession, folder, keyed.schema), [key])
