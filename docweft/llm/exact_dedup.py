r"""Exact deduplication by a stateful stream.

1. Every row is cut down to a record (digest of the normalised text, stable
   identifier, content locator, length), written to the shared folder.
2. A Structured Streaming query reads the records and keeps, per digest, the best
   (length, identifier, locator) and a count in RocksDB state without a watermark,
   so that no key ever expires. State is partitioned by digest and aggregated
   before the shuffle, so a hot text costs one row per task.
3. Rows whose digest was hit more than once are checked on full bytes: of each
   digest the smallest and the largest normalised text must be the same string.
   A digest with two texts (a collision) is regrouped by the text itself.

With ``state``, the name of a folder in a file system that all machines share, state and
checkpoint live on there, and further calls are deliveries to the same stream: their rows
meet the state of all earlier ones. Of equal texts one of the earliest delivery stays, so a decision that was
given out is never taken back. The texts that stay are stored beside the state, for
the check on full bytes. A delivery whose call has failed begins anew with the next call,
which drops the records that the stream hasn't taken. Without ``state`` all of it goes with the session.

Normalised: without the characters ``[\x20\x09-\x0D]``. Of equal texts the row with
the most code points in its original text, then the smallest doc_id, stays. A null
text counts as empty, so null and blank texts are equal. A null doc_id ranks last;
of rows that tie in both, exactly one stays. An empty table gives an empty result. A very long text is
hashed whole where it is read, and only texts of digests that were hit more than once move.
Other columns are not read by deduplicate(); keep_first() gives them back as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType

from .keys import fresh
from .workspace import Workspace

#: Bytes of records in a micro-batch; some 80 bytes a row, so 30 GB of documents give several batches.
BATCH_BYTES = 1 << 28
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a store's native memory goes with its task; the state stays on disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _stored(work: Workspace, state: str, name: str) -> list[int]:
    """The numbers of the deliveries that have a folder below state/name."""
    jvm = work.spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{state}/{name}")
    system = path.getFileSystem(work.spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName().removeprefix("delivery=")) for f in system.listStatus(path) if f.getPath().getName().startswith("delivery=")) if system.exists(path) else []


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=sha256, files_per_batch: int | None = None, bytes_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    group_size counts the rows of all deliveries so far. ``digest`` maps the normalised text to a string. A micro-batch takes
    ``files_per_batch`` files of records if given, else ``bytes_per_batch`` (BATCH_BYTES).
    """
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "exact_dedup")
    root = (state or work.path).rstrip("/")
    number = len(done := _stored(work, root, "texts"))
    assert done == list(range(number)), "deliveries are missing from the state"
    base = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("n"), normalised(F.col(text)).alias("norm"), F.lit(number).alias("delivery"))
    # the locator numbers the written records, so it stays what it is
    written = base.select("doc_id", "n", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("locator"))
    written.write.mode("overwrite").parquet(f"{root}/records/delivery={number}")
    schema = written.schema.add("delivery", IntegerType())
    records = spark.read.schema(schema).parquet(f"{root}/records").filter(F.col("delivery") == number)
    rank = F.struct("delivery", (-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("locator").alias("locator"))

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema)
        stream = stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream.option("maxBytesPerTrigger", bytes_per_batch or BATCH_BYTES)
        keyed = stream.parquet(f"{root}/records").groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))

        def emit(changed: DataFrame, batch: int) -> None:
            changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/state/epoch={batch}")

        query = keyed.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if state is None:
        work.drop("checkpoint")
    seen_schema = keyed.schema.add("batch", IntegerType()).add("epoch", IntegerType())
    seen = spark.read.schema(seen_schema).parquet(f"{root}/state") if number or records.limit(1).count() else spark.createDataFrame([], seen_schema)
    classes = seen.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max_by("group_size", "batch").alias("group_size"))
    classes = work.keep(classes.select("digest", "best", "group_size"), "classes")

    # full bytes on hits; written first, since only a join that ends there can be split where one digest is hot
    hit = classes.filter("group_size > 1").select("digest")
    full = base.select("norm", digest(F.col("norm")).alias("digest")).join(hit, "digest")
    if number:
        store = spark.read.parquet(f"{root}/texts").filter(F.col("delivery") < number)
        full = full.unionByName(store.select("norm", "digest").join(hit, "digest"))
    full = work.keep(full, "hits")
    collided = work.keep(full.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest"), "collisions")
    work.drop("hits")
    plain = records.join(classes, "digest")
    out = _rows(plain)
    if collided.limit(1).count():
        texts = base.select("doc_id", "n", "norm", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("locator"), "delivery").join(collided, "digest")
        texts = work.keep(texts, "texts_of_collisions")
        exact = texts.groupBy("digest", "norm").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
        if number:
            exact = exact.unionByName(store.join(collided, "digest").select("digest", "norm", "best", "group_size"))
            exact = exact.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        exact = work.keep(exact, "exact")
        out = _rows(plain.join(collided, "digest", "left_anti")).unionByName(_rows(texts.join(exact, ["digest", "norm"])))
    if state is not None:
        # written last: a delivery counts as taken once its texts are stored
        texts = base.select("doc_id", "n", "norm", digest(F.col("norm")).alias("digest"), F.monotonically_increasing_id().alias("locator"), "delivery")
        out = work.keep(out, "out")
        texts.groupBy("digest", "norm").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")).write.mode("overwrite").parquet(f"{root}/texts/delivery={number}")
    return out


def _rows(joined: DataFrame) -> DataFrame:
    same = (F.col("locator") == F.col("best.locator")) & (F.col("delivery") == F.col("best.delivery"))
    return joined.select("doc_id", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", same.alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    named, n, row, keep_doc, keep_digest = fresh(docs, "digest", "n", "row", "keep_doc", "keep_digest")
    marked = deduplicate(docs, doc_id, text)
    kept = marked.filter("kept").select(F.col("doc_id").alias(keep_doc), F.col("digest").alias(keep_digest))
    tagged = docs.withColumn(named, sha256(normalised(F.col(text)))).withColumn(n, F.char_length(F.coalesce(F.col(text), F.lit(""))))
    out = tagged.join(kept, (F.col(named) == F.col(keep_digest)) & F.col(doc_id).eqNullSafe(F.col(keep_doc)), "left_semi")
    # several rows can share doc_id and normalised text; only then is one of them picked by length
    twice = marked.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count()
    if twice:
        w = Window.partitionBy(named, doc_id).orderBy(F.col(n).desc(), *[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])
        out = out.withColumn(row, F.row_number().over(w)).filter(F.col(row) == 1).drop(row)
    return out.drop(named, n)
