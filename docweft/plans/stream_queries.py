"""Queries that run as streams over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from ..sources.shared import scratch
from ..streaming import keyed, run_log
from .record_queries import STATE as REVIEW
from .record_queries import _issues
from .registry import query, table


def _stream(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's plain path has to be a folder
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start_us, event_type AS operation, count(*) AS runs, count(*) FILTER (event_id % 10 = 0) AS failed,
    CAST(round(avg(floor(greatest(value, 0) * 10 + 0.5) / 10), 6) AS DOUBLE) AS mean_ms FROM events GROUP BY ALL""")
def q_stream_run_metrics(spark, sf_dir):
    """Windows of a day in update mode: a window is there as soon as it has rows, and its state goes when the watermark has passed it."""
    e = _stream(spark, sf_dir)
    status = F.when(F.col("event_id") % 10 == 0, "failed").otherwise("success")
    r = e.select(F.col("event_type").alias("operation"), F.col("event_id").cast("string").alias("run_id"), status.alias("status"), F.col("at").alias("started_at"), F.col("at").alias("completed_at"), F.lit("fetch").alias("error_message"), F.col("value").alias("total_ms"), F.create_map(F.lit("all"), F.col("value")).alias("phases"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("context"))
    m = run_log.metrics(run_log.normal_records(r), "1 day")
    at = scratch(spark, "metrics")
    out = run_log.newest(run_log.changes(m, f"{at}/changes", f"{at}/checkpoint"), ["start", "operation"])
    return out.select(F.unix_micros("start").alias("start_us"), "operation", "runs", "failed", F.round("mean_ms", 6).alias("mean_ms"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def q_stream_latest_state(spark, sf_dir):
    """The last event of each user, kept as state over micro-batches."""
    e = _stream(spark, sf_dir).select("user_id", "event_id", "event_type", F.struct("at", "event_id").alias("order"))
    at = scratch(spark, "latest")
    return run_log.latest_state(e, "user_id", "order", f"{at}/state", f"{at}/checkpoint", compacted=True).select("user_id", "event_id", "event_type")


def _deliveries(spark, rows, at, name, run, days=8, jitter_hours=12, last=None):
    """Run a stream once for each delivery of rows: ``days`` of event time in one, up to ``jitter_hours`` out of order, then a row of far later that closes all.

    Checkpoint and state go on from run to run, as they do for a table that grows.
    """
    where = scratch(spark, name)
    jitter = F.pmod(F.xxhash64(*rows.columns), F.lit(jitter_hours * 3600))
    first = F.lit(1_704_067_200)
    dealt = rows.withColumn("delivery", F.floor((F.unix_seconds(at) - first + jitter) / (days * 86_400)).cast("int"))
    numbers = sorted(r[0] for r in dealt.select("delivery").distinct().collect())  # one a delivery
    dealt = dealt.persist()
    try:
        for n in [*numbers, None]:
            if n is None:
                end = {"at": "2100-01-01 00:00:00"} | (last or {})
                end = dealt.limit(1).select(*[F.lit(end.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
                end.write.mode("append").parquet(f"{where}/in")
            else:
                dealt.filter(F.col("delivery") == n).drop("delivery").write.mode("append").parquet(f"{where}/in")
            out = run(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), f"{where}/out", f"{where}/checkpoint")
    finally:
        dealt.unpersist()
    return out


def _cores(spark):
    """One partition of state for each core."""
    return spark.sparkContext.defaultParallelism


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("ts").cast("timestamp").alias("at"))


@query("""WITH w AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 30 AS entry, max({'at': ts, 'id': event_id}) AS t FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS n FROM w)
    SELECT user_id, CAST(n AS INTEGER) AS place, CAST(entry AS VARCHAR) AS entry, CAST(epoch_us(t.at) AS BIGINT) AS at_us FROM r WHERE n <= 12""")
def q_stream_recent(spark, sf_dir):
    """The twelve things that each user touched last, as state with eviction over deliveries."""
    def run(stream, out, checkpoint):
        found = keyed.newest_entries(stream, "user_id", F.col("k") % 30, F.col("at"), F.col("event_id"))
        run_log.changes(found, out, checkpoint, partitions=_cores(spark))
        run_log.compact(spark, out, found.schema, ["user_id"])
        return run_log.newest(run_log.written(spark, out, found.schema), ["user_id"])

    got = _deliveries(spark, _events(spark, sf_dir), F.col("at"), "recent", run).select("user_id", F.posexplode(F.arrays_zip("entries", "ats")))
    return got.select("user_id", (F.col("pos") + 1).alias("place"), F.col("col.entries").alias("entry"), F.col("col.ats").alias("at_us"))


@query("""WITH b AS (SELECT user_id, event_id, event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS sequence, ts FROM events),
    p AS (SELECT *, max(sequence) OVER (PARTITION BY user_id ORDER BY ts, sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
    SELECT user_id, event_id AS id, CASE WHEN sequence < before THEN 'stale' ELSE 'applied' END AS verdict FROM p""")
def q_stream_in_order(spark, sf_dir):
    """Answers that overtake each other, judged in the order in which they were seen, though they are delivered out of order."""
    def run(stream, out, checkpoint):
        found = keyed.in_order(stream, "user_id", F.col("event_id") - F.col("k") * 3, F.col("at"), F.col("event_id"))
        return run_log.changes(found, out, checkpoint, "append", _cores(spark))

    return _deliveries(spark, _events(spark, sf_dir), F.col("at"), "in_order", run).select("user_id", "id", "verdict")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts)) AS BIGINT) AS end_us, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM s GROUP BY user_id, session""")
def q_stream_sessions(spark, sf_dir):
    """Sessions of each user by gaps of half an hour, put out as the watermark closes them."""
    def run(stream, out, checkpoint):
        return run_log.changes(keyed.sessions(stream, "user_id", "at", F.col("value")), out, checkpoint, "append", _cores(spark))

    found = _deliveries(spark, _events(spark, sf_dir), F.col("at"), "sessions", run)
    return found.select("user_id", "start_us", "end_us", "n", F.round("total", 4).alias("total"))


@query(REVIEW + " SELECT * FROM r")
def q_stream_review(spark, sf_dir):
    """Issues and decisions as two streams that meet; what comes out is the same as of the tables, in whatever order they arrive."""
    base, day = F.lit(1_704_067_200), 86_400
    raised = base + F.pmod(F.col("doc_id") * 7919, F.lit(8 * day))
    made = raised + F.pmod(F.col("doc_id") * 104_729, F.lit(2 * day))
    issue = ["src", "issue_key", "code", "severity", "section"]
    i = _issues(spark, sf_dir).select("doc_id", *issue)
    decision = F.when(F.col("doc_id") % 5 == 0, "keep-project-unlinked").otherwise("mark-reviewed")
    rows = i.select(F.lit("issue").alias("kind"), *issue, F.lit(None).cast("string").alias("decision_type"), F.timestamp_seconds(raised).alias("at"))
    d = i.filter("doc_id % 2 = 0")
    rows = rows.unionByName(d.select(F.lit("decision").alias("kind"), *issue, decision.alias("decision_type"), F.timestamp_seconds(made).alias("at")))
    # second thoughts, which don't count
    rows = rows.unionByName(d.filter("doc_id % 4 = 0").select(F.lit("decision").alias("kind"), *issue, F.lit("keep-project-unlinked").alias("decision_type"), F.timestamp_seconds(made + 3600).alias("at")))

    def run(stream, out, checkpoint):
        of = lambda kind: stream.filter(F.coalesce(F.col("kind"), F.lit(kind)) == kind)  # noqa: E731  the row that closes all is of both kinds
        issues = of("issue").select(*issue, F.col("at").alias("raised_at"))
        decisions = of("decision").select("src", "issue_key", "decision_type", F.col("at").alias("decided_at"))
        return run_log.changes(keyed.decided(issues, decisions, "src", "raised_at", "decided_at"), out, checkpoint, "append", _cores(spark))

    met = _deliveries(spark, rows, F.col("at"), "review", run, days=4, last={"src": "", "issue_key": ""}).filter("issue_key <> ''").drop("batch")
    where = scratch(spark, "first")
    met.write.parquet(f"{where}/in")
    first = keyed.first_decision(spark.readStream.schema(met.schema).parquet(f"{where}/in"), "src", "raised_at", "decided_at")
    out = run_log.newest(run_log.changes(first, f"{where}/out", f"{where}/checkpoint", partitions=_cores(spark)), ["src", "issue_key"])
    found = out.filter("decision_type is not null").select("src", "issue_key", "decision_type")
    return review.review_state(review.applied(out.select(*issue), found, ["src"]), ["src"])
