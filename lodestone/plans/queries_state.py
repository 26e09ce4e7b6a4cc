"""Queries over jobs, requests and timings, all from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.plans.book import Book, table
from lodestone.streaming import jobs, ratelimit

BOOK = Book()
NOW = "2024-01-20 00:00:00"
# an event is a submission of job user_id % 97; its status follows from its id
STATUS_SQL = """st AS (SELECT 'j' || (user_id % 97) AS job_id, min(ts) AS submitted_at, max_by(['queued', 'running', 'succeeded', 'failed'][(event_id % 4 + 1)::INT], event_id) AS status, max(event_id) % 5 AS attempts,
 max_by(ts + INTERVAL 30 SECOND, event_id) AS lock_expires_at FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("queued", "running", "succeeded", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    out = e.groupBy(F.concat(F.lit("j"), F.col("user_id") % 97).alias("job_id")).agg(F.min("ts").alias("submitted_at"), F.max_by(kind, "event_id").alias("status"), (F.max("event_id") % 5).alias("attempts"), F.max_by(F.col("ts") + F.expr("INTERVAL 30 SECONDS"), "event_id").alias("lock_expires_at"))
    return out.withColumns({"locked_by": F.when(F.col("status") == "running", "w0"), "started_at": F.lit(None).cast("timestamp_ntz"), "finished_at": F.lit(None).cast("timestamp_ntz"), "error_message": F.lit(None).cast("string")})


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@BOOK.query(f"WITH {STATUS_SQL}, f AS (SELECT * FROM st WHERE status = 'queued' OR (status = 'running' AND lock_expires_at < TIMESTAMP '2024-01-20') ORDER BY submitted_at, job_id LIMIT 1) SELECT job_id, 'running' AS status, 'w1' AS locked_by, attempts + 1 AS attempts FROM f")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, _ = jobs.claim(_status(spark, sf_dir), "w1", _now(), 300)
    return mine.select("job_id", "status", "locked_by", "attempts")


@BOOK.query(
    f"""WITH {STATUS_SQL}, nw AS (SELECT 'j' || (user_id % 131) AS job_id, min(ts) AS submitted_at FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1),
fr AS (SELECT job_id, submitted_at, 'queued' AS status, 0 AS attempts FROM nw WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.job_id = nw.job_id AND st.status <> 'failed'))
SELECT * FROM fr UNION ALL SELECT job_id, submitted_at, status, attempts FROM st WHERE job_id NOT IN (SELECT job_id FROM fr)"""
)
def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _events(spark, sf_dir).where(F.col("ts") >= _now()).select(F.concat(F.lit("j"), F.col("user_id") % 131).alias("job_id"), F.col("ts").alias("submitted_at"))
    return jobs.enqueue(_status(spark, sf_dir), new).select("job_id", "submitted_at", "status", F.col("attempts").cast("long").alias("attempts"))


@BOOK.query(
    f"""WITH {STATUS_SQL}, r AS (SELECT job_id, CASE WHEN length(job_id) = 2 THEN 'succeeded' ELSE 'crashed' END AS s FROM st WHERE status = 'running')
SELECT st.job_id, CASE WHEN r.s IS NULL THEN status WHEN r.s = 'succeeded' THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN r.s IS NULL THEN NULL ELSE 'done' END AS error_message, r.s IS NULL AS leased FROM st LEFT JOIN r USING (job_id)"""
)
def job_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _status(spark, sf_dir)
    results = status.where("status = 'running'").select("job_id", F.when(F.length("job_id") == 2, "succeeded").otherwise("crashed").alias("status"), F.lit("done").alias("error_message"))
    return jobs.finish(status, results, _now()).select("job_id", "status", "error_message", F.col("lock_expires_at").isNotNull().alias("leased"))


@BOOK.query(f"WITH {STATUS_SQL} SELECT job_id FROM st WHERE status <> 'succeeded'")
def job_short_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _status(spark, sf_dir)
    return jobs.unfinished(status.select("job_id"), status.select("job_id", "status"))


@BOOK.query(
    """WITH t AS (SELECT DISTINCT user_id, event_id, epoch_us(ts) / 1e6 AS x FROM events) SELECT event_type, round(avg(value), 6) AS avg_seconds, round(max(value), 6) AS max_seconds, round(min(value), 6) AS min_seconds, round(sum(value), 4) AS total_seconds, count(value) AS count FROM events GROUP BY event_type"""
)
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.timing_stats(_events(spark, sf_dir), ["event_type"], "value")
    return got.select("event_type", *(F.round(c, 6).alias(c) for c in ("avg_seconds", "max_seconds", "min_seconds")), F.round("total_seconds", 4).alias("total_seconds"), "count")


@BOOK.query(
    "WITH b AS (SELECT unnest([" + ", ".join(f"{b}" for b in metrics.BUCKETS) + "])::DOUBLE AS le) SELECT event_type, le::VARCHAR AS le, count(*) FILTER (WHERE value / 100 <= le) AS count FROM events, b GROUP BY ALL UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type"
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_events(spark, sf_dir).withColumn("s", F.col("value") / 100), ["event_type"], "s")


@BOOK.query("SELECT 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def counter_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.exposition(metrics.counters(_events(spark, sf_dir), ["event_type"]), "requests_total", ["event_type"])


@BOOK.query("SELECT user_id, count(*) AS files_seen, count(*) FILTER (WHERE event_id % 3 > 0) AS files_added, count(*) FILTER (WHERE event_id % 3 > 0) AS files_modified, sum(event_id % 7)::BIGINT AS chunks_added, sum(event_id % 2)::BIGINT AS chunks_deleted FROM events GROUP BY user_id")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return metrics.job_totals(e.select("user_id", (F.col("event_id") % 3 > 0).alias("indexed"), (F.col("event_id") % 7).alias("chunks_added"), (F.col("event_id") % 2).alias("chunks_deleted")), ["user_id"])


@BOOK.query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls a day and user; each decision rests on those before, which SQL does not express."""
    e = _events(spark, sf_dir).select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("now"))
    return ratelimit.limit(e, 2, 86400.0, key="user_id", order="event_id").select(F.col("call_id").alias("event_id"), "key", "allowed")
