"""The event log as a stream, run over all files that are there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query, r6
from tidemark.streaming import events as E


@query("k2_live_tail", "SELECT user_id AS job_id, event_id AS seq, event_type AS type FROM events WHERE event_id > 100")
def live_tail(spark: SparkSession, d: str) -> DataFrame:
    return E.drain(E.tail(E.event_stream(spark, d, 1), 100).select("job_id", "seq", "type"), "tail")


@query("k3_resume_by_cursor", "SELECT user_id AS job_id, event_id AS seq FROM events")
def resume(spark: SparkSession, d: str) -> DataFrame:
    """A second run with the same checkpoint adds nothing that the first has written."""
    at = uuid.uuid4().hex
    E.drain(E.event_stream(spark, d).select("job_id", "seq"), "resume", at)
    return E.drain(E.event_stream(spark, d).select("job_id", "seq"), "resume", at)


@query("k4_event_dispatch", "SELECT user_id AS job_id, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    return E.newest(E.drain(E.by_type(E.event_stream(spark, d)), "dispatch", mode="update"), ["job_id", "type"])


@query("k5_stateful_upsert", "SELECT user_id AS job_id, event_type AS type, max(event_id) AS seq, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2")
def stateful_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = E.drain(E.latest_state(E.event_stream(spark, d), ["job_id", "type"]), "upsert", mode="update")
    return E.newest(rows, ["job_id", "type"]).select("job_id", "type", "seq", r6("value"))


def batch(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value", F.col("ts").cast("timestamp").alias("ts"))


@query("k6_progress_merge", "SELECT job_id, string_agg(type || '=' || CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY type) AS progress FROM (SELECT user_id AS job_id, event_type AS type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def progress_merge(spark: SparkSession, d: str) -> DataFrame:
    entries = F.transform(F.map_entries("progress"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 1000).cast("long").cast("string")))
    return E.progress(batch(spark, d)).select("job_id", F.array_join(entries, ",").alias("progress"))


@query("k6_progress_stream", "SELECT job_id, string_agg(type || '=' || CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY type) AS progress FROM (SELECT user_id AS job_id, event_type AS type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def progress_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same merge, kept as state of a stream."""
    merged = E.newest(E.drain(E.progress_stream(E.event_stream(spark, d)), "progress", mode="update"), ["job_id"])
    entries = F.transform(F.array_sort(F.map_entries("progress")), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 1000).cast("long").cast("string")))
    return merged.select("job_id", F.array_join(entries, ",").alias("progress"))


@query("k8_progress_stream")
def progress_cadence_stream(spark: SparkSession, d: str) -> DataFrame:
    return E.drain(E.paced_stream(E.event_stream(spark, d), 3600.0), "paced", mode="update").drop("batch")


@query("k8_progress_cadence")
def progress_cadence(spark: SparkSession, d: str) -> DataFrame:
    return E.paced(batch(spark, d), 3600.0)


@query("k_window_counts")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows with a watermark: what the log's own order doesn't need, but late files do."""
    rows = E.drain(E.windows(E.event_stream(spark, d)), "windows", mode="update")
    return E.newest(rows, ["start", "type"]).withColumn("total", F.round("total", 6))


@query("k_session_windows")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.last_batch(E.drain(E.sessions(E.event_stream(spark, d)), "sessions", mode="complete"))
