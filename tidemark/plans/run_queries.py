"""Batches, the numbered log, jobs and whole runs, over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import runs
from tidemark.plans import store_queries as Q
from tidemark.plans import track_queries as W
from tidemark.plans import registry
from tidemark.plans.registry import query, r6, table
from tidemark.sources.stash import shared_dir
from tidemark.sources.store import Batches, EventLog


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/runs/{name}-{uuid.uuid4().hex}"


@query("b9_batch_insert", "SELECT o_custkey AS job_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def batch_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows sent in four batches, one of them twice."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("job_id"))
    out = Batches(spark, place(spark, "batches"))
    for k in (0, 1, 2, 1, 3):
        out.insert(f"b{k}", {"rows": orders.where(F.col("o_orderkey") % 4 == k)})
    return out.table("rows").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("b10_artifact_index", "WITH " + Q.ARTIFACTS + " SELECT job_id, kind, count(*) AS n, max(filename) AS last FROM artifacts GROUP BY 1, 2")
def artifact_index(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts appended to their index by kind; the second half of a kind's batch is sent again with the first."""
    a = Q.artifacts(spark, d)
    out = Batches(spark, place(spark, "artifacts"))
    for k, kind in enumerate(("upload_image", "upload_table", "track", "track")):
        rows = a.where(F.col("kind") == kind)
        out.insert(f"artifacts-{kind}", {"artifacts": rows.where("nr % 2 = 0") if k == 2 else rows})
    return out.table("artifacts").groupBy("job_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("filename").alias("last"))


@query("k1_two_writers", "SELECT user_id AS job_id, count(*) AS n, count(*) AS last_seq, count(*) AS numbers FROM events GROUP BY 1")
def two_writers(spark: SparkSession, d: str) -> DataFrame:
    """Two writers append to the same jobs; the second commits while the first has numbered its events already."""
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("type"), F.col("event_id").cast("string").alias("payload"), "event_id")
    log = EventLog(spark, place(spark, "log"))
    kinds = tuple(r[0] for r in e.select("type").distinct().collect())  # few by design
    log.append(e.where("event_id % 3 = 0"), ["event_id"], kinds)
    turn = iter([1])

    def other() -> None:
        if next(turn, None):
            log.append(e.where("event_id % 3 = 1"), ["event_id"], kinds)

    log.append(e.where("event_id % 3 = 2"), ["event_id"], kinds, before=other)
    return log.events().groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), F.count_distinct("seq").alias("numbers"))


@query("n2_job_insert", "SELECT o_orderkey AS job_id, o_custkey AS owner, CASE WHEN o_orderkey % 5 = 0 THEN 'renamed ' || o_orderkey ELSE o_orderpriority END AS run_name, CASE WHEN o_orderkey % 3 = 0 THEN 'in_progress' ELSE 'queued' END AS status FROM orders")
def job_insert(spark: SparkSession, d: str) -> DataFrame:
    """Jobs inserted twice over, some renamed, some started: all from the log."""
    o = table(spark, d, "orders")
    jobs = runs.Jobs(spark, place(spark, "jobs"))
    rows = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("run_name"), F.lit("{}").alias("config"))
    jobs.create_all(rows.where("job_id % 2 = 0"))
    jobs.create_all(rows)
    said = lambda kind, key, value, keep: rows.where(keep).select("job_id", F.lit(kind).alias("type"), F.to_json(F.struct(value.alias(key))).alias("payload"), F.lit(0).alias("n"))
    jobs.log.append(said(runs.RENAMED, "run_name", F.concat(F.lit("renamed "), F.col("job_id").cast("string")), "job_id % 5 = 0"), ["n"], (runs.RENAMED,))
    jobs.log.append(said(runs.STATUS, "status", F.lit("in_progress"), "job_id % 3 = 0"), ["n"], (runs.STATUS,))
    return jobs.table().select("job_id", "owner", "run_name", "status")


def resumed(spark: SparkSession, d: str) -> tuple[runs.Jobs, Batches]:
    """A run over all tracks that dies after one of four batches, and goes on to the end."""
    jobs = runs.Jobs(spark, place(spark, "run"))
    jobs.create_all(spark.range(1).select(F.lit(1).cast("long").alias("job_id"), F.lit(1).cast("long").alias("owner"), F.lit("run").alias("run_name"), F.lit("{}").alias("config")))
    over = {"peaks": {"prominence": W.PROMINENCE}, "period": {"min_freq": W.LEAST, "max_freq": W.MOST}, "io": {"sampling_rate": W.RATE}}
    try:
        runs.run_job(jobs, 1, W.tracks(spark, d), 4, over, "line", stop_after=1)
    except runs.Stopped:
        pass
    return jobs, runs.run_job(jobs, 1, W.tracks(spark, d), 4, over, "line")


@query("m_run_resume", registry.SQL["h3_process_track"])
def run_resume(spark: SparkSession, d: str) -> DataFrame:
    """The track rows of a run that died and went on."""
    rows = resumed(spark, d)[1].table("tracks")
    return rows.select("track_index", "x0", "y0", "points", r6("amplitude"), "num_peaks", r6("frequency"), r6("period"))
