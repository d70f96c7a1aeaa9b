"""Progress as a stream: any cut into micro-batches gives the rows of the batch version."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events as E


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out, t, seq = [], {j: 1e9 for j in range(6)}, {j: 0 for j in range(6)}
    for _ in range(900):
        j = min(r.randrange(9), 5)  # job 5 has a third
        t[j] += r.choice([0.0, 0.3, 1.0, 2.0, 5.0])
        seq[j] += 1
        out.append((j, seq[j], r.choice("abc"), r.random(), t[j]))
    return out


def stream_of(spark, rows, folder, files):
    import os
    import time

    schema = "user_id long, event_id long, event_type string, value double, t double"
    cut = len(rows) // files + 1
    for k in range(files):
        spark.createDataFrame(rows[k * cut : (k + 1) * cut], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.parquet(f"{folder}/events-{k:03d}.parquet")
        now = time.time() - 1000 + k
        for name in os.listdir(f"{folder}/events-{k:03d}.parquet"):
            os.utime(f"{folder}/events-{k:03d}.parquet/{name}", (now, now))
    schema = spark.read.parquet(f"{folder}/events-000.parquet").schema
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    return s.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value", "ts")


def batch_of(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, seq long, type string, value double, t double")
    return df.withColumn("ts", F.timestamp_seconds("t"))


@pytest.mark.parametrize("files", [1, 4])
def test_paced_stream_equals_batch(spark, rows, tmp_path, files):
    got = E.drain(E.paced_stream(stream_of(spark, rows, str(tmp_path), files), 2.0), "t-paced", mode="update").drop("batch")
    plain = lambda df: sorted((r["job_id"], r["seq"], r["done"], round(r["rate"], 9)) for r in df.collect())
    assert plain(got) == plain(E.paced(batch_of(spark, rows), 2.0)) and got.count() > 50


def test_progress_stream_equals_batch(spark, rows, tmp_path):
    late = rows[300:] + rows[:300]  # the first third comes last and may replace nothing newer
    updates = E.drain(E.progress_stream(stream_of(spark, late, str(tmp_path), 3)), "t-progress", mode="update")
    got = {r["job_id"]: r["progress"] for r in E.newest(updates, ["job_id"]).collect()}
    assert got == {r["job_id"]: r["progress"] for r in E.progress(batch_of(spark, rows)).collect()}
    assert updates.select("batch").distinct().count() == 3


def test_idle_jobs_are_forgotten(spark, tmp_path):
    """Job 1 is silent for a day, in which job 2 moves the watermark; then its count begins anew."""
    day = 86400.0
    rows = [(1, 1, "a", 1.0, 0.0), (1, 2, "a", 1.0, 10.0), (2, 1, "a", 1.0, 3 * day), (2, 2, "a", 1.0, 3 * day + 1), (2, 3, "a", 1.0, 3 * day + 2), (2, 4, "a", 1.0, 3 * day + 3), (1, 3, "a", 1.0, 4 * day), (1, 4, "a", 1.0, 4 * day + 10)]
    rows = [(*r[:4], r[4] + 1e9) for r in rows]
    got = E.drain(E.paced_stream(stream_of(spark, rows, str(tmp_path), 3), 5.0, idle="1 day"), "t-idle", mode="update")
    assert sorted((r["job_id"], r["seq"], r["done"]) for r in got.collect()) == [(1, 2, 2), (1, 4, 2)]
    kept = E.drain(E.paced_stream(stream_of(spark, rows, str(tmp_path / "again"), 3), 5.0), "t-kept", mode="update")
    assert sorted((r["job_id"], r["seq"], r["done"]) for r in kept.collect()) == [(1, 2, 2), (1, 3, 3), (1, 4, 4)]
