"""A job of very many events is numbered by all tasks, a wave's windows are met without its fit, prominences are found once."""

import glob

from pyspark.sql import functions as F

from tidemark.operators import relational, tracks
from tidemark.sources import store


def test_one_jobs_events_are_written_by_several_tasks(spark, tmp_path):
    log = store.EventLog(spark, f"file://{tmp_path}")
    n, few = F.col("id"), spark.createDataFrame([(1, "a", "{}", 1), (None, "a", "{}", 2)], "job_id long, type string, payload string, n long")
    log.append(few, ["n"], ("a",), few=True)
    job = F.when(n % 1000 == 1, 2).when(n % 1000 == 2, 3).otherwise(1).cast("long")
    new = spark.range(20_000, numPartitions=8).select(job.alias("job_id"), F.lit("b").alias("type"), F.repeat(n.cast("string"), 100).alias("payload"), (-n).alias("n"))
    keep, spark_conf = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf
    spark_conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert log.append(new, ["n"], ("b",)) == 1
    finally:
        spark_conf.set("spark.sql.adaptive.enabled", keep)
    assert max(len(glob.glob(f"{tmp_path}/rows/{at}/*.parquet")) for at in (p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/rows/*"))) > 1
    want = relational.number_events(few.select("job_id", F.lit(1).alias("seq")), new, ["n"]).select("job_id", "payload", "seq")
    got = log.events(("b",)).select("job_id", "payload", "seq")
    assert got.count() == 20_000 and got.exceptAll(want.withColumn("seq", F.col("seq").cast("long"))).count() == 0


def test_prominences_are_found_once_and_windows_without_fit(spark, monkeypatch):
    found, whole = [], tracks.prominences
    monkeypatch.setattr(tracks, "prominences", lambda t: found.append(1) or whole(t))
    t = spark.range(3 * 40).select((F.col("id") % 3).alias("track_index"), F.floor(F.col("id") / 3).cast("int").alias("i"))
    res = tracks.detrend(t.withColumns({"frame": F.col("i").cast("double"), "position": 5 * F.sin(F.col("i") * 0.7 + F.col("track_index"))}))
    peaks, freq = tracks.find_peaks(res, 1.0), tracks.dominant_frequency(res)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(found) == 1 and "collect_list" not in plan(peaks)
    # Sums of squares of the fit: once, not once for the windows and once for the rows.
    assert plan(tracks.wave_rows(res, peaks, freq)).count("AS fit_lo#") == plan(tracks.peak_rows(res, peaks, freq)).count("AS fit_lo#")
