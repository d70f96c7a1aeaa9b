"""Run tables, filters and summaries. Orders stand for jobs, line items for artifacts, events for the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import relational as R
from tidemark.plans.registry import query, r6, table

JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS owner, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'cancelled' END AS status, o_orderpriority AS run_name, o_orderdate AS created_at FROM orders)"
ARTIFACTS = "artifacts AS (SELECT l_orderkey AS job_id, l_linenumber AS nr, CASE l_returnflag WHEN 'A' THEN 'upload_image' WHEN 'R' THEN 'upload_table' ELSE 'track' END AS kind, l_linestatus AS label, l_shipdate AS created_at, 'file_' || CAST(l_partkey AS VARCHAR) || '.csv' AS filename FROM lineitem)"
TRACKS = "tracks AS (SELECT event_id AS track_index, user_id % 40 AS points, user_id % 5 AS num_peaks, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS mean_amplitude, value / 100 AS dominant_frequency, value / 10 AS period, event_type AS sample FROM events)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("cancelled")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderpriority").alias("run_name"), F.col("o_orderdate").alias("created_at"))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "upload_image").when(F.col("l_returnflag") == "R", "upload_table").otherwise("track")
    name = F.concat(F.lit("file_"), F.col("l_partkey").cast("string"), F.lit(".csv"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("nr"), kind.alias("kind"), F.col("l_linestatus").alias("label"), F.col("l_shipdate").alias("created_at"), name.alias("filename"))


def overlay_tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("track_index"), (F.col("user_id") % 40).alias("points"), (F.col("user_id") % 5).alias("num_peaks"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("mean_amplitude"),
        (F.col("value") / 100).alias("dominant_frequency"), (F.col("value") / 10).alias("period"), F.col("event_type").alias("sample"),
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value", "ts")


@query("a8_axis_order", "SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN CASE WHEN c_nationkey % 3 = 1 THEN 'xy' ELSE 'yx' END WHEN c_mktsegment = 'BUILDING' THEN 'yx' ELSE 'xy' END AS axis_order FROM customer")
def axis_order(spark: SparkSession, d: str) -> DataFrame:
    set_ = F.when(F.col("c_nationkey") % 3 == 1, "xy").when(F.col("c_nationkey") % 3 == 2, "yx").otherwise("auto")
    backend = F.when(F.col("c_mktsegment") == "BUILDING", "onnx").otherwise("other")
    return table(spark, d, "customer").select("c_custkey", F.when(set_ != "auto", set_).when(backend == "onnx", "yx").otherwise("xy").alias("axis_order"))


@query("a9_track_discovery", "SELECT l_orderkey AS job_id, CAST(l_partkey AS VARCHAR) || '.npy' AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_partkey AS VARCHAR) || '.npy', l_linenumber) - 1 AS track_index FROM lineitem")
def track_discovery(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.col("l_partkey").cast("string"), F.lit(".npy"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(path, "l_linenumber")) - 1
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), path.alias("path"), nth.alias("track_index"))


@query("a10_upload_routing", "SELECT p_partkey, p_partkey % 4 = 0 OR p_size % 3 = 0 AS is_image FROM part")
def upload_routing(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 4 == 0, "image/x-any").when(F.col("p_partkey") % 4 == 1, "text/csv")
    file = F.concat(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, ".TIFF").otherwise(".csv"))
    return table(spark, d, "part").select("p_partkey", S.is_image(kind, file).alias("is_image"))


@query("a14_relational_scan", "WITH " + JOBS + " SELECT job_id, status FROM jobs")
def relational_scan(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("job_id", "status")


@query("c1_ownership_filter", "WITH " + JOBS + " SELECT job_id, owner FROM jobs WHERE owner = 37")
def ownership(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("owner = 37").select("job_id", "owner")


@query("c2_status_filter", "WITH " + JOBS + " SELECT job_id, status FROM jobs WHERE status IN ('failed', 'cancelled') AND created_at IS NOT NULL")
def status_filter(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where(F.col("status").isin("failed", "cancelled") & F.col("created_at").isNotNull()).select("job_id", "status")


def optional(df: DataFrame, **wanted) -> DataFrame:
    for c, v in wanted.items():
        df = df if v is None else df.where(F.col(c) == v)
    return df


@query("c3_optional_filter", "WITH " + ARTIFACTS + " SELECT job_id, nr, kind FROM artifacts WHERE kind = 'track'")
def optional_filter(spark: SparkSession, d: str) -> DataFrame:
    return optional(artifacts(spark, d), kind="track", label=None).select("job_id", "nr", "kind")


RULES = [("mean_amplitude", ">=", "5", None), ("points", "between", "30", "4"), ("sample", "contains", "I", None), ("period", "<", "oops", None), ("num_peaks", "!=", "3", None)]


@query("c4_rule_filter", "WITH " + TRACKS + " SELECT track_index FROM tracks WHERE coalesce(mean_amplitude, 0) >= 5 AND points BETWEEN 4 AND 30 AND contains(lower(sample), 'i') AND num_peaks <> 3")
def rule_filter(spark: SparkSession, d: str) -> DataFrame:
    return R.apply_rules(overlay_tracks(spark, d), RULES).select("track_index")


@query("c4a_rule_edges", "WITH " + TRACKS + " SELECT track_index FROM tracks WHERE coalesce(mean_amplitude, 0) <= 1")
def rule_edges(spark: SparkSession, d: str) -> DataFrame:
    """A null field compares as 0; empty, invalid and half-given rules pass everything."""
    edges = [("mean_amplitude", "<=", "1"), ("period", ">", ""), ("points", "between", "3", None), ("nothing", "==", "1"), ("sample", "starts", "x"), ("sample", "contains", "")]
    return R.apply_rules(overlay_tracks(spark, d), edges).select("track_index")


@query("e3_summary_stats", "WITH " + TRACKS + " SELECT count(*) AS count, CAST(sum(points) AS BIGINT) AS points, round(avg(coalesce(mean_amplitude, 0)), 6) AS avg_amplitude, round(avg(dominant_frequency), 6) AS avg_frequency FROM tracks WHERE num_peaks > 1")
def summary(spark: SparkSession, d: str) -> DataFrame:
    s = R.summary(R.apply_rules(overlay_tracks(spark, d), [("num_peaks", ">", "1")]))
    return s.select("count", "points", r6("avg_amplitude"), r6("avg_frequency"))


@query("c18_index_slice", "SELECT event_id FROM events WHERE event_id BETWEEN 20 AND 70")
def index_slice(spark: SparkSession, d: str) -> DataFrame:
    """'70:20': ends in any order, clamped, inclusive."""
    lo, hi = sorted(int(x) for x in "70:20".split(":"))
    return table(spark, d, "events").where(F.col("event_id").between(max(0, lo), hi)).select("event_id")


@query("c19_coordinate_map", "SELECT event_id, round(CASE WHEN user_id % 2 = 0 AND coalesce(nullif(user_id % 3, 0), nullif(user_id % 5, 0)) > 0 THEN coalesce(nullif(user_id % 3, 0), nullif(user_id % 5, 0)) - 1 - value ELSE value END, 6) AS y FROM events")
def coordinate_map(spark: SparkSession, d: str) -> DataFrame:
    height = F.coalesce(F.nullif(F.col("user_id") % 3, F.lit(0)), F.nullif(F.col("user_id") % 5, F.lit(0)))
    lower = F.col("user_id") % 2 == 0
    return table(spark, d, "events").select("event_id", r6(F.when(lower & (height > 0), height - 1 - F.col("value")).otherwise(F.col("value")), "y"))


@query("c21_overlay_payload", "SELECT CAST(event_id AS DOUBLE) AS track_index, event_type AS sample, CASE WHEN user_id % 3 <> 0 THEN round(value, 6) END AS mean_amplitude, CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE round(value, 6) END AS dominant_frequency, CAST(2 AS INTEGER) AS num_peaks, CAST(1 AS INTEGER) AS points FROM events WHERE user_id % 7 <> 0")
def overlay_payload(spark: SparkSession, d: str) -> DataFrame:
    """Track events as JSON, with peaks and points that lack a coordinate or hold text in its place."""
    amp = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(', "amp": '), F.col("value").cast("string"))).otherwise("")
    freq = F.when(F.col("user_id") % 4 == 0, "null").otherwise(F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
    index = F.when(F.col("user_id") % 7 == 0, F.lit('"none"')).otherwise(F.col("event_id").cast("string"))
    text = F.concat(
        F.lit('{"track_index": '), index, F.lit(', "sample": "'), F.col("event_type"), F.lit('", "freq_hz": '), freq, F.lit(', "poly": [{"x": 1, "y": 2.5}, {"x": "?", "y": 1}, {"y": 2}, 5]'),
        F.lit(', "peaks": [{"x": 1, "y": 2'), amp, F.lit('}, {"x": null, "y": 3}, {"x": "oops", "y": 0, "amp": 4}]}'),
    )
    t = table(spark, d, "events").select(R.overlay_tracks(text).alias("t")).where("t IS NOT NULL").select("t.*")
    return t.select("track_index", "sample", r6("mean_amplitude"), r6("dominant_frequency"), "num_peaks", F.size("poly").alias("points"))


@query("c22_artifact_filter", "WITH " + ARTIFACTS + ", a AS (SELECT job_id, split_part(filename, '_', 2) AS label, filename, created_at, nr FROM artifacts WHERE kind <> 'track' AND NOT ends_with(filename, '9.csv')) SELECT job_id, label, arg_max(filename, (created_at, nr)) AS url FROM a GROUP BY 1, 2")
def artifact_filter(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).where((F.col("kind") != "track") & ~F.col("filename").endswith("9.csv"))
    a = a.withColumn("label", F.element_at(F.split("filename", "_"), 2)).withColumn("url", F.col("filename"))
    return R.latest(a, ["job_id", "label"], "url", ["created_at", "nr"])


@query("c23_hover_projection", "SELECT event_id, CAST(least(greatest(floor(value), 0), 79) AS INTEGER) AS col, CAST(49 - least(greatest(floor(value / 2), 0), 49) AS INTEGER) AS row FROM events")
def hover(spark: SparkSession, d: str) -> DataFrame:
    clamp = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1)).cast("int")
    return table(spark, d, "events").select("event_id", clamp(F.col("value"), 80).alias("col"), (49 - clamp(F.col("value") / 2, 50)).alias("row"))


@query("d8_job_list", "WITH " + JOBS + " SELECT job_id, created_at FROM jobs WHERE owner % 2 = 1 ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 20")
def job_list(spark: SparkSession, d: str) -> DataFrame:
    return R.page(jobs(spark, d).where("owner % 2 = 1"), [F.desc("created_at"), F.asc("job_id")], 20, 50).select("job_id", "created_at")


@query("d9_latest_upload", "WITH " + JOBS + ", " + ARTIFACTS + ", l AS (SELECT job_id, filename, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, nr DESC, filename DESC) AS k FROM artifacts WHERE kind <> 'track') SELECT j.job_id, l.filename FROM jobs j LEFT JOIN l ON l.job_id = j.job_id AND l.k = 1")
def latest_upload(spark: SparkSession, d: str) -> DataFrame:
    up = R.latest(artifacts(spark, d).where("kind <> 'track'"), ["job_id"], "filename", ["created_at", "nr", "filename"])
    return jobs(spark, d).select("job_id").join(up, "job_id", "left")


@query("d10_next_seq", "SELECT user_id AS job_id, max(event_id) + 1 AS next_seq FROM events GROUP BY 1")
def next_seq(spark: SparkSession, d: str) -> DataFrame:
    return R.next_seq(log(spark, d))


@query("d11_events_after_cursor", "SELECT user_id AS job_id, event_id AS seq, event_type AS type FROM events WHERE user_id = 3 AND event_id > 100 ORDER BY event_id LIMIT 500")
def after_cursor(spark: SparkSession, d: str) -> DataFrame:
    return R.events_after(log(spark, d), 3, 100).select("job_id", "seq", "type")


@query("d12_list_artifacts", "WITH " + ARTIFACTS + " SELECT job_id, nr, filename FROM artifacts WHERE kind = 'upload_table' ORDER BY created_at DESC, job_id, nr LIMIT 200")
def list_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return R.page(artifacts(spark, d).where("kind = 'upload_table'"), [F.desc("created_at"), F.asc("job_id"), F.asc("nr")], 0, 200).select("job_id", "nr", "filename")


@query("d13_resume_skip", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def resume_skip(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(done, "l_orderkey", "left_anti")


@query("d14_cascade_delete", "SELECT 'jobs' AS name, count(*) AS rows FROM orders WHERE o_custkey <> 37 UNION ALL SELECT 'artifacts', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 37)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = jobs(spark, d).where("owner = 37").select("job_id")
    left = R.cascade(gone, "job_id", jobs=(jobs(spark, d), "job_id"), artifacts=(artifacts(spark, d), "job_id"))
    out = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in left.items()]
    return out[0].unionByName(out[1])


@query("d15_first_upload", "WITH " + ARTIFACTS + " SELECT job_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, nr, filename) AS k FROM artifacts WHERE kind IN ('upload_image', 'upload_table')) WHERE k = 1")
def first_upload(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d)
    both = a.where("kind = 'upload_image'").unionByName(a.where("kind = 'upload_table'"))
    return both.groupBy("job_id").agg(F.min_by("filename", F.struct("created_at", "nr", "filename")).alias("filename"))


@query("d16_has_upload", "WITH " + JOBS + ", " + ARTIFACTS + " SELECT job_id FROM jobs WHERE job_id IN (SELECT job_id FROM artifacts WHERE kind <> 'track')")
def has_upload(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).select("job_id").join(artifacts(spark, d).where("kind <> 'track'"), "job_id", "left_semi")


@query("d17_row_sets", "WITH a AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type = 'view') SELECT user_id, v, true AS both_sets FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT user_id, v, false FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def row_sets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.floor("value").cast("long").alias("v"), "event_type")
    a, b = (e.where(F.col("event_type") == t).select("user_id", "v") for t in ("click", "view"))
    return a.intersect(b).withColumn("both_sets", F.lit(True)).unionByName(a.subtract(b).withColumn("both_sets", F.lit(False)))


@query("d19_top_k_mean", "SELECT user_id, round(avg(value), 6) AS mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS k FROM events) WHERE k <= 8 GROUP BY 1")
def top_k_mean(spark: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value")))
    return table(spark, d, "events").withColumn("k", k).where("k <= 8").groupBy("user_id").agg(r6(F.avg("value"), "mean"))


@query("d20_latest_by_key", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "events"), ["user_id", "event_type"], "value", ["event_id"])


@query("d21_page_slice", "WITH " + JOBS + " SELECT job_id FROM jobs WHERE job_id <> 5 ORDER BY created_at DESC, job_id LIMIT 12")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    return R.page(jobs(spark, d).where("job_id <> 5"), [F.desc("created_at"), F.asc("job_id")], 0, 12).select("job_id")


@query("d7_nearest_track", "WITH q AS (SELECT event_id AS q, value AS x, user_id % 50 AS y FROM events WHERE event_id % 100 = 0), p AS (SELECT event_id AS track, value AS x, user_id % 50 AS y FROM events), m AS (SELECT q, track, sqrt(power(q.x - p.x, 2) + power(q.y - p.y, 2)) AS dist FROM q JOIN p ON p.x BETWEEN q.x - 3 AND q.x + 3 AND p.y BETWEEN q.y - 3 AND q.y + 3 AND p.track <> q.q) SELECT q, round(min(dist), 6) AS dist FROM m WHERE dist <= 3 GROUP BY 1")
def nearest_track(spark: SparkSession, d: str) -> DataFrame:
    """Nearest within a radius: both sides are dealt into cells as wide as the radius, and a query meets nine cells."""
    from tidemark.operators.grid import nearest_within

    p = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id") % 50).cast("double").alias("y"))
    return nearest_within(p.where("event_id % 100 = 0").withColumnRenamed("event_id", "q"), p.withColumnRenamed("event_id", "track"), 3.0).select("q", r6("dist"))


@query("e1_counts", "SELECT o_orderkey AS job_id, count(l_orderkey) AS artifacts, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS tracks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def counts(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(F.col("kind") == "track").alias("tracks"))
    return jobs(spark, d).select("job_id").join(a, "job_id", "left").na.fill(0)


@query("e2_counter_totals", "SELECT l_orderkey AS job_id, count(*) AS done FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def counter_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count(F.lit(1)).alias("done"))


@query("e7_percentiles", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q, n: r6(F.percentile("value", F.lit(q)), n)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.05, "p5"), p(0.1, "p10"), p(0.95, "p95"))


@query("e18_histogram", "SELECT CAST(least(greatest(floor(value / 5), -1), 20) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.least(F.greatest(F.floor(F.col("value") / 5), F.lit(-1)), F.lit(20)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


EMA_SQL = "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda e, x: 0.2 * x + 0.8 * e), 6) AS rate FROM events GROUP BY 1"


@query("e21_ema_rate_all", EMA_SQL)
@query("e21_ema_rate", EMA_SQL)
def ema_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    return e.select("user_id", r6(R.ema(F.transform("l", lambda x: x["value"]), 0.2), "rate"))


SAMPLE_SQL = "SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296) % 10000000 AS sample_id FROM customer"


@query("h6_sample_id_all", SAMPLE_SQL)
@query("h6_sample_id", SAMPLE_SQL)
def sample_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.sample_id(F.col("c_name")).alias("sample_id"))


@query("h7_track_id", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS track_id FROM part")
def track_ids(spark: SparkSession, d: str) -> DataFrame:
    stem = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("t"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", S.track_id(stem).alias("track_id"))


@query("h8_json_sanitise", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{\"k\":\"' || event_type || '\"}' ELSE '{\"u\":' || CAST(user_id AS VARCHAR) || ',\"k\":\"' || event_type || '\"}' END AS payload FROM events")
def json_sanitise(spark: SparkSession, d: str) -> DataFrame:
    """NaN becomes null, and null fields are left out."""
    u = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double"))
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.when(~F.isnan(u), u.cast("long")).alias("u"), F.col("event_type").alias("k"))).alias("payload"))


@query("h9_finite_or_null", "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value FROM events")
def finite_or_null(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.tracks import finite

    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", finite(v).alias("value"))


@query("h10_sample_name", "SELECT c_custkey, 'run_' || CAST(c_nationkey AS VARCHAR) AS sample FROM customer")
def sample_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/data/run_"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "_heatmap").otherwise(""), F.lit("/tracks/1.npy"))
    return table(spark, d, "customer").select("c_custkey", S.sample_name(path).alias("sample"))


@query("b8_blob_path", "SELECT c_custkey, 'root/jobs/' || CAST(c_custkey AS VARCHAR) || '/track/' || CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(c_mktsegment, '[^a-zA-Z0-9._-]+', '_', 'g') || '/' ELSE '' END || regexp_replace(c_name || ' #1.npy', '[^a-zA-Z0-9._-]+', '_', 'g') AS path FROM customer")
def blob_path(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.blob_path("root", F.col("c_custkey"), F.lit("track"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.concat("c_name", F.lit(" #1.npy"))).alias("path"))


@query("b11_download_name", "SELECT event_id, replace(CASE WHEN event_id % 3 = 0 THEN 'track:' || CAST(user_id AS VARCHAR) ELSE event_type END, ':', '_') AS filename FROM events")
def download_name(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("track:"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", F.replace(F.coalesce(label, "event_type"), F.lit(":"), F.lit("_")).alias("filename"))


@query("n1_track_upsert", "SELECT coalesce(n.p_partkey, s.p_partkey) AS track_index, coalesce(n.size, s.p_size) AS size, coalesce(n.price, s.p_retailprice) AS price, CASE WHEN n.p_partkey IS NOT NULL AND s.p_partkey IS NOT NULL THEN 'new,old' WHEN n.p_partkey IS NOT NULL THEN 'new' ELSE 'old' END AS metrics, CASE WHEN n.p_partkey IS NOT NULL THEN 'n' ELSE 'o' END AS overlay FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) s FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 END AS size, p_retailprice * 2 AS price FROM part WHERE p_partkey % 2 = 0) n ON n.p_partkey = s.p_partkey")
def track_upsert(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    stored = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("track_index"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.create_map(F.lit("old"), F.lit(1)).alias("metrics"), F.lit("o").alias("overlay"))
    new = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("track_index"), F.when(F.col("p_size") > 25, F.col("p_size") + 100).alias("size"), (F.col("p_retailprice") * 2).alias("price"), F.create_map(F.lit("new"), F.lit(2)).alias("metrics"), F.lit("n").alias("overlay"))
    out = R.upsert(stored, new, ["track_index"], maps=["metrics"], replaced=["overlay"])
    return out.withColumn("metrics", F.array_join(F.array_sort(F.map_keys("metrics")), ","))


@query("n2_job_lookup", "WITH " + JOBS + " SELECT job_id, status, run_name FROM jobs WHERE job_id = 7")
def job_lookup(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).where("job_id = 7").select("job_id", "status", "run_name")


@query("n3_owned_artifact", "WITH " + JOBS + ", " + ARTIFACTS + " SELECT a.job_id, a.nr FROM artifacts a WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = a.job_id AND j.owner = 37)")
def owned_artifact(spark: SparkSession, d: str) -> DataFrame:
    return artifacts(spark, d).join(jobs(spark, d).where("owner = 37"), "job_id", "left_semi").select("job_id", "nr")


@query("n4_artifact_view", "WITH " + ARTIFACTS + " SELECT job_id, nr, '/api/jobs/' || CAST(job_id AS VARCHAR) || '/artifacts/' || CAST(nr AS VARCHAR) || '/download' AS url FROM artifacts")
def artifact_view(spark: SparkSession, d: str) -> DataFrame:
    return artifacts(spark, d).select("job_id", "nr", F.format_string("/api/jobs/%d/artifacts/%d/download", "job_id", "nr").alias("url"))


@query("n17_blob_uri_parse", "SELECT c_custkey, 'b' || CAST(c_nationkey AS VARCHAR) AS bucket, 'jobs/' || c_name AS path FROM customer")
def blob_uri(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat(F.lit("gs://b"), F.col("c_nationkey").cast("string"), F.lit("/jobs/"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract(uri, "^gs://([^/]+)/(.*)$", 1).alias("bucket"), F.regexp_extract(uri, "^gs://([^/]+)/(.*)$", 2).alias("path"))


@query("n20_sine_display_mask", "SELECT event_id, CASE WHEN event_id BETWEEN 10 AND 400 THEN value END AS shown FROM events")
def sine_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id").between(10, 400), F.col("value")).alias("shown"))


@query("n21_chart_domain", "SELECT event_type, min(value) AS low, max(value) AS high FROM events WHERE event_id % 9 <> 0 GROUP BY 1")
def chart_domain(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").withColumn("v", v).where(~F.isnan("v")).groupBy("event_type").agg(F.min("v").alias("low"), F.max("v").alias("high"))


@query("n22_nice_ticks", "WITH r AS (SELECT event_id, abs(value) + 0.01 AS span FROM events), m AS (SELECT *, power(10.0, floor(log10(span / 5))) AS p FROM r) SELECT event_id, round(p * CASE WHEN span / 5 / p <= 1 THEN 1 WHEN span / 5 / p <= 2 THEN 2 WHEN span / 5 / p <= 5 THEN 5 ELSE 10 END, 6) AS step FROM m")
def nice_ticks(spark: SparkSession, d: str) -> DataFrame:
    raw = (F.abs("value") + 0.01) / 5
    p = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    f = raw / p
    return table(spark, d, "events").select("event_id", r6(p * F.when(f <= 1, 1).when(f <= 2, 2).when(f <= 5, 5).otherwise(10), "step"))


@query("n23_display_peaks", "SELECT event_id, value FROM events WHERE event_id BETWEEN 50 AND 500 AND event_id % 6 <> 0")
def display_peaks(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_id") % 6 != 0, F.col("value"))
    return table(spark, d, "events").select("event_id", v.alias("value")).where(F.col("event_id").between(50, 500) & F.col("value").isNotNull())


@query("n25_job_actions", "WITH " + JOBS + " SELECT job_id, status IN ('queued', 'in_progress') AS can_cancel, status IN ('failed', 'cancelled') AS can_resume, status NOT IN ('queued', 'in_progress') AS can_delete FROM jobs")
def job_actions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return jobs(spark, d).select("job_id", s.isin("queued", "in_progress").alias("can_cancel"), s.isin("failed", "cancelled").alias("can_resume"), (~s.isin("queued", "in_progress")).alias("can_delete"))


@query("k1_append_events", "SELECT user_id AS job_id, event_id, coalesce((SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_id % 10 < 7), 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events e WHERE event_id % 10 >= 7")
def append_events(spark: SparkSession, d: str) -> DataFrame:
    """New events get the next numbers of their job."""
    e = log(spark, d)
    new = e.where("seq % 10 >= 7").select("job_id", F.col("seq").alias("event_id"))
    return R.number_events(e.where("seq % 10 < 7"), new, ["event_id"])


@query("k7_overlay_cadence", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n % 5 = 0")
def cadence(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("n", n).where("n % 5 = 0").select("user_id", "event_id")


@query("k9_bounded_history", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(200).select("event_id", "event_type")


@query("k10_job_state_machine")
def state_machine(spark: SparkSession, d: str) -> DataFrame:
    asked = F.element_at(F.array(*[F.lit(s) for s in ("in_progress", "completed", "failed", "cancelled", "queued")]), (F.col("event_id") % 5 + 1).cast("int"))
    return R.job_states(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), asked.alias("status")))
