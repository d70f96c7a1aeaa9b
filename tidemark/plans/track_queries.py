"""Track analytics over the embedding arrays (64 samples a track) and over users' events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import tracks as T
from tidemark.plans.registry import query, r6, table
from tidemark.sources.stash import stash

SCALE, RATE, LEAST, MOST, PROMINENCE, FRAC = 100.0, 1.0, 0.02, 0.45, 8.0, 0.5

TR = """
WITH tr0 AS (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings),
tr AS (SELECT CAST(vec_id AS BIGINT) AS track_index, CAST(i AS INTEGER) AS i, CAST(i AS DOUBLE) AS frame, CAST(embedding[i + 1] AS DOUBLE) * 100.0 AS position FROM tr0)"""
RES = TR + """,
res AS (SELECT *, position - (avg(position) OVER w + coalesce(regr_slope(position, frame) OVER w, 0) * (frame - avg(frame) OVER w)) AS residual,
        avg(position) OVER w + coalesce(regr_slope(position, frame) OVER w, 0) * (frame - avg(frame) OVER w) AS baseline
        FROM tr WINDOW w AS (PARTITION BY track_index))"""
SPEC = RES + """,
m AS (SELECT *, residual - avg(residual) OVER (PARTITION BY track_index) AS x, count(*) OVER (PARTITION BY track_index) AS n FROM res),
spec AS (SELECT track_index, k, k * 1.0 / n AS frequency, sqrt(power(sum(x * cos(2 * pi() * k * i / n)), 2) + power(sum(x * sin(2 * pi() * k * i / n)), 2)) AS magnitude
         FROM m, (SELECT unnest(range(33)) AS k) ks WHERE k <= n // 2 GROUP BY track_index, k, n),
best AS (SELECT track_index, frequency, row_number() OVER (PARTITION BY track_index ORDER BY round(magnitude, 9) DESC, k) AS nth FROM spec WHERE k > 0 AND frequency >= 0.02 AND frequency <= 0.45),
freq AS (SELECT track_index, least(greatest(frequency, 0.02), 0.45) AS frequency FROM best WHERE nth = 1)"""
PROM = """,
lm AS (SELECT *, lag(residual) OVER w AS b, lead(residual) OVER w AS a FROM res WINDOW w AS (PARTITION BY track_index ORDER BY i)),
pk0 AS (SELECT track_index, i AS peak_i, frame, position, residual FROM lm WHERE residual > b AND residual > a),
bases AS (SELECT p.track_index, p.peak_i, p.frame, p.position, p.residual, max(CASE WHEN s.residual > p.residual AND s.i < p.peak_i THEN s.i END) AS l,
          min(CASE WHEN s.residual > p.residual AND s.i > p.peak_i THEN s.i END) AS r FROM pk0 p JOIN res s ON p.track_index = s.track_index GROUP BY ALL),
prom AS (SELECT b.track_index, b.peak_i, b.frame, b.position, b.residual, b.residual - greatest(min(CASE WHEN s.i <= b.peak_i AND s.i > coalesce(b.l, -1) THEN s.residual END),
         min(CASE WHEN s.i >= b.peak_i AND s.i < coalesce(b.r, 1000000) THEN s.residual END)) AS prominence FROM bases b JOIN res s ON b.track_index = s.track_index GROUP BY b.track_index, b.peak_i, b.frame, b.position, b.residual)"""
PEAKS = PROM + """,
kept AS (SELECT *, false AS fallback_peak FROM prom WHERE prominence >= 8.0),
spare AS (SELECT track_index, i AS peak_i, frame, position, residual, residual - median(residual) OVER (PARTITION BY track_index) AS prominence, true AS fallback_peak,
          row_number() OVER (PARTITION BY track_index ORDER BY residual DESC, i) AS nth FROM res WHERE track_index NOT IN (SELECT track_index FROM kept)),
allp AS (SELECT * FROM kept UNION ALL SELECT track_index, peak_i, frame, position, residual, prominence, fallback_peak FROM spare WHERE nth = 1),
nb AS (SELECT *, row_number() OVER w AS peak_ord, lag(peak_i) OVER w AS prev_i, lead(peak_i) OVER w AS next_i, lag(frame) OVER w AS prev_frame, lead(frame) OVER w AS next_frame FROM allp WINDOW w AS (PARTITION BY track_index ORDER BY peak_i)),
peaks AS (SELECT *, coalesce((abs(frame - prev_frame) + abs(next_frame - frame)) / 2, abs(frame - prev_frame), abs(next_frame - frame)) AS local_period FROM nb)"""
ANG = """,
ang AS (SELECT *, CASE WHEN lag(frame) OVER w IS NOT NULL THEN atan(abs(CASE WHEN frame <> lag(frame) OVER w THEN (position - lag(position) OVER w) / (frame - lag(frame) OVER w) ELSE 0 END)) END AS angle
        FROM res WINDOW w AS (PARTITION BY track_index ORDER BY i))"""


def fit_sql(source: str) -> str:
    """CTE fit over a CTE with track_index, peak_i, frame, residual, fit_freq."""
    return f""",
span AS (SELECT p.*, greatest(0, peak_i - greatest(1, CAST(round_even(0.5 * (1.0 / fit_freq) / 2, 0) AS INTEGER))) AS fit_lo, least((SELECT max(i) FROM res r WHERE r.track_index = p.track_index), peak_i + greatest(1, CAST(round_even(0.5 * (1.0 / fit_freq) / 2, 0) AS INTEGER))) AS fit_hi FROM {source} p),
met AS (SELECT p.track_index, p.peak_i, p.residual AS r0, p.fit_lo, s.i, s.frame AS f, s.position AS pos, s.residual AS r, s.angle, cos(2 * pi() * p.fit_freq * (s.frame - p.frame)) - 1 AS z, s.residual - p.residual AS d FROM span p JOIN ang s ON s.track_index = p.track_index AND s.i BETWEEN p.fit_lo AND p.fit_hi),
amp AS (SELECT track_index, peak_i, CASE WHEN sum(z * z) > 0 THEN sum(z * d) / sum(z * z) ELSE any_value(r0) END AS fit_amp FROM met GROUP BY 1, 2),
err AS (SELECT m.track_index, m.peak_i, CASE WHEN count(*) >= 2 AND var_pop(m.r) > 0 THEN avg(power(m.d - a.fit_amp * m.z, 2)) / var_pop(m.r) END AS fit_error, degrees(atan(abs(coalesce(regr_slope(m.pos, m.f), 0)))) AS fit_orientation,
        degrees(coalesce(stddev_pop(CASE WHEN m.i > m.fit_lo THEN m.angle END), 0)) AS fit_orientation_std FROM met m JOIN amp a USING (track_index, peak_i) GROUP BY 1, 2),
fit AS (SELECT p.*, a.fit_amp, p.residual - a.fit_amp AS fit_offset, e.fit_error, e.fit_orientation, e.fit_orientation_std FROM span p JOIN amp a USING (track_index, peak_i) JOIN err e USING (track_index, peak_i))"""


ROWS = """,
pf AS (SELECT p.*, f.frequency AS global_freq FROM peaks p JOIN freq f USING (track_index)),
pr AS (SELECT *, coalesce(CASE WHEN local_period > 0 THEN local_period END, 1.0 / global_freq) AS period_frames FROM pf)"""
LOCAL = ROWS + ", src AS (SELECT *, 1.0 / period_frames AS freq_hz, 1.0 / period_frames AS fit_freq FROM pr)"
GLOBAL = ROWS + ", src AS (SELECT *, 1.0 / period_frames AS freq_hz, global_freq AS fit_freq FROM pr)"
WIN = ROWS + """,
win AS (SELECT *, least(coalesce((prev_frame + frame) / 2, frame - period_frames / 2), coalesce((frame + next_frame) / 2, frame + period_frames / 2)) AS frame1,
        greatest(coalesce((prev_frame + frame) / 2, frame - period_frames / 2), coalesce((frame + next_frame) / 2, frame + period_frames / 2)) AS frame2 FROM pr)"""
WAVES = WIN + """,
src AS (SELECT * EXCLUDE (period_frames), frame2 - frame1 AS period_frames, coalesce(CASE WHEN frame2 > frame1 THEN 1.0 / (frame2 - frame1) END, global_freq) AS freq_hz,
        coalesce(CASE WHEN frame2 > frame1 THEN 1.0 / (frame2 - frame1) END, global_freq) AS fit_freq FROM win)""" + fit_sql("src") + """,
n_in AS (SELECT w.track_index, w.peak_i, count(*) AS n FROM win w JOIN res s ON s.track_index = w.track_index AND s.frame >= w.frame1 AND s.frame <= w.frame2 GROUP BY 1, 2),
seg AS (SELECT w.track_index, w.peak_i, s.i, s.frame, s.position, s.angle, min(s.i) OVER (PARTITION BY w.track_index, w.peak_i) AS first FROM win w JOIN n_in c USING (track_index, peak_i) JOIN ang s ON s.track_index = w.track_index
        AND CASE WHEN c.n >= 2 THEN s.frame >= w.frame1 AND s.frame <= w.frame2 ELSE abs(s.i - w.peak_i) <= 1 END),
box AS (SELECT track_index, peak_i, min(position) AS xmin, max(position) AS xmax, min(frame) AS ymin, max(frame) AS ymax, degrees(atan(abs(coalesce(regr_slope(position, frame), 0)))) AS orientation,
        degrees(coalesce(stddev_pop(CASE WHEN i > first THEN angle END), 0)) AS orientation_std FROM seg GROUP BY 1, 2),
ends AS (SELECT w.track_index, w.peak_i, max(CASE WHEN s.frame <= w.frame1 THEN s.frame END) AS l1, min(CASE WHEN s.frame >= w.frame1 THEN s.frame END) AS h1, max(CASE WHEN s.frame <= w.frame2 THEN s.frame END) AS l2,
         min(CASE WHEN s.frame >= w.frame2 THEN s.frame END) AS h2, min(s.frame) AS fmin, max(s.frame) AS fmax, any_value(w.frame1) AS frame1, any_value(w.frame2) AS frame2 FROM win w JOIN res s ON s.track_index = w.track_index GROUP BY 1, 2),
itp AS (SELECT e.track_index, e.peak_i, e.frame1 < e.fmin OR e.frame2 > e.fmax AS boundary,
        CASE WHEN l1 IS NULL THEN b1.position WHEN h1 IS NULL OR h1 = l1 THEN a1.position ELSE a1.position + (b1.position - a1.position) * (e.frame1 - l1) / (h1 - l1) END AS pos1,
        CASE WHEN l2 IS NULL THEN b2.position WHEN h2 IS NULL OR h2 = l2 THEN a2.position ELSE a2.position + (b2.position - a2.position) * (e.frame2 - l2) / (h2 - l2) END AS pos2
        FROM ends e LEFT JOIN res a1 ON a1.track_index = e.track_index AND a1.frame = l1 LEFT JOIN res b1 ON b1.track_index = e.track_index AND b1.frame = h1
        LEFT JOIN res a2 ON a2.track_index = e.track_index AND a2.frame = l2 LEFT JOIN res b2 ON b2.track_index = e.track_index AND b2.frame = h2),
waves AS (SELECT f.*, i.pos1, i.pos2, i.boundary, b.xmin, b.xmax, b.ymin, b.ymax, b.orientation, b.orientation_std, i.pos2 - i.pos1 AS delta_pos,
          CASE WHEN b.orientation <= 10 AND f.prominence >= 1 THEN 'ripple' WHEN b.orientation >= 20 THEN 'surf' ELSE 'ambiguous' END AS wave_type,
          CASE WHEN b.orientation <= 10 AND f.prominence >= 1 THEN greatest(0.0, least(1.0, f.prominence / (1 + 1e-6) * (1 - b.orientation / (10 + 1e-6)))) WHEN b.orientation >= 20 THEN greatest(0.0, least(1.0, (b.orientation - 20) / 70)) ELSE 0.5 END AS type_score
          FROM fit f JOIN itp i USING (track_index, peak_i) JOIN box b USING (track_index, peak_i))"""
BASE = SPEC + PEAKS + ANG


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SCALE)


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detrend(tracks(spark, sf_dir))


def analysed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Residuals, peaks, frequencies, each written once, since all rows come from all three."""
    res = stash(residuals(spark, sf_dir), "residuals")
    return res, stash(T.find_peaks(res, PROMINENCE), "peaks"), stash(T.dominant_frequency(res, RATE, LEAST, MOST), "frequencies")


WAVE_COLUMNS = ["frame1", "frame2", "period_frames", "freq_hz", "pos1", "pos2", "delta_pos", "velocity", "wavelength", "xmin", "xmax", "ymin", "ymax", "orientation", "orientation_std", "fit_amp", "fit_offset", "fit_error", "prominence", "type_score", "t_start", "t_end"]


@query(
    "h2_wave_rows", BASE + WAVES + " SELECT track_index, peak_ord AS wave_index, peak_i, CAST(round_even(position, 0) AS INTEGER) AS x, CAST(round_even(frame, 0) AS INTEGER) AS y, round(residual, 6) AS amplitude, round(frame1, 6) AS frame1, round(frame2, 6) AS frame2, round(period_frames, 6) AS period_frames, "
    "round(freq_hz, 6) AS freq_hz, round(pos1, 6) AS pos1, round(pos2, 6) AS pos2, round(delta_pos, 6) AS delta_pos, round(CASE WHEN period_frames <> 0 THEN delta_pos / period_frames END, 6) AS velocity, round(abs(delta_pos), 6) AS wavelength, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, "
    "round(ymin, 6) AS ymin, round(ymax, 6) AS ymax, round(orientation, 6) AS orientation, round(orientation_std, 6) AS orientation_std, round(fit_amp, 6) AS fit_amp, round(fit_offset, 6) AS fit_offset, round(fit_error, 6) AS fit_error, round(prominence, 6) AS prominence, round(type_score, 6) AS type_score, "
    "round(frame1, 6) AS t_start, round(frame2, 6) AS t_end, wave_type, boundary FROM waves",
)
def wave_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from arrays to one row per wave."""
    w = T.wave_rows(*analysed(spark, sf_dir), RATE, FRAC)
    return w.select("track_index", F.col("peak_ord").alias("wave_index"), "peak_i", F.bround("position").cast("int").alias("x"), F.bround("frame").cast("int").alias("y"), r6("residual", "amplitude"), *[r6(c) for c in WAVE_COLUMNS], "wave_type", "boundary")


PEAK_SELECT = " SELECT track_index, peak_ord AS peak_index, peak_i, frame AS pos, round(residual, 6) AS value, round(period_frames, 6) AS local_period_frames, round(freq_hz, 6) AS local_freq_hz, round(fit_amp, 6) AS fit_amp, round(fit_offset, 6) AS fit_offset, round(fit_error, 6) AS fit_error, fit_lo, fit_hi, round(fit_orientation, 6) AS orientation, round(fit_orientation_std, 6) AS orientation_std, round(prominence, 6) AS prominence, fallback_peak FROM fit"


def peak_select(p: DataFrame, *more: Column) -> DataFrame:
    return p.select(
        "track_index", F.col("peak_ord").alias("peak_index"), "peak_i", F.col("frame").alias("pos"), r6("residual", "value"), r6("period_frames", "local_period_frames"), r6("freq_hz", "local_freq_hz"), r6("fit_amp"), r6("fit_offset"), r6("fit_error"), "fit_lo", "fit_hi",
        r6("orientation"), r6("orientation_std"), r6("prominence"), "fallback_peak", *more,
    )


@query("h1_peak_rows", BASE + LOCAL + fit_sql("src") + PEAK_SELECT)
def peak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peak_select(T.peak_rows(*analysed(spark, sf_dir), RATE, FRAC, local=True))


@query("h5_track_detail", BASE + GLOBAL + fit_sql("src") + PEAK_SELECT + " WHERE track_index = 7")
def track_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track, recomputed from its samples with the global frequency; the id reaches the scan."""
    one = T.detrend(T.from_arrays(table(spark, sf_dir, "embeddings").where("vec_id = 7"), "vec_id", "embedding", SCALE))
    return peak_select(T.peak_rows(one, T.find_peaks(one, PROMINENCE), T.dominant_frequency(one, RATE, LEAST, MOST), RATE, FRAC, local=False))


@query("g21_anchored_sine_global", BASE + GLOBAL + fit_sql("src") + " SELECT track_index, peak_i, round(fit_amp, 6) AS fit_amp, round(fit_offset, 6) AS fit_offset, round(fit_amp + fit_offset, 6) AS at_peak FROM fit")
def sine_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.peak_rows(*analysed(spark, sf_dir), RATE, FRAC, local=False)
    return p.select("track_index", "peak_i", r6("fit_amp"), r6("fit_offset"), r6(F.col("fit_amp") + F.col("fit_offset"), "at_peak"))


@query("g22_fit_parameters", BASE + LOCAL + fit_sql("src") + " SELECT track_index, peak_i, fit_lo, fit_hi, round(fit_freq, 6) AS fit_freq, round(pi() / 2 - 2 * pi() * fit_freq * frame, 6) AS fit_phase, round(fit_error, 6) AS fit_error FROM fit")
def fit_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.peak_rows(*analysed(spark, sf_dir), RATE, FRAC).select("track_index", "peak_i", "fit_lo", "fit_hi", r6("fit_freq"), r6("fit_phase"), r6("fit_error"))


@query("h3_process_track", BASE + ", amp AS (SELECT track_index, avg(residual) AS amplitude, count(*) AS num_peaks FROM peaks GROUP BY 1), fst AS (SELECT track_index, arg_min(position, i) AS x, arg_min(frame, i) AS y, count(*) AS points FROM res GROUP BY 1) SELECT track_index, CAST(round_even(x, 0) AS INTEGER) AS x0, CAST(round_even(y, 0) AS INTEGER) AS y0, points, round(amplitude, 6) AS amplitude, num_peaks, round(frequency, 6) AS frequency, round(1 / frequency, 6) AS period FROM fst JOIN amp USING (track_index) JOIN freq USING (track_index)")
def process_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.track_rows(*analysed(spark, sf_dir), RATE).select("track_index", "x0", "y0", "points", r6("amplitude"), "num_peaks", r6("frequency"), r6("period"))


@query("a7_track_scan_1d", TR + " SELECT track_index, i, frame, round(position, 6) AS position FROM tr")
def track_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("track_index", "i", "frame", r6("position"))


@query("a7_track_scan_2d", "SELECT CAST(user_id AS BIGINT) AS track_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS DOUBLE) AS frame, round(value, 6) AS position FROM events")
def track_scan_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("track_index", F.col("i").cast("long").alias("i"), "frame", r6("position"))


@query("d18_stable_sort_by_frame", "WITH p AS (SELECT vec_id, embedding, unnest(range(len(embedding) // 2)) AS k FROM embeddings), q AS (SELECT CAST(vec_id AS BIGINT) AS track_index, k, round(CAST(embedding[2 * k + 1] AS DOUBLE) * 10) AS frame, CAST(embedding[2 * k + 2] AS DOUBLE) AS position FROM p) SELECT track_index, row_number() OVER (PARTITION BY track_index ORDER BY frame, k) - 1 AS i, frame, round(position, 6) AS position FROM q")
def stable_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda k: F.array(F.round(F.get("embedding", 2 * k).cast("double") * 10), F.get("embedding", 2 * k + 1).cast("double")))
    points = table(spark, sf_dir, "embeddings").select("vec_id", pairs.alias("points"))
    return T.from_points(points, "vec_id", "points", "yx").select("track_index", F.col("i").cast("long").alias("i"), "frame", r6("position"))


@query("g1_lsq_baseline", RES + " SELECT track_index, i, round(baseline, 6) AS baseline FROM res")
def lsq_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).select("track_index", "i", r6("baseline"))


@query("g3_detrend_residual", RES + " SELECT track_index, i, round(residual, 6) AS residual FROM res")
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).select("track_index", "i", r6("residual"))


@query("g4_detrend_table", RES + " SELECT track_index, i, frame, round(position, 6) AS position, round(residual, 6) AS residual FROM res")
def detrend_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).select("track_index", "i", "frame", r6("position"), r6("residual"))


@query("g1_quadratic_baseline", TR + """, c AS (SELECT *, frame - avg(frame) OVER (PARTITION BY track_index) AS x FROM tr),
s AS (SELECT track_index, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, count(*) AS n, sum(position) AS y0, sum(x*position) AS y1, sum(x*x*position) AS y2 FROM c GROUP BY 1),
k AS (SELECT *, (y2 * s2 - y1 * s3 - y0 * s2 * s2 / n) / (s4 * s2 - s3 * s3 - s2 * s2 * s2 / n) AS c2 FROM s)
SELECT c.track_index, c.i, round(k.y0 / k.n - k.c2 * k.s2 / k.n + (k.y1 - k.c2 * k.s3) / k.s2 * c.x + k.c2 * c.x * c.x, 6) AS baseline FROM c JOIN k USING (track_index)""")
def quadratic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detrend_quadratic(tracks(spark, sf_dir)).select("track_index", "i", r6("baseline"))


def gram_schmidt_sql(degree: int) -> str:
    """Powers of the frame made orthogonal to all before them, one window each."""
    ctes = ["c0 AS (SELECT *, (2 * frame - min(frame) OVER w - max(frame) OVER w) / (max(frame) OVER w - min(frame) OVER w) AS x, 1.0::DOUBLE AS p0 FROM tr WINDOW w AS (PARTITION BY track_index))"]
    for k in range(1, degree + 1):
        taken = " - ".join([f"power(x, {k})", *[f"sum(power(x, {k}) * p{j}) OVER w / sum(p{j} * p{j}) OVER w * p{j}" for j in range(k)]])
        ctes.append(f"c{k} AS (SELECT *, {taken} AS p{k} FROM c{k - 1} WINDOW w AS (PARTITION BY track_index))")
    base = " + ".join(f"sum(position * p{k}) OVER w / sum(p{k} * p{k}) OVER w * p{k}" for k in range(degree + 1))
    return TR + ", " + ", ".join(ctes) + f" SELECT track_index, i, round({base}, 6) AS baseline FROM c{degree} WINDOW w AS (PARTITION BY track_index)"


@query("g1_polynomial_baseline_3", gram_schmidt_sql(3))
def cubic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detrend_polynomial(tracks(spark, sf_dir), 3).select("track_index", "i", r6("baseline"))


@query("g1_polynomial_baseline_5", gram_schmidt_sql(5))
def quintic_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.detrend_polynomial(tracks(spark, sf_dir), 5).select("track_index", "i", r6("baseline"))


@query("g9_spectrum_table", SPEC + " SELECT track_index, k, frequency, round(magnitude, 6) AS magnitude FROM spec")
def spectrum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spectrum(residuals(spark, sf_dir)).select("track_index", "k", "frequency", r6("magnitude"))


@query("g5_dominant_frequency", SPEC + " SELECT track_index, frequency FROM freq")
def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dominant_frequency(residuals(spark, sf_dir), RATE, LEAST, MOST)


@query("g6_frequency_to_period", SPEC + " SELECT track_index, round(CASE WHEN frequency > 0 THEN 1 / frequency END, 6) AS period FROM freq")
def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant(spark, sf_dir).select("track_index", r6(F.when(F.col("frequency") > 0, 1 / F.col("frequency")), "period"))


@query("g7_resolve_frequency", "SELECT event_id, round(least(greatest(coalesce(CASE WHEN value > 60 THEN NULL WHEN value > 0 THEN value / 100 END, CASE WHEN user_id % 7 > 0 THEN 1.0 / (user_id % 7) END, 0.05), 0.05), 0.4), 6) AS frequency FROM events")
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    estimate = F.when(F.col("value") > 60, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    return e.select("event_id", r6(T.resolve_frequency(estimate, (F.col("user_id") % 7).cast("double"), 1.0, 0.05, 0.4), "frequency"))


@query("g8_period_from_residual", SPEC + " SELECT track_index, round(1 / frequency, 6) AS period FROM freq")
def period_from_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period(spark, sf_dir)


@query("g10_prominence", RES + PROM + " SELECT track_index, peak_i, round(residual, 6) AS residual, round(prominence, 6) AS prominence FROM prom WHERE prominence >= 8.0")
def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prominences(residuals(spark, sf_dir)).where(F.col("prominence") >= PROMINENCE).select("track_index", "peak_i", r6("residual"), r6("prominence"))


@query("g11_minimum_peak_guarantee", RES + PEAKS.replace(">= 8.0", ">= 40.0") + " SELECT track_index, peak_i, round(prominence, 6) AS prominence, fallback_peak FROM peaks")
def minimum_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.find_peaks(residuals(spark, sf_dir), 40.0).select("track_index", "peak_i", r6("prominence"), "fallback_peak")


@query("g12_adaptive_threshold", RES + PROM + ", md AS (SELECT track_index, median(residual) AS m FROM res GROUP BY 1), mad AS (SELECT r.track_index, median(abs(r.residual - m.m)) AS mad FROM res r JOIN md m USING (track_index) GROUP BY 1) SELECT p.track_index, p.peak_i, round(p.prominence, 6) AS prominence FROM prom p JOIN mad USING (track_index) WHERE round(p.prominence, 9) >= round(greatest(1.0, 2.0 * mad), 9)")
def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prominence of at least max(1, 2 MAD) per track."""
    res = residuals(spark, sf_dir)
    p = T.prominences(res).join(mads(res), "track_index")
    return p.where(F.round("prominence", 9) >= F.round(F.greatest(F.lit(1.0), 2 * F.col("mad")), 9)).select("track_index", "peak_i", r6("prominence"))


def mads(res: DataFrame) -> DataFrame:
    dev = res.select("track_index", F.abs(F.col("residual") - F.median("residual").over(T.track())).alias("d"))
    return dev.groupBy("track_index").agg(F.median("d").alias("mad"))


@query("e5_mad", RES + ", md AS (SELECT track_index, median(residual) AS m FROM res GROUP BY 1) SELECT r.track_index, round(median(abs(r.residual - m.m)), 6) AS mad FROM res r JOIN md m USING (track_index) GROUP BY 1")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mads(residuals(spark, sf_dir)).select("track_index", r6("mad"))


@query("e4_mean_amplitude", BASE + " SELECT track_index, round(avg(residual), 6) AS mean_amplitude FROM peaks GROUP BY 1")
def mean_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.find_peaks(residuals(spark, sf_dir), PROMINENCE).groupBy("track_index").agg(r6(F.avg("residual"), "mean_amplitude"))


@query("e6_median_gap", BASE + " SELECT track_index, peak_i, local_period AS gap FROM peaks")
def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.find_peaks(residuals(spark, sf_dir), PROMINENCE).select("track_index", "peak_i", F.col("local_period").alias("gap"))


@query("e8_population_variance", RES + " SELECT track_index, round(var_pop(residual), 6) AS var, round(stddev_pop(residual), 6) AS std FROM res GROUP BY 1")
def variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).groupBy("track_index").agg(r6(F.var_pop("residual"), "var"), r6(F.stddev_pop("residual"), "std"))


@query("e14_orientation", RES + ANG + " SELECT track_index, round(degrees(atan(abs(coalesce(regr_slope(position, frame), 0)))), 6) AS angle, round(degrees(coalesce(stddev_pop(angle), 0)), 6) AS angle_std FROM ang GROUP BY 1")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("a", T.local_angle())
    return t.groupBy("track_index").agg(r6(F.degrees(F.atan(F.abs(F.coalesce(F.regr_slope("position", "frame"), F.lit(0.0))))), "angle"), r6(F.degrees(F.coalesce(F.stddev_pop("a"), F.lit(0.0))), "angle_std"))


@query("f1_neighbour_peaks", BASE + " SELECT track_index, peak_i, prev_i, next_i, peak_ord FROM peaks")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.find_peaks(residuals(spark, sf_dir), PROMINENCE).select("track_index", "peak_i", "prev_i", "next_i", "peak_ord")


@query("f3_wave_window", BASE + WIN + " SELECT track_index, peak_i, round(frame1, 6) AS frame1, round(frame2, 6) AS frame2, frame1 < 0 OR frame2 > 63 AS boundary FROM win")
def wave_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, peaks, freq = analysed(spark, sf_dir)
    w = T.wave_windows(peaks, freq, RATE)
    return w.select("track_index", "peak_i", r6("frame1"), r6("frame2"), ((F.col("frame1") < 0) | (F.col("frame2") > 63)).alias("boundary"))


@query("f8_strongest_peak", BASE + " SELECT track_index, arg_max(peak_i, residual) AS peak_i FROM peaks GROUP BY 1")
def strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.find_peaks(residuals(spark, sf_dir), PROMINENCE).groupBy("track_index").agg(F.max_by("peak_i", F.struct("residual", -F.col("peak_i"))).alias("peak_i"))


@query("f9_local_maxima_order3", RES + ", m AS (SELECT *, coalesce(max(residual) OVER (PARTITION BY track_index ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), -1e308) AS b, coalesce(max(residual) OVER (PARTITION BY track_index ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), -1e308) AS a FROM res) SELECT track_index, i FROM m WHERE residual > a AND residual > b")
def maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.local_maxima(residuals(spark, sf_dir), 3).select("track_index", "i")


@query("f10_first_differences", TR + " SELECT track_index, i, round(position - lag(position) OVER (PARTITION BY track_index ORDER BY i), 6) AS diff FROM tr")
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("track_index", "i", r6(F.col("position") - F.lag("position").over(T.ordered()), "diff"))


@query("f12_decimate_polyline", TR + ", k AS (SELECT CAST(floor(j * 63.0 / 19) AS INTEGER) AS i FROM (SELECT unnest(range(20)) AS j)) SELECT track_index, i, round(position, 6) AS position FROM tr JOIN k USING (i)")
def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.decimate(tracks(spark, sf_dir), 20).select("track_index", "i", r6("position"))


@query("f13_hit_test_decimation", TR + ", n AS (SELECT *, count(*) OVER (PARTITION BY track_index) AS n FROM tr) SELECT track_index, i, round(position, 6) AS position FROM n WHERE i % greatest(1, CAST(floor(n / 20.0) AS INTEGER)) = 0")
def hit_decimation(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(T.track()) / 20).cast("int"))
    return tracks(spark, sf_dir).withColumn("step", step).where(F.col("i") % F.col("step") == 0).select("track_index", "i", r6("position"))


@query("f14_slice_local_ordinal", BASE + " SELECT track_index, peak_i, CASE WHEN peak_i BETWEEN 10 AND 40 THEN peak_i - 10 END AS local_i FROM peaks")
def slice_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.find_peaks(residuals(spark, sf_dir), PROMINENCE)
    return p.select("track_index", "peak_i", F.when(F.col("peak_i").between(10, 40), F.col("peak_i") - 10).alias("local_i"))


@query("g20_peaks_table", BASE + " SELECT track_index, peak_i, frame AS x, round(residual, 6) AS value, round(prominence, 6) AS prominence FROM peaks")
def peaks_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.find_peaks(residuals(spark, sf_dir), PROMINENCE).select("track_index", "peak_i", F.col("frame").alias("x"), r6("residual", "value"), r6("prominence"))


@query("h4_overlay_event", BASE + ", k AS (SELECT CAST(floor(j * 63.0 / 15) AS INTEGER) AS i FROM (SELECT unnest(range(16)) AS j)), poly AS (SELECT track_index, string_agg(CAST(CAST(round(position * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(i AS VARCHAR), ',' ORDER BY i) AS poly FROM tr JOIN k USING (i) GROUP BY 1), pp AS (SELECT track_index, string_agg(CAST(peak_i AS VARCHAR), ',' ORDER BY peak_i) AS peaks FROM peaks GROUP BY 1) SELECT track_index, poly, peaks, round(frequency, 6) AS freq_hz FROM poly JOIN pp USING (track_index) JOIN freq USING (track_index)")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimated polyline and peaks per track, as ordered lists (here written as text)."""
    res, peaks, freq = analysed(spark, sf_dir)
    point = F.concat(F.round(F.col("position") * 1000).cast("long").cast("string"), F.lit(":"), F.col("i").cast("string"))
    poly = T.decimate(res, 16).groupBy("track_index").agg(F.array_sort(F.collect_list(F.struct("i", point.alias("p")))).alias("l"))
    poly = poly.select("track_index", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("poly"))
    pp = peaks.groupBy("track_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("peak_i")), lambda x: x.cast("string")), ",").alias("peaks"))
    return poly.join(pp, "track_index").join(freq, "track_index").select("track_index", "poly", "peaks", r6("frequency", "freq_hz"))


@query("c20_wave_type", "SELECT event_id, CASE WHEN value <= 10 AND user_id % 5 >= 1 THEN 'ripple' WHEN value >= 20 THEN 'surf' ELSE 'ambiguous' END AS wave_type, round(CASE WHEN value <= 10 AND user_id % 5 >= 1 THEN greatest(0.0, least(1.0, (user_id % 5) / (1 + 1e-6) * (1 - value / (10 + 1e-6)))) WHEN value >= 20 THEN greatest(0.0, least(1.0, (value - 20) / 70)) ELSE 0.5 END, 6) AS score FROM events WHERE value IS NOT NULL")
def wave_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, score = T.classify(F.col("value"), (F.col("user_id") % 5).cast("double"))
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", kind.alias("wave_type"), r6(score, "score"))


@query("e17_derived_track_quantities", TR + ", d AS (SELECT *, position - lag(position) OVER w AS dx, frame - lag(frame) OVER w AS dt FROM tr WINDOW w AS (PARTITION BY track_index ORDER BY i)) SELECT track_index, CAST(sign(arg_max(position, i) - arg_min(position, i)) AS INTEGER) AS direction, round(avg(abs(dx / dt)), 6) AS velocity, round(sum(abs(dx)), 6) AS dist, max(frame) - min(frame) + 1 AS duration, round(sum(abs(dx)) / (max(frame) - min(frame) + 1), 6) AS start_to_end FROM d GROUP BY 1")
def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("dx", F.col("position") - F.lag("position").over(T.ordered())).withColumn("dt", F.col("frame") - F.lag("frame").over(T.ordered()))
    dist, duration = F.sum(F.abs("dx")), F.max("frame") - F.min("frame") + 1
    return t.groupBy("track_index").agg(
        F.signum(F.max_by("position", "i") - F.min_by("position", "i")).cast("int").alias("direction"), r6(F.avg(F.abs(F.col("dx") / F.col("dt"))), "velocity"), r6(dist, "dist"), duration.alias("duration"), r6(dist / duration, "start_to_end"),
    )


@query("f11_gap_split", "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM e) SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS points FROM s GROUP BY 1, 2")
def gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("gap", F.coalesce(((F.col("ts") - F.lag("ts").over(w)) > F.expr("interval 6 hours")).cast("int"), F.lit(0)))
    return e.withColumn("part", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("points"))


@query("e22_track_length", TR + ", l AS (SELECT track_index, max(frame) - min(frame) + 1 + track_index % 9 AS length FROM tr GROUP BY 1) SELECT round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.9), 6) AS p90, max(length) AS most FROM l")
def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tracks(spark, sf_dir).groupBy("track_index").agg((F.max("frame") - F.min("frame") + 1 + F.col("track_index") % 9).alias("length"))
    return n.agg(r6(F.percentile("length", F.lit(0.5)), "p50"), r6(F.percentile("length", F.lit(0.9)), "p90"), F.max("length").alias("most"))


@query("g23_bulge_metrics", BASE + """, around AS (SELECT track_index, i, residual AS r, lag(residual) OVER w AS b, lead(residual) OVER w AS a FROM res WINDOW w AS (PARTITION BY track_index ORDER BY i)),
ed AS (SELECT p.track_index, p.peak_i, p.prominence, p.residual - p.prominence / 2 AS level,
       arg_max({'i': s.i, 'r': s.r, 'o': s.a}, s.i) FILTER (s.i < p.peak_i) AS l, arg_min({'i': s.i, 'r': s.r, 'o': s.b}, s.i) FILTER (s.i > p.peak_i) AS h
       FROM peaks p LEFT JOIN around s ON s.track_index = p.track_index AND s.i <> p.peak_i AND s.r <= p.residual - p.prominence / 2 AND NOT p.fallback_peak GROUP BY ALL),
wd AS (SELECT track_index, peak_i, prominence, (h.i - (level - h.r) / (h.o - h.r)) - (l.i + (level - l.r) / (l.o - l.r)) AS width FROM ed)
SELECT track_index, peak_i, round(prominence, 6) AS bulge_prominence_px, round(width, 6) AS bulge_width_frames, round(width / 1.0, 6) AS bulge_width_s FROM wd""")
def bulge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = residuals(spark, sf_dir)
    p = T.bulge(T.widths(res, T.find_peaks(res, PROMINENCE)), RATE)
    return p.select("track_index", "peak_i", r6("bulge_prominence_px"), r6("bulge_width_frames"), r6("bulge_width_s"))
