"""Kernels that go sample by sample, and wavelet transforms in closed form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import kernels as K
from tidemark.operators import tracks as T
from tidemark.plans import image_queries, track_queries
from tidemark.plans.registry import query, r6
from tidemark.sources.stash import stash

W = track_queries
#: Fixed value: the wavelet's norm divides by the square root of three widths and the fourth root of pi.
RICKER = "(2 / (sqrt(3.0 * a) * power(pi(), 0.25)) * (1 - power(t / a, 2)) * exp(-power(t, 2) / (2 * a * a)))"


def ricker(t, a):
    return 2 / (F.sqrt(3.0 * a) * F.pow(F.pi(), F.lit(0.25))) * (1 - F.pow(t / a, F.lit(2))) * F.exp(-F.pow(t, F.lit(2)) / (2 * a * a))


@query("g14_ricker_kernel", f"SELECT CAST(a AS INTEGER) AS a, CAST(k AS INTEGER) AS k, round({RICKER}, 6) AS w FROM (SELECT a, unnest(range(10 * a + 1)) AS k FROM (SELECT unnest([1, 2, 4]) AS a)) s, LATERAL (SELECT k - 5.0 * a AS t)")
def kernel(spark: SparkSession, d: str) -> DataFrame:
    a = spark.range(1).select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("a"))
    k = a.select("a", F.explode(F.sequence(F.lit(0), 10 * F.col("a"))).alias("k"))
    return k.select("a", "k", r6(ricker(F.col("k") - 5.0 * F.col("a"), F.col("a").cast("double")), "w"))


def convolved(tracks: DataFrame, widths: list[int]) -> DataFrame:
    """track_index, a, i, w: the residual convolved with each width's kernel, same length; beyond the ends it is 0."""
    a = F.array(*[F.lit(x) for x in widths])
    sent = tracks.select("track_index", F.col("i").alias("j"), "residual", F.explode(a).alias("a")).select("*", F.explode(F.sequence(-5 * F.col("a"), 5 * F.col("a"))).alias("t"))
    sums = sent.groupBy("track_index", "a", (F.col("j") + F.col("t")).alias("i")).agg(F.sum(F.col("residual") * ricker(F.col("t").cast("double"), F.col("a").cast("double"))).alias("w"))
    return sums.join(tracks.select("track_index", "i"), ["track_index", "i"])


CWT = W.RES + ", s AS (SELECT track_index, i AS j, residual, a, unnest(range(-5 * a, 5 * a + 1)) AS t FROM res, (SELECT unnest({}) AS a) x), c AS (SELECT track_index, a, j + t AS i, sum(residual * " + RICKER + ") AS w FROM s GROUP BY 1, 2, 3) SELECT track_index, CAST(a AS INTEGER) AS a, CAST(i AS INTEGER) AS i, round(w, 6) AS w FROM c WHERE i BETWEEN 0 AND 63"


@query("g15_same_convolution", CWT.format("[2]"))
def convolution(spark: SparkSession, d: str) -> DataFrame:
    return convolved(W.residuals(spark, d), [2]).select("track_index", "a", F.col("i").cast("int").alias("i"), r6("w"))


@query("g16_cwt", CWT.format("[1, 2, 4]"))
def cwt(spark: SparkSession, d: str) -> DataFrame:
    return convolved(W.residuals(spark, d), [1, 2, 4]).select("track_index", "a", F.col("i").cast("int").alias("i"), r6("w"))


@query("g2_ransac_baseline")
def ransac(spark: SparkSession, d: str) -> DataFrame:
    return K.robust_residuals(W.tracks(spark, d)).select("track_index", "i", r6("baseline"), r6("residual"))


@query("g10_find_peaks")
def find_peaks(spark: SparkSession, d: str) -> DataFrame:
    return K.per_track(W.residuals(spark, d), "residual", lambda t, x: K.find_peaks(x, 8.0, 1.0, 3), "peak_i long, prominence double, width double")


@query("g12_find_peaks_adaptive")
def adaptive(spark: SparkSession, d: str) -> DataFrame:
    return K.per_track(W.residuals(spark, d), "residual", lambda t, x: K.find_peaks_adaptive(x, 8.0), "peak_i long, prominence double, width double")


@query("g13_greedy_nms")
def nms(spark: SparkSession, d: str) -> DataFrame:
    def f(t, x):
        p = K.find_peaks(x, 0.0, 0.0)
        return p[K.suppressed(p["peak_i"].to_numpy(), p["prominence"].to_numpy(), 4, 0.55)]

    return K.per_track(W.residuals(spark, d), "residual", f, "peak_i long, prominence double, width double")


@query("g17_ridge_lines")
def ridge_lines(spark: SparkSession, d: str) -> DataFrame:
    def f(t, x):
        widths = [1.0, 2.0, 3.0, 4.0]
        lines = K.ridges(K.wavelet_rows(x, widths), widths)
        return pd.DataFrame([(k, s, i) for k, line in enumerate(lines) for s, i in line], columns=["ridge", "scale", "at"])

    return K.per_track(W.residuals(spark, d), "residual", f, "ridge long, scale long, at long")


@query("g18_ridge_filter")
def ridge_filter(spark: SparkSession, d: str) -> DataFrame:
    def f(t, x):
        widths = [1.0, 2.0, 3.0, 4.0]
        rows = K.wavelet_rows(x, widths)
        lines = K.strong_ridges(K.ridges(rows, widths), rows, 2)
        return pd.DataFrame({"ridge": range(len(lines)), "length": [len(x) for x in lines]})

    return K.per_track(W.residuals(spark, d), "residual", f, "ridge long, length long")


@query("g19_cwt_peaks")
def cwt_peaks(spark: SparkSession, d: str) -> DataFrame:
    return K.per_track(W.residuals(spark, d), "residual", lambda t, x: K.wavelet_peaks(x, [1.0, 2.0, 3.0, 4.0]), "peak_i long, strength double")


@query("h3_process_track_ransac")
def process_ransac(spark: SparkSession, d: str) -> DataFrame:
    """Track rows over robust baselines."""
    res = stash(K.robust_tracks(W.tracks(spark, d)), "robust-tracks")
    return T.track_rows(res, T.find_peaks(res, W.PROMINENCE), T.dominant_frequency(res, W.RATE, W.LEAST, W.MOST), W.RATE)


def configured(spark: SparkSession, d: str, adaptive: bool = False):
    """Robust residuals, peaks as a configuration asks, frequencies. All three are written once: rows of peaks ask for each several times."""
    res = stash(K.robust_tracks(W.tracks(spark, d)), "robust-tracks")
    freq = stash(T.dominant_frequency(res, W.RATE, W.LEAST, W.MOST), "robust-frequencies")
    how = config.effective({"peaks": {"prominence": W.PROMINENCE, "adaptive": adaptive}})["peaks"]
    return res, stash(T.bulge(K.detect(res, how, freq, W.RATE), W.RATE), "robust-peaks"), freq


BULGE = ["bulge_prominence_px", "bulge_width_frames", "bulge_width_s"]


@query("n7_peak_dispatch")
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive peaks over robust baselines, one a track at least."""
    return configured(spark, d, adaptive=True)[1].select("track_index", "peak_ord", "peak_i", r6("residual"), r6("prominence"), r6("width"), "fallback_peak")


@query("h1_peak_rows_robust")
def peak_rows_robust(spark: SparkSession, d: str) -> DataFrame:
    """Peak rows over robust baselines and full peak finding, with bulge columns."""
    p = T.peak_rows(*configured(spark, d), W.RATE, W.FRAC, local=True)
    return W.peak_select(p, *[r6(c) for c in BULGE])


@query("h2_wave_rows_robust")
def wave_rows_robust(spark: SparkSession, d: str) -> DataFrame:
    """Wave rows over robust baselines and full peak finding, with bulge columns."""
    w = T.wave_rows(*configured(spark, d), W.RATE, W.FRAC)
    return w.select("track_index", F.col("peak_ord").alias("wave_index"), "peak_i", r6("residual", "amplitude"), *[r6(c) for c in [*W.WAVE_COLUMNS, *BULGE]], "wave_type", "boundary")


@query("e15_nearest_collapse")
def nearest_collapse(spark: SparkSession, d: str) -> DataFrame:
    p = image_queries.lit(spark, d).withColumn("track", F.floor(F.col("x") / 16))
    return K.collapse(p.select("image", "track", "y", "x"))
