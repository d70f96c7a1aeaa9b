"""Tracks as rows (track_index, i, frame, position): detrending, frequency, peaks, fits, and the row builders on top.

All windows and joins are keyed by track_index, so a track's samples meet in one task after one exchange and no operator compares
samples of different tracks. Extra key columns (a job) can be folded into track_index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.sources.stash import stash


def track() -> WindowSpec:
    """All samples of a track."""
    return Window.partitionBy("track_index")


def ordered() -> WindowSpec:
    """The samples of a track in order."""
    return track().orderBy("i")


def from_arrays(df: DataFrame, key: str, array: str, scale: float = 1.0) -> DataFrame:
    """A one-dimensional array per key: frame is the place in the array."""
    rows = df.select(F.col(key).cast("long").alias("track_index"), F.posexplode(array).alias("i", "v"))
    return rows.select("track_index", "i", F.col("i").cast("double").alias("frame"), (F.col("v").cast("double") * F.lit(scale)).alias("position"))


def from_points(df: DataFrame, key: str, points: str, order: str = "xy") -> DataFrame:
    """An array of [a, b] pairs per key, in 'yx' or 'xy' order, sorted stably by frame."""
    frame, position = (0, 1) if order == "yx" else (1, 0)
    rows = df.select(F.col(key).cast("long").alias("track_index"), F.posexplode(points).alias("at", "p"))
    rows = rows.select("track_index", "at", F.get("p", F.lit(frame)).cast("double").alias("frame"), F.get("p", F.lit(position)).cast("double").alias("position"))
    return rows.select("track_index", (F.row_number().over(track().orderBy("frame", "at")) - 1).alias("i"), "frame", "position")


def from_rows(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Irregular rows per key: the frame counts them in order."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.select(F.col(key).cast("long").alias("track_index"), i.alias("i"), i.cast("double").alias("frame"), F.col(value).cast("double").alias("position"))


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def detrend(tracks: DataFrame) -> DataFrame:
    """Adds baseline (least-squares line) and residual. A single sample is its own baseline."""
    slope = F.coalesce(F.regr_slope("position", "frame").over(track()), F.lit(0.0))
    base = F.avg("position").over(track()) + slope * (F.col("frame") - F.avg("frame").over(track()))
    return tracks.withColumn("baseline", base).withColumn("residual", F.col("position") - F.col("baseline"))


def detrend_quadratic(tracks: DataFrame) -> DataFrame:
    """Adds baseline and residual of a parabola: normal equations from power sums about the mean frame."""
    x = F.col("frame") - F.avg("frame").over(track())
    t = tracks.withColumn("_x", x)
    s = {k: F.avg(F.pow("_x", F.lit(k))).over(track()) for k in (2, 3, 4)}
    y0, y1, y2 = (F.avg(F.col("position") * F.pow("_x", F.lit(k))).over(track()) for k in (0, 1, 2))
    t = t.select("*", s[2].alias("_s2"), s[3].alias("_s3"), s[4].alias("_s4"), y0.alias("_y0"), y1.alias("_y1"), y2.alias("_y2"))
    det = F.col("_s2") * F.col("_s4") - F.col("_s2") * F.col("_s2") * F.col("_s2") - F.col("_s3") * F.col("_s3")
    # Eliminate the constant: c0 = y0 - c2 s2.
    top = F.col("_y2") - F.col("_s2") * F.col("_y0")
    c2 = (F.col("_s2") * top - F.col("_s3") * F.col("_y1")) / det
    c1 = ((F.col("_s4") - F.col("_s2") * F.col("_s2")) * F.col("_y1") - F.col("_s3") * top) / det
    base = F.col("_y0") - c2 * F.col("_s2") + c1 * F.col("_x") + c2 * F.col("_x") * F.col("_x")
    t = t.withColumn("baseline", base).withColumn("residual", F.col("position") - F.col("baseline"))
    return t.drop("_x", "_s2", "_s3", "_s4", "_y0", "_y1", "_y2")


def detrend_polynomial(tracks: DataFrame, degree: int) -> DataFrame:
    """Adds baseline and residual of the least-squares polynomial of any degree.

    Polynomials that are orthogonal over a track's frames come one from the two before (p_k+1 = (x - a_k) p_k - b_k p_k-1), and each adds
    its own part of the positions, so that no equations are solved and high degrees lose no digits. Frames are first mapped to [-1, 1].
    All sums are windows over a track: one exchange, whatever the degree. Samples without a position have a baseline but no weight; a
    track with no more than `degree` frames is its own baseline.
    """
    w, names = track(), tracks.columns
    low, high = F.min("frame").over(w), F.max("frame").over(w)
    known = F.col("position").isNotNull() & ~F.isnan("position")
    t = tracks.withColumn("_x", F.when(high > low, (2 * F.col("frame") - low - high) / (high - low)).otherwise(0.0)).withColumn("_y", F.when(known, F.col("position")))
    total = lambda c: F.sum(F.when(F.col("_y").isNotNull(), c)).over(w)
    t = t.withColumns({"_p": F.lit(1.0), "_q": F.lit(0.0), "_before": F.lit(1.0), "_base": F.lit(0.0)})
    for k in range(degree + 1):
        p = F.col("_p")
        t = t.withColumns({"_norm": total(p * p), "_a": total(F.col("_x") * p * p), "_c": total(F.col("_y") * p)})
        # Where all frames are roots of p, what is left are rounding errors.
        real = F.col("_norm") > 1e-18
        t = t.withColumn("_base", F.col("_base") + F.when(real, F.col("_c") / F.col("_norm") * p).otherwise(0.0))
        if k < degree:
            nxt = F.when(real, (F.col("_x") - F.col("_a") / F.col("_norm")) * p - F.col("_norm") / F.col("_before") * F.col("_q") * (1.0 if k else 0.0)).otherwise(0.0)
            t = t.withColumns({"_next": nxt}).withColumns({"_q": p, "_p": F.col("_next"), "_before": F.when(real, F.col("_norm")).otherwise(1.0)})
    return t.select(*names, F.col("_base").alias("baseline"), (F.col("position") - F.col("_base")).alias("residual"))


def spectrum(tracks: DataFrame, sampling_rate: float = 1.0) -> DataFrame:
    """track_index, k, frequency, magnitude: the discrete Fourier transform of the mean-free residual, up to half the rate.

    Every sample meets n / 2 + 1 frequencies of its own track; the sums are combined before the exchange.
    """
    t = tracks.select("track_index", "i", (F.col("residual") - F.avg("residual").over(track())).alias("x"), F.count(F.lit(1)).over(track()).alias("n"))
    t = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2).cast("long"))).alias("k"))
    angle = F.lit(2.0) * F.pi() * F.col("k") * F.col("i") / F.col("n")
    sums = t.groupBy("track_index", "k", "n").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    return sums.select("track_index", "k", (F.col("k") * F.lit(sampling_rate) / F.col("n")).alias("frequency"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def dominant_frequency(tracks: DataFrame, sampling_rate: float = 1.0, least: float | None = None, most: float | None = None) -> DataFrame:
    """track_index, frequency: the first strongest frequency within bounds, the constant part aside.

    Where none is positive, the rate over the frame span, then the lower bound, then 1; clamped to the bounds.
    """
    s = spectrum(tracks, sampling_rate).where("k > 0")
    if least is not None:
        s = s.where(F.col("frequency") >= least)
    if most is not None:
        s = s.where(F.col("frequency") <= most)
    best = s.groupBy("track_index").agg(F.max_by("frequency", F.struct(F.round("magnitude", 9), -F.col("k"))).alias("f"))
    span = tracks.groupBy("track_index").agg((F.max("frame") - F.min("frame")).alias("span"))
    out = span.join(best, "track_index", "left")
    return out.select("track_index", resolve_frequency(F.col("f"), F.col("span"), sampling_rate, least, most).alias("frequency"))


def resolve_frequency(f: Column, span: Column, sampling_rate: float, least: float | None, most: float | None) -> Column:
    good = lambda c: F.when((finite(c) > 0), c)
    out = F.coalesce(good(f), good(F.lit(sampling_rate) / F.nullif(span, F.lit(0.0))), F.lit(least if least and least > 0 else 1.0))
    if least is not None:
        out = F.greatest(out, F.lit(float(least)))
    return F.least(out, F.lit(float(most))) if most is not None else out


def local_maxima(tracks: DataFrame, k: int = 1) -> DataFrame:
    """Samples whose residual is above those of all k neighbours on both sides; outside the track there is nothing higher."""
    low = F.lit(float("-inf"))
    before = F.coalesce(F.max("residual").over(ordered().rowsBetween(-k, -1)), low)
    after = F.coalesce(F.max("residual").over(ordered().rowsBetween(1, k)), low)
    return tracks.withColumn("_b", before).withColumn("_a", after).where((F.col("residual") > F.col("_b")) & (F.col("residual") > F.col("_a"))).drop("_a", "_b")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once per row and hands it to body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prominences(tracks: DataFrame) -> DataFrame:
    """track_index, peak_i, frame, position, residual, prominence of the inner local maxima.

    The bases are the nearest strictly higher samples on both sides (or the ends); the prominence is the height above the higher of the
    two minima on the way. A track becomes one row, an array of its samples in order, in one exchange; a peak then looks at slices of it.
    """
    low = F.lit(float("-inf"))

    def lowest(way: Column, top: Column) -> Column:
        """The lowest value on a way from a peak to the first that is higher."""
        until = F.array_position(F.transform(way, lambda x: x > top), F.lit(True)).cast("int")
        return F.array_min(F.when(until > 0, F.slice(way, F.lit(1), until - 1)).otherwise(way))

    def peaks(r: Column) -> Column:
        beside = lambda k: F.greatest(F.coalesce(F.get(r, k - 1), low), F.coalesce(F.get(r, k + 1), low))
        inner = F.when(F.size(r) > 2, F.filter(F.sequence(F.lit(1), F.size(r) - 2), lambda k: F.get(r, k) > beside(k))).otherwise(F.array().cast("array<int>"))
        height = lambda k, top: top - F.greatest(lowest(F.reverse(F.slice(r, F.lit(1), k + 1)), top), lowest(F.slice(r, k + 1, F.size(r)), top))
        return F.transform(inner, lambda k: F.struct(k.alias("k"), _let(F.get(r, k), lambda top: height(k, top)).alias("prominence")))

    rows = tracks.groupBy("track_index").agg(F.array_sort(F.collect_list(F.struct("i", "frame", "position", "residual"))).alias("_s"))
    found = rows.select("track_index", "_s", F.explode(_let(F.transform("_s", lambda x: x["residual"]), peaks)).alias("_p"))
    at = found.select("track_index", F.get("_s", F.col("_p.k")).alias("_x"), "_p.prominence")
    return at.select("track_index", F.col("_x.i").alias("peak_i"), "_x.frame", "_x.position", "_x.residual", "prominence")


def widths(tracks: DataFrame, peaks: DataFrame) -> DataFrame:
    """peaks with their width in frames at half prominence: on each side the nearest sample at or below that height, and from there a
    straight line to the next one. Fallback peaks, and those without a prominence above 0, have no width.
    """
    s = tracks.select(F.col("track_index").alias("_t"), F.col("i").alias("_i"), F.col("residual").alias("_r"), F.lag("residual").over(ordered()).alias("_b"), F.lead("residual").over(ordered()).alias("_a"))
    level = F.col("residual") - F.col("prominence") / 2
    shaped = peaks.where("prominence > 0 AND NOT fallback_peak") if "fallback_peak" in peaks.columns else peaks.where("prominence > 0")
    met = shaped.select("track_index", "peak_i", level.alias("_level")).join(s, (F.col("track_index") == F.col("_t")) & (F.col("_r") <= F.col("_level")) & (F.col("_i") != F.col("peak_i")))
    edges = met.groupBy("track_index", "peak_i", "_level").agg(
        F.max(F.when(F.col("_i") < F.col("peak_i"), F.struct("_i", "_r", "_a"))).alias("_left"), F.min(F.when(F.col("_i") > F.col("peak_i"), F.struct("_i", "_r", "_b"))).alias("_right")
    )
    left = F.col("_left._i") + (F.col("_level") - F.col("_left._r")) / (F.col("_left._a") - F.col("_left._r"))
    right = F.col("_right._i") - (F.col("_level") - F.col("_right._r")) / (F.col("_right._b") - F.col("_right._r"))
    return peaks.join(edges.select("track_index", "peak_i", (right - left).alias("width")), ["track_index", "peak_i"], "left")


def bulge(peaks: DataFrame, sampling_rate: float = 1.0) -> DataFrame:
    """peaks (prominence, width) with the bulge's height in pixels and its width in frames and seconds."""
    seconds = F.col("width") / F.lit(sampling_rate) if sampling_rate else F.lit(None).cast("double")
    return peaks.withColumns({"bulge_prominence_px": F.col("prominence"), "bulge_width_frames": F.col("width"), "bulge_width_s": seconds})


def with_fallback(tracks: DataFrame, peaks: DataFrame, minimum: int = 1) -> DataFrame:
    """peaks plus, for tracks with fewer than `minimum`, their first highest finite sample (if it isn't among them), with its height above
    the median of the finite ones as prominence. A track without a finite sample gets its middle one, without a prominence."""
    enough = peaks.groupBy("track_index").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    value = F.when(F.abs("residual") < float("inf"), F.col("residual"))
    spare = tracks.join(enough, "track_index", "left_anti").withColumn("_v", value).withColumn("_mid", F.floor(F.count(F.lit(1)).over(track()) / 2))
    sample = F.struct("i", "frame", "position", "residual")
    top = spare.groupBy("track_index").agg(
        F.coalesce(F.max_by(sample, F.when(F.col("_v").isNotNull(), F.struct("_v", -F.col("i")))), F.max_by(sample, -F.abs(F.col("i") - F.col("_mid")))).alias("t"), F.max("_v").alias("v"), F.median("_v").alias("m")
    )
    top = top.select("track_index", F.col("t.i").alias("peak_i"), "t.frame", "t.position", "t.residual", (F.col("v") - F.col("m")).alias("prominence"), F.lit(True).alias("fallback_peak"))
    added = top.join(peaks.select("track_index", "peak_i"), ["track_index", "peak_i"], "left_anti")
    return peaks.withColumn("fallback_peak", F.lit(False)).unionByName(added)


def find_peaks(tracks: DataFrame, prominence: float, minimum: int = 1) -> DataFrame:
    """Peaks of at least this prominence, one at least per track with fewer than `minimum` of them, with ordinal, neighbours and the local period in frames.

    Prominences, which the fallback looks at three times, are written once.
    """
    return numbered(with_fallback(tracks, stash(prominences(tracks).where(F.col("prominence") >= prominence), "prominences"), minimum))


def numbered(peaks: DataFrame) -> DataFrame:
    """peaks with ordinal, neighbours and the local period in frames."""
    w = track().orderBy("peak_i")
    peaks = peaks.select(
        "*", F.row_number().over(w).alias("peak_ord"), F.lag("peak_i").over(w).alias("prev_i"), F.lead("peak_i").over(w).alias("next_i"),
        F.lag("frame").over(w).alias("prev_frame"), F.lead("frame").over(w).alias("next_frame"),
    )
    back, ahead = F.abs(F.col("frame") - F.col("prev_frame")), F.abs(F.col("next_frame") - F.col("frame"))
    return peaks.withColumn("local_period", F.coalesce((back + ahead) / 2, back, ahead))


def half_span(freq: Column, sampling_rate: float, frac: float) -> Column:
    """Frames on each side of a peak that its fit takes: half the fraction of a period, half-even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.lit(frac) * (F.lit(sampling_rate) / freq) / 2).cast("int"))


def anchored_fits(tracks: DataFrame, peaks: DataFrame, sampling_rate: float, frac: float = 0.5) -> DataFrame:
    """Sine fits whose maximum is at the peak: adds fit_* columns, and the orientation over the fit window.

    peaks has track_index, peak_i, frame, residual and fit_freq. With s = cos(w (t - t0)) and z = s - 1 the amplitude is
    sum(z (r - r0)) / sum(z z), and the fit passes through the peak. The error is the mean squared error over the variance. Everything
    comes from sums over one join of each peak with the samples around it.
    """
    p = peaks.withColumn("_half", half_span(F.col("fit_freq"), sampling_rate, frac))
    last = tracks.groupBy("track_index").agg(F.max("i").alias("_last"))
    p = p.join(last, "track_index").withColumn("fit_lo", F.greatest(F.lit(0), F.col("peak_i") - F.col("_half"))).withColumn("fit_hi", F.least("_last", F.col("peak_i") + F.col("_half"))).drop("_half", "_last")
    s = tracks.select(
        F.col("track_index").alias("_t"), F.col("i").alias("_i"), F.col("frame").alias("_f"), F.col("position").alias("_p"), F.col("residual").alias("_r"), local_angle().alias("_angle")
    )
    met = p.join(s, (F.col("track_index") == F.col("_t")) & F.col("_i").between(F.col("fit_lo"), F.col("fit_hi")))
    z = F.cos(F.lit(2.0) * F.pi() * F.col("fit_freq") / F.lit(sampling_rate) * (F.col("_f") - F.col("frame"))) - 1
    met = met.withColumn("_z", z).withColumn("_d", F.col("_r") - F.col("residual"))
    sums = met.groupBy("track_index", "peak_i").agg(
        F.sum(F.col("_z") * F.col("_z")).alias("_zz"), F.sum(F.col("_z") * F.col("_d")).alias("_zd"), F.sum(F.col("_d") * F.col("_d")).alias("_dd"), F.count(F.lit(1)).alias("_n"), F.var_pop("_r").alias("_var"),
        F.regr_slope("_p", "_f").alias("_slope"), F.stddev_pop(F.when(F.col("_i") > F.col("fit_lo"), F.col("_angle"))).alias("_spread"),
    )
    out = p.join(sums, ["track_index", "peak_i"])
    a = F.when(F.col("_zz") > 0, F.col("_zd") / F.col("_zz")).otherwise(F.col("residual"))
    out = out.withColumn("fit_amp", a).withColumn("fit_offset", F.col("residual") - F.col("fit_amp"))
    error = (F.col("_dd") - 2 * F.col("fit_amp") * F.col("_zd") + F.col("fit_amp") * F.col("fit_amp") * F.col("_zz")) / F.col("_n") / F.col("_var")
    out = out.withColumn("fit_error", F.when((F.col("_n") >= 2) & (F.col("_var") > 0), error))
    out = out.withColumn("fit_phase", F.pi() / 2 - 2 * F.pi() * F.col("fit_freq") / F.lit(sampling_rate) * F.col("frame"))
    out = out.withColumn("orientation", F.degrees(F.atan(F.abs(F.coalesce("_slope", F.lit(0.0)))))).withColumn("orientation_std", F.degrees(F.coalesce("_spread", F.lit(0.0))))
    return out.drop("_zz", "_zd", "_dd", "_n", "_var", "_slope", "_spread")


def local_angle() -> Column:
    """Angle of the step from the sample before; 0 where the frame stays."""
    dx, dy = F.col("frame") - F.lag("frame").over(ordered()), F.col("position") - F.lag("position").over(ordered())
    return F.when(dx.isNotNull(), F.atan(F.abs(F.when(dx != 0, dy / dx).otherwise(0.0))))


def classify(angle: Column, prominence: Column, ripple_max: float = 10.0, surf_min: float = 20.0, prominence_min: float = 1.0) -> tuple[Column, Column]:
    """Wave type and score."""
    known = angle.isNotNull() & prominence.isNotNull()
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ripple, surf = known & (angle <= ripple_max) & (prominence >= prominence_min), known & (angle >= surf_min)
    score = F.when(ripple, unit(prominence / (prominence_min + 1e-6) * (1 - angle / (ripple_max + 1e-6)))).when(surf, unit((angle - surf_min) / (90.0 - surf_min))).otherwise(0.5)
    return F.when(ripple, "ripple").when(surf, "surf").otherwise("ambiguous"), score


def peak_rows(tracks: DataFrame, peaks: DataFrame, freq: DataFrame, sampling_rate: float = 1.0, frac: float = 0.5, local: bool = True) -> DataFrame:
    """One row per peak with local period and frequency, fit (by local or global frequency) and orientation."""
    p = peaks.join(freq.withColumnRenamed("frequency", "global_freq"), "track_index")
    period = F.coalesce(F.when(F.col("local_period") > 0, F.col("local_period")), F.lit(sampling_rate) / F.col("global_freq"))
    p = p.withColumn("period_frames", period).withColumn("freq_hz", F.lit(sampling_rate) / F.col("period_frames"))
    p = p.withColumn("fit_freq", F.col("freq_hz") if local else F.col("global_freq"))
    return anchored_fits(tracks, p, sampling_rate, frac)


def wave_windows(peaks: DataFrame, freq: DataFrame, sampling_rate: float = 1.0) -> DataFrame:
    """Adds frame1 and frame2: midpoints to the neighbouring peaks, or half a period away where there is none."""
    p = peaks.join(freq.withColumnRenamed("frequency", "global_freq"), "track_index")
    period = F.coalesce(F.when(F.col("local_period") > 0, F.col("local_period")), F.lit(sampling_rate) / F.col("global_freq"))
    a = F.coalesce((F.col("prev_frame") + F.col("frame")) / 2, F.col("frame") - period / 2)
    b = F.coalesce((F.col("frame") + F.col("next_frame")) / 2, F.col("frame") + period / 2)
    return p.withColumn("frame1", F.least(a, b)).withColumn("frame2", F.greatest(a, b))


def lerp(name: str, t: str) -> Column:
    """The position at frame t between the samples beside it, whose frames and positions are name_lf, name_lp, name_hf and name_hp."""
    lf, lp, hf, hp = (F.col(f"{name}_{k}") for k in ("lf", "lp", "hf", "hp"))
    return F.when(lf.isNull(), hp).when(hf.isNull() | (hf == lf), lp).otherwise(lp + (hp - lp) * (F.col(t) - lf) / (hf - lf))


def wave_rows(tracks: DataFrame, peaks: DataFrame, freq: DataFrame, sampling_rate: float = 1.0, frac: float = 0.5) -> DataFrame:
    """One row per peak and wave: window, period, frequency, positions at its ends, velocity, wavelength, box, orientation, fit, type.

    Windows, boxes and interpolations come from one join of each wave with the samples that lie in its window, next to its peak or on
    both sides of the window's ends, and one aggregation.
    """
    w = wave_windows(peaks, freq, sampling_rate)
    w = w.withColumn("period_frames", F.col("frame2") - F.col("frame1"))
    w = w.withColumn("freq_hz", F.coalesce(F.when(F.col("period_frames") > 0, F.lit(sampling_rate) / F.col("period_frames")), F.col("global_freq"))).withColumn("fit_freq", F.col("freq_hz"))
    # Windows need no fit: samples are met without it, lest it is made twice.
    windows = w.select("track_index", "peak_i", "frame1", "frame2")
    w = anchored_fits(tracks, w, sampling_rate, frac).drop("orientation", "orientation_std")
    by_frame = track().orderBy("frame", "i")
    s = tracks.select(
        F.col("track_index").alias("_t"), F.col("i").alias("_i"), F.col("frame").alias("_f"), F.col("position").alias("_p"), local_angle().alias("_angle"),
        F.lag("frame").over(by_frame).alias("_prev"), F.lead("frame").over(by_frame).alias("_next"), F.min("frame").over(track()).alias("_lowest"), F.max("frame").over(track()).alias("_highest"),
    )
    inside = (F.col("_f") >= F.col("frame1")) & (F.col("_f") <= F.col("frame2"))
    near = F.abs(F.col("_i") - F.col("peak_i")) <= 1
    below = lambda t: (F.col("_f") <= F.col(t)) & F.coalesce(F.col("_next") > F.col(t), F.lit(True))
    above = lambda t: (F.col("_f") >= F.col(t)) & F.coalesce(F.col("_prev") < F.col(t), F.lit(True))
    needed = inside | near | below("frame1") | above("frame1") | below("frame2") | above("frame2")
    met = windows.join(s, (F.col("track_index") == F.col("_t")) & needed)
    aggs = [F.count_if(inside).alias("_n"), F.min("_lowest").alias("_fmin"), F.max("_highest").alias("_fmax")]
    # One sample each is next below and above a window's end.
    aggs += [F.max(F.when(side(f"frame{k}"), F.col(c))).alias(f"_at{k}_{end}{c[1]}") for k in (1, 2) for end, side in (("l", below), ("h", above)) for c in ("_f", "_p")]
    # A part's first sample has no step inside it.
    for name, part, inner in (("in", inside, inside & (F.col("_prev") >= F.col("frame1"))), ("by", near, near & (F.col("_i") > F.greatest(F.col("peak_i") - 1, F.lit(0))))):
        of = lambda c, part=part: F.when(part, F.col(c))
        aggs += [
            F.regr_slope(of("_p"), of("_f")).alias(f"_slope_{name}"), F.min(of("_p")).alias(f"_x0_{name}"), F.max(of("_p")).alias(f"_x1_{name}"), F.min(of("_f")).alias(f"_y0_{name}"), F.max(of("_f")).alias(f"_y1_{name}"),
            F.stddev_pop(of("_angle", inner)).alias(f"_spread_{name}"),
        ]
    box = met.groupBy("track_index", "peak_i", "frame1", "frame2").agg(*aggs)
    pick = lambda c: F.when(F.col("_n") >= 2, F.col(f"_{c}_in")).otherwise(F.col(f"_{c}_by"))
    box = box.select(
        "track_index", "peak_i", lerp("_at1", "frame1").alias("pos1"), lerp("_at2", "frame2").alias("pos2"), pick("x0").alias("xmin"), pick("x1").alias("xmax"), pick("y0").alias("ymin"), pick("y1").alias("ymax"),
        F.degrees(F.atan(F.abs(F.coalesce(pick("slope"), F.lit(0.0))))).alias("orientation"), F.degrees(F.coalesce(pick("spread"), F.lit(0.0))).alias("orientation_std"), ((F.col("frame1") < F.col("_fmin")) | (F.col("frame2") > F.col("_fmax"))).alias("boundary"),
    )
    out = w.join(box, ["track_index", "peak_i"])
    kind, score = classify(F.col("orientation"), F.col("prominence"))
    sr = F.lit(sampling_rate)
    return out.withColumns({
        "period_s": F.col("period_frames") / sr, "delta_pos": F.col("pos2") - F.col("pos1"), "t_start": F.col("frame1") / sr, "t_end": F.col("frame2") / sr, "wave_type": kind, "type_score": score,
    }).withColumns({"velocity": F.when(F.col("period_s") != 0, F.col("delta_pos") / F.col("period_s")), "wavelength": F.abs("delta_pos")})


def track_rows(tracks: DataFrame, peaks: DataFrame, freq: DataFrame, sampling_rate: float = 1.0) -> DataFrame:
    """One row per track: mean peak amplitude, frequency, period, number of peaks, first point."""
    amp = peaks.groupBy("track_index").agg(F.avg("residual").alias("amplitude"), F.count(F.lit(1)).alias("num_peaks"))
    first = tracks.groupBy("track_index").agg(F.min_by("position", "i").alias("x"), F.min_by("frame", "i").alias("y"), F.count(F.lit(1)).alias("points"))
    out = first.join(amp, "track_index", "left").join(freq, "track_index")
    return out.select("track_index", F.bround("x").cast("int").alias("x0"), F.bround("y").cast("int").alias("y0"), "points", "amplitude", F.coalesce("num_peaks", F.lit(0)).alias("num_peaks"), "frequency", (1 / F.col("frequency")).alias("period"))


def decimate(tracks: DataFrame, most: int) -> DataFrame:
    """All samples of short tracks; of longer ones `most`, evenly spaced, first and last included."""
    t = tracks.withColumn("_n", F.count(F.lit(1)).over(track()))
    short = t.where(F.col("_n") <= most)
    wanted = tracks.groupBy("track_index").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    wanted = wanted.select(F.col("track_index").alias("_t"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / (most - 1)))).alias("_i"))
    return short.unionByName(t.join(wanted, (F.col("track_index") == F.col("_t")) & (F.col("i") == F.col("_i"))).drop("_t", "_i")).drop("_n")
