"""Per-track kernels that go sample by sample: robust lines, full peak detection, suppression, wavelet ridges.

A track becomes one row of arrays in one exchange; a task then gets many tracks at once, in Arrow batches. Robust lines are fitted to
all tracks of a batch that have one length together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tracks import numbered


def mad(x: np.ndarray) -> float:
    return float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


def robust_line(x: np.ndarray, y: np.ndarray, degree: int = 1, share: float = 0.5, trials: int = 100, seed: int = 42) -> np.ndarray:
    """A polynomial fitted to the inliers of the best random sample; the plain least-squares fit where that isn't possible.

    Inliers lie within the median absolute deviation of y itself (not of residuals), or half its deviation, or 1. Samples hold
    ceil(share * n) points. Trials stop once a sample of inliers alone has been drawn with 99% certainty.
    """
    n = len(x)
    scale = max(float(np.abs(x - x.mean()).max()), 1e-12) if n else 1.0
    basis = np.vander((x - (x.mean() if n else 0)) / scale, degree + 1)
    fit = lambda rows: np.linalg.lstsq(basis[rows], y[rows], rcond=None)[0]
    every = np.ones(n, bool)
    if n < degree + 1:
        return np.full(n, y.mean()) if n else y
    limit = mad(y) or 0.5 * float(y.std()) or 1.0
    take = min(n, max(math.ceil(share * n), degree + 1, 2))
    random = np.random.RandomState(seed)
    best, best_rows, k, need = (-1, -np.inf), every, 0, trials
    while k < min(trials, need):
        rows = random.permutation(n)[:take]
        inside = np.abs(y - basis @ fit(rows)) <= limit
        k += 1
        if not inside.any():
            continue
        spread = ((y[inside] - y[inside].mean()) ** 2).sum()
        score = 1 - ((y[inside] - (basis @ fit(rows))[inside]) ** 2).sum() / spread if spread > 0 else 0.0
        if (int(inside.sum()), score) > best:
            best, best_rows = (int(inside.sum()), score), inside
            clean = (inside.mean()) ** take
            need = 1 if clean >= 1 else (trials if clean <= 0 else min(trials, math.log(0.01) / math.log1p(-clean)))
    return basis @ fit(best_rows if best_rows.sum() >= degree + 1 else every)


def robust_lines(x: np.ndarray, y: np.ndarray, degree: int = 1, share: float = 0.5, trials: int = 100, seed: int = 42) -> np.ndarray:
    """robust_line of many tracks of one length, a row each. All draw the same samples, since they share the seed, so that a trial is one
    product of matrices for all tracks that aren't done yet. Tracks with the same frames share its inverse, too."""
    count, n = y.shape
    if n < degree + 1:
        return np.repeat(y.mean(1, keepdims=True), n, 1)
    middle = x.mean(1, keepdims=True)
    basis = ((x - middle) / np.maximum(np.abs(x - middle).max(1, keepdims=True), 1e-12))[:, :, None] ** np.arange(degree, -1, -1)
    same = bool((x == x[:1]).all())
    if same:
        basis = basis[:1]
    inverse = lambda b: np.linalg.pinv(b, rcond=np.finfo(float).eps * max(b.shape[-2:]))
    mads, half = np.median(np.abs(y - np.median(y, axis=1, keepdims=True)), axis=1), 0.5 * y.std(axis=1)
    limit = np.where(mads != 0, mads, np.where(half != 0, half, 1.0))[:, None]
    take = min(n, max(math.ceil(share * n), degree + 1, 2))
    random = np.random.RandomState(seed)
    best, best_score, best_rows, need = np.full(count, -1), np.full(count, -np.inf), np.ones((count, n), bool), np.full(count, float(trials))
    for k in range(trials):
        on = np.flatnonzero(k < need)
        if not len(on):
            break
        rows, ys = random.permutation(n)[:take], y[on]
        if same:
            line = ys[:, rows] @ inverse(basis[0][rows]).T @ basis[0].T
        else:
            b = basis[on]
            line = (b @ (inverse(b[:, rows]) @ ys[:, rows, None]))[:, :, 0]
        off = ys - line
        inside = np.abs(off) <= limit[on]
        found = inside.sum(1)
        # Only those that have as many inliers as the best so far need a score.
        able = np.flatnonzero((found > 0) & (found >= best[on]))
        if not len(able):
            continue
        at, inner, number = on[able], inside[able], found[able]
        centre = np.where(inner, ys[able], 0).sum(1) / number
        spread = (np.where(inner, ys[able] - centre[:, None], 0) ** 2).sum(1)
        score = np.where(spread > 0, 1 - (np.where(inner, off[able], 0) ** 2).sum(1) / np.where(spread > 0, spread, 1), 0.0)
        better = (number > best[at]) | (score > best_score[at])
        at, inner, number = at[better], inner[better], number[better]
        best[at], best_score[at], best_rows[at] = number, score[better], inner
        clean = (number / n) ** take
        with np.errstate(divide="ignore", invalid="ignore"):
            need[at] = np.where(clean >= 1, 1, np.where(clean <= 0, trials, np.minimum(trials, math.log(0.01) / np.log1p(-clean))))
    best_rows[best_rows.sum(1) < degree + 1] = True
    masked = basis * best_rows[:, :, None]
    return (basis @ (inverse(masked) @ y[:, :, None]))[:, :, 0]


#: Tracks are fitted in parts of about so many samples.
PART = 100_000


def robust_baselines(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, **how) -> np.ndarray:
    """Baselines of tracks that follow one another in x and y. Those of one length and the same frames are fitted together, in parts, and
    so are all others of one length."""
    out, starts = np.empty(len(y)), np.cumsum(lengths) - lengths
    for n in np.unique(lengths).tolist():
        if not n:
            continue
        places = starts[lengths == n][:, None] + np.arange(n)
        _, kind, size = np.unique(x[places], axis=0, return_inverse=True, return_counts=True)
        kind = np.where(size[kind.ravel()] >= 8, kind.ravel(), -1)
        order = np.argsort(kind, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            for k in range(0, len(group), max(1, PART // n)):
                at = places[group[k : k + max(1, PART // n)]]
                out[at] = robust_lines(x[at], y[at], **how)
    return out


def plateau_maxima(x: np.ndarray) -> np.ndarray:
    """Inner local maxima; of a flat top the middle sample, rounded down."""
    x = x.tolist()
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return np.array(out, np.int64)


def peak_shape(x: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prominences, and widths at half prominence by linear interpolation."""
    prominence, width = np.zeros(len(peaks)), np.zeros(len(peaks))
    x = x.tolist()
    for k, p in enumerate(peaks.tolist()):
        a = b = p
        low_a = low_b = x[p]
        while a >= 0 and x[a] <= x[p]:
            low_a, a = min(low_a, x[a]), a - 1
        while b < len(x) and x[b] <= x[p]:
            low_b, b = min(low_b, x[b]), b + 1
        prominence[k] = x[p] - max(low_a, low_b)
        level = x[p] - prominence[k] / 2
        i, j = p, p
        while i > a + 1 and x[i] > level:
            i -= 1
        while j < b - 1 and x[j] > level:
            j += 1
        left = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        right = j - (level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else float(j)
        width[k] = right - left
    return prominence, width


def spaced(peaks: np.ndarray, heights: np.ndarray, distance: float) -> np.ndarray:
    """Which peaks stay if the highest first remove all nearer than the distance."""
    keep = np.ones(len(peaks), bool)
    gap = math.ceil(distance)
    for k in np.argsort(heights, kind="stable")[::-1].tolist():
        if keep[k]:
            near = (np.abs(peaks - peaks[k]) < gap) & (np.arange(len(peaks)) != k)
            keep[near] = False
    return keep


def suppressed(peaks: np.ndarray, strength: np.ndarray, window: float, dominance: float) -> np.ndarray:
    """Which peaks stay if the strongest first remove those in their window of at most `dominance` times their strength."""
    keep = np.ones(len(peaks), bool)
    for k in np.argsort(-strength, kind="stable").tolist():
        if keep[k]:
            weak = (np.abs(peaks - peaks[k]) <= window) & (strength <= dominance * strength[k]) & (np.arange(len(peaks)) != k)
            keep[weak] = False
    return keep


def _peaks(x: np.ndarray, prominence: float = 1.0, width: float = 1.0, distance: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    peaks = plateau_maxima(x)
    if distance is not None and len(peaks):
        peaks = peaks[spaced(peaks, x[peaks], distance)]
    prom, wide = peak_shape(x, peaks)
    ok = (prom >= prominence) & (wide >= width)
    return peaks[ok], prom[ok], wide[ok]


def _named(peaks: np.ndarray, prominence: np.ndarray, width: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"peak_i": peaks, "prominence": prominence, "width": width})


def find_peaks(x: np.ndarray, prominence: float = 1.0, width: float = 1.0, distance: float | None = None) -> pd.DataFrame:
    """Distance, then prominence, then width."""
    return _named(*_peaks(x, prominence, width, distance))


def find_peaks_adaptive(x: np.ndarray, frames_per_period: float | None, **how) -> pd.DataFrame:
    """Thresholds from the spread and the period: prominence of max(least, k MAD), distance and width as parts of a period."""
    return _named(*_peaks_adaptive(x, frames_per_period, **how))


def _peaks_adaptive(x: np.ndarray, frames_per_period: float | None, distance_frac: float = 0.6, width_frac: float = 0.2, k: float = 2.0, least: float = 1.0, nms: bool = True, dominance: float = 0.55) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(x)
    known = frames_per_period is not None and math.isfinite(frames_per_period) and frames_per_period > 0
    distance = max(1, round(distance_frac * frames_per_period)) if known else max(1, round(0.05 * n))
    width = max(1, round(width_frac * frames_per_period)) if known else 1
    # Twice the deviation may be just a prominence, the distance of the same two samples: such a tie counts, however it is rounded.
    peaks, prom, wide = _peaks(x, max(least, k * mad(x)) * (1 - 1e-12), width, distance)
    if nms and len(peaks):
        keep = suppressed(peaks, prom, frames_per_period / 2 if known else max(1, round(0.03 * n)), dominance)
        peaks, prom, wide = peaks[keep], prom[keep], wide[keep]
    return peaks, prom, wide


def ricker(points: int, a: float) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    return 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - (t / a) ** 2) * np.exp(-(t**2) / (2 * a**2))


def wavelet_rows(x: np.ndarray, widths: list[float], wavelet: Callable[[int, float], np.ndarray] = ricker) -> np.ndarray:
    """One row per width: the signal convolved with the wavelet, same length; any callable of (points, width) will do."""
    out = []
    for a in widths:
        points = min(max(3, int(10 * a) | 1), max(3, len(x) | 1))
        full = np.convolve(x, wavelet(points, a))
        start = (points - 1) // 2
        out.append(full[start : start + len(x)])
    return np.array(out)


def ridges(rows: np.ndarray, widths: list[float], gap: int = 1) -> list[list[tuple[int, int]]]:
    """Lines of maxima from the widest scale to the narrowest: each maximum joins the nearest open line within a quarter of the width."""
    done: list[list[tuple[int, int]]] = []
    open_: list[tuple[list[tuple[int, int]], int]] = []
    for s in range(len(widths) - 1, -1, -1):
        row = rows[s]
        tops = [i for i in range(len(row)) if (i == 0 or row[i] > row[i - 1]) and (i == len(row) - 1 or row[i] > row[i + 1])]
        reach, taken = math.ceil(widths[s] / 4), set()
        for k, (line, missed) in enumerate(open_):
            near = min((t for t in tops if t not in taken and abs(t - line[-1][1]) <= reach), key=lambda t: (abs(t - line[-1][1]), t), default=None)
            if near is None:
                open_[k] = (line, missed + 1)
            else:
                taken.add(near)
                line.append((s, near))
                open_[k] = (line, 0)
        done += [line for line, missed in open_ if missed > gap]
        open_ = [(line, missed) for line, missed in open_ if missed <= gap] + [([(s, t)], 0) for t in tops if t not in taken]
    return done + [line for line, _ in open_]


def strong_ridges(found: list[list[tuple[int, int]]], rows: np.ndarray, least_length: int, snr: float = 1.0, percentile: float = 10.0) -> list[list[tuple[int, int]]]:
    """Ridges that are long enough and whose strongest point stands above the noise floor of the narrowest scale."""
    floor = max(float(np.percentile(np.abs(rows[0]), percentile)), 1e-12)
    return [line for line in found if len(line) >= least_length and max(rows[s, t] for s, t in line) / floor >= snr]


def wavelet_peaks(x: np.ndarray, widths: list[float]) -> pd.DataFrame:
    """The strongest point of each strong ridge; near ones of less than three quarters the strength go."""
    rows = wavelet_rows(x, widths)
    lines = strong_ridges(ridges(rows, widths), rows, max(1, len(widths) // 4))
    best = sorted({max(((rows[s, t], -t) for s, t in line)) for line in lines}, key=lambda p: -p[1])
    peaks, strength = np.array([-p[1] for p in best], np.int64), np.array([p[0] for p in best])
    keep = suppressed(peaks, strength, float(np.median(widths)), 0.75)
    return pd.DataFrame({"peak_i": peaks[keep], "strength": strength[keep]})


def _samples(tracks: DataFrame, *columns: str) -> DataFrame:
    """track_index, _s: a track's samples (i and the columns) in order of i, one row a track."""
    return tracks.groupBy("track_index").agg(F.array_sort(F.collect_list(F.struct("i", *columns))).alias("_s"))


def per_track(tracks: DataFrame, column: str, f: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Runs f(frame, values) on each track in order of i and adds track_index to its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [f(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(pdf["_x"], pdf["_y"], strict=True)]
            sizes = [len(x) for x in found]
            if sum(sizes):
                out = pd.concat([x for x in found if len(x)], ignore_index=True)
                out.insert(0, "track_index", np.repeat(pdf["track_index"].to_numpy(), sizes))
                yield out

    arrays = [F.col(f"_s.{c}").cast("array<double>").alias(n) for c, n in (("frame", "_x"), (column, "_y"))]
    return _samples(tracks, "frame", column).select("track_index", *arrays).mapInPandas(run, f"track_index long, {schema}")


def robust_residuals(tracks: DataFrame, **how) -> DataFrame:
    """track_index, i, baseline, residual by robust lines."""
    return _robust(tracks, ("baseline", "residual"), True, how)


def collapse(points: DataFrame) -> DataFrame:
    """image, track, y, x: one pixel per row; the first row's median, then always the nearest to the one before."""
    rows = points.groupBy("image", "track", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    lines = rows.groupBy("image", "track").agg(F.array_sort(F.collect_list(F.struct("y", "xs"))).alias("rows"))
    nearest = lambda xs, at: F.array_min(F.transform(xs, lambda x: F.struct(F.abs(x - at).alias("d"), x.alias("x"))))["x"]
    middle = lambda xs: F.floor((F.get(xs, F.floor((F.size(xs) - 1) / 2).cast("int")) + F.get(xs, F.floor(F.size(xs) / 2).cast("int"))) / 2).cast("int")
    empty = F.array().cast("array<struct<y:int,x:int>>")
    step = lambda s, r: F.concat(s, F.array(F.struct(r["y"].alias("y"), F.when(F.size(s) == 0, middle(r["xs"])).otherwise(nearest(r["xs"], F.element_at(s, -1)["x"])).cast("int").alias("x"))))
    return lines.select("image", "track", F.explode(F.aggregate("rows", empty, step)).alias("p")).select("image", "track", "p.y", "p.x")


def robust_tracks(tracks: DataFrame, **how) -> DataFrame:
    """tracks with baseline and residual by robust lines, in one pass over each track."""
    return _robust(tracks, ("frame", "position", "baseline", "residual"), False, how)


def _robust(tracks: DataFrame, names: tuple[str, ...], count: bool, how: dict) -> DataFrame:
    """track_index, i (counted anew if asked) and the named columns, by robust lines."""
    kind = "int" if count else tracks.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("_s")).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("_s").flatten()
            x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("frame", "position"))
            base = robust_baselines(x, y, lengths, **how)
            values = {"frame": x, "position": y, "baseline": base, "residual": y - base}
            i = pa.array(np.arange(len(y)) - np.repeat(np.cumsum(lengths) - lengths, lengths), pa.int32()) if count else flat.field("i")
            of = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            columns = [batch.column("track_index").take(of).cast(pa.int64()), i, *[pa.array(values[c], from_pandas=True) for c in names]]
            yield pa.RecordBatch.from_arrays(columns, ["track_index", "i", *names])

    return _samples(tracks, "frame", "position").mapInArrow(run, f"track_index long, i {kind}, " + ", ".join(f"{c} double" for c in names))


def chosen_peaks(x: np.ndarray, how: dict, frames_per_period: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, prominences and widths of peaks by the thresholds a configuration asks for, plus the highest finite sample (the last array
    tells it) where they leave fewer than its minimum.

    The added peak has no width; its prominence is its height above the median. It isn't added where it is a peak already.
    """
    if how.get("adaptive"):
        names = {"distance_frac": "distance_frac", "width_frac": "width_frac", "rel_mad_k": "k", "abs_min_prom_px": "least", "nms_enable": "nms", "nms_dominance_frac": "dominance"}
        out = _peaks_adaptive(x, frames_per_period, **{b: how[a] for a, b in names.items() if a in how})
    else:
        out = _peaks(x, how.get("prominence", 1.0), how.get("width", 1.0), how.get("distance"))
    out = (*out, np.zeros(len(out[0]), bool))
    if not len(x) or len(out[0]) >= how.get("minimum_per_track", 1):
        return out
    known = np.isfinite(x)
    at = int(np.argmax(np.where(known, x, -np.inf))) if known.any() else len(x) // 2
    if at in out[0]:
        return out
    height = float(x[at] - np.median(x[known])) if known.any() else math.nan
    place = int(np.searchsorted(out[0], at))
    return tuple(np.insert(a, place, b) for a, b in zip(out, (at, height, math.nan, True), strict=True))


def detect(tracks: DataFrame, how: dict, freq: DataFrame, sampling_rate: float = 1.0) -> DataFrame:
    """Peaks of tracks (with residual) as the `peaks` part of a configuration asks: fixed or adaptive thresholds, with prominence, width,
    ordinal, neighbours and local period. freq (track_index, frequency) gives the adaptive thresholds their period.
    """
    names = ("frame", "position", "residual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("_s")).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column("_s").flatten()
            values = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in names}
            starts = np.cumsum(lengths) - lengths
            periods = [sampling_rate / f if f and f > 0 else None for f in batch.column("frequency").to_pylist()]
            found = [chosen_peaks(values["residual"][a : a + n], how, p) for a, n, p in zip(starts.tolist(), lengths.tolist(), periods, strict=True)]
            if not found:
                continue
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            peak, prominence, width, spare = (np.concatenate(c) for c in zip(*found, strict=True))
            at = starts[of] + peak
            columns = [batch.column("track_index").take(pa.array(of)).cast(pa.int64()), pa.array(peak.astype(np.int32)), *[pa.array(values[c][at], from_pandas=True) for c in names]]
            columns += [pa.array(prominence, from_pandas=True), pa.array(width, from_pandas=True), pa.array(spare)]
            yield pa.RecordBatch.from_arrays(columns, ["track_index", "peak_i", *names, "prominence", "width", "fallback_peak"])

    t = _samples(tracks, *names).join(freq.select("track_index", "frequency"), "track_index", "left")
    found = t.mapInArrow(run, "track_index long, peak_i int, frame double, position double, residual double, prominence double, width double, fallback_peak boolean")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return numbered(found.withColumns({"prominence": known("prominence"), "width": known("width")}))
