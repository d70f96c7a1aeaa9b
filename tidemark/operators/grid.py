"""Images as pixel rows (image, y, x, v): neighbourhoods, morphology, components, tiles, skeletons.

Everything is keyed by image, so images are independent of each other and spread over the cluster. Neighbourhoods along an axis are
window frames on a dense grid; others are equi-joins on shifted coordinates. Only thinning, bridging and growing, which go pixel by pixel,
run in Python, one image a group. Tracing is in tracing.py.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stash import stash

from tidemark.operators.components import components

EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
#: Half of those steps: each pair of pixels once.
ONWARD = [s for s in EIGHT if s > (0, 0)]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def from_arrays(df: DataFrame, key: str, array: str, height: int, scale: float = 1.0) -> DataFrame:
    """Rows of arrays as images of `height` rows each."""
    return df.select(F.floor(F.col(key) / height).alias("image"), (F.col(key) % height).cast("int").alias("y"), F.posexplode(array).alias("x", "v0")).select("image", "y", "x", (F.col("v0").cast("double") * F.lit(scale)).alias("v"))


def keep_extremes(v: Column, lower: float, upper: float, binarize: bool = False) -> Column:
    """0 inside [lower, upper], else the absolute value, or 1; NaN and infinities first become 0."""
    sane = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    kept = F.when(sane.between(lower, upper), 0.0).otherwise(F.abs(sane))
    return (kept > 0).cast("double") if binarize else kept


def flip(df: DataFrame, height: int | None = None) -> DataFrame:
    """Upside down: in images of `height` rows, also where the last ones are missing, or else from each image's last row."""
    last = F.max("y").over(Window.partitionBy("image")) if height is None else F.lit(height - 1)
    return df.withColumn("y", last - F.col("y"))


def normalise(df: DataFrame, vmax: float | None = None) -> DataFrame:
    """v over its image's largest value (or vmax), clipped to [0, 1]; all 0 if that is 0."""
    top = F.max("v").over(Window.partitionBy("image")) if vmax is None else F.lit(float(vmax))
    return df.withColumn("v", F.when(top == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("v") / top))))


def hot(v: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of the black-red-yellow-white map, 0 to 255."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    byte = lambda c: F.floor(unit(c) * 255 + 0.5).cast("int")
    return byte(0.0416 + v * (1 - 0.0416) / 0.365079), byte((v - 0.365079) / (0.746032 - 0.365079)), byte((v - 0.746032) / (1 - 0.746032))


def stretch(df: DataFrame) -> DataFrame:
    """Dark background: inverted if the mean is over one half; then the 5th to 95th percentile is spread over [0, 1] with clipping."""
    w = Window.partitionBy("image")
    d = df.withColumn("v", F.when(F.avg("v").over(w) > 0.5, 1 - F.col("v")).otherwise(F.col("v")))
    ends = d.groupBy("image").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return d.join(ends, "image").withColumn("v", F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - lo) / (hi - lo)))).otherwise(F.col("v"))).drop("q")


def probability(df: DataFrame) -> DataFrame:
    """Logits to probabilities; an image that lies in [0, 1] already stays."""
    w = Window.partitionBy("image")
    outside = (F.min("v").over(w) < 0) | (F.max("v").over(w) > 1)
    return df.withColumn("v", F.when(outside, 1 / (1 + F.exp(-F.col("v")))).otherwise(F.col("v")))


def along(df: DataFrame, axis: str, before: int, after: int, how: str) -> DataFrame:
    """The largest or smallest value of a window along an axis of a dense grid."""
    other = "x" if axis == "y" else "y"
    f = F.max if how == "max" else F.min
    return df.withColumn("v", f("v").over(Window.partitionBy("image", other).orderBy(axis).rowsBetween(-before, after)))


def close_along(df: DataFrame, axis: str, size: int) -> DataFrame:
    """Dilation, then erosion with a line of `size` pixels."""
    a, b = size // 2, size - 1 - size // 2
    return along(along(df, axis, a, b, "max"), axis, b, a, "min")


def open_along(df: DataFrame, axis: str, size: int) -> DataFrame:
    a, b = size // 2, size - 1 - size // 2
    return along(along(df, axis, a, b, "min"), axis, b, a, "max")


def shifted(df: DataFrame, offsets: Iterable[tuple[int, int]], how: str) -> DataFrame:
    """The largest or smallest value over offsets, inside the image: every pixel is sent to its neighbours and combined there."""
    moves = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
    sent = df.select("image", "y", "x", "v", F.explode(moves).alias("m")).select("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "v")
    f = F.max if how == "max" else F.min
    near = sent.groupBy("image", "y", "x").agg(f("v").alias("v"))
    return df.select("image", "y", "x").join(near, ["image", "y", "x"])


def ellipse(size: int) -> list[tuple[int, int]]:
    """(dy, reach) of the rows of an elliptical element of size x size pixels, size odd: how far it reaches to each side."""
    r = size // 2
    return [(dy, round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0) for dy in range(-r, r + 1)]


def ellipse_extreme(df: DataFrame, size: int, how: str) -> DataFrame:
    """The largest or smallest value under an ellipse, of a dense grid: a sliding extreme along the row for each reach that the ellipse
    has, then the extremes of the rows around. Two exchanges, whatever the size."""
    f, best = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    spans = ellipse(size)
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    wide = df.select("image", "y", "x", *[f("v").over(row.rowsBetween(-reach, reach)).alias(f"_r{reach}") for reach in sorted({r for _, r in spans})])
    around = [F.col(f"_r{r}") if dy == 0 else F.lag(f"_r{r}", -dy).over(column) for dy, r in spans]
    return wide.select("image", "y", "x", (best(*around) if len(around) > 1 else around[0]).alias("v"))


def dense(df: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel of images of height x width once: those that are missing with a null v, repeated ones with the largest."""
    ys, xs = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (height, width))
    cells = df.select("image").distinct().select("image", ys.alias("y")).select("image", "y", xs.alias("x"), F.lit(None).cast("double").alias("v"))
    return df.select("image", "y", "x", "v").unionByName(cells).repartition("image", "y").groupBy("image", "y", "x").agg(F.max("v").alias("v"))


def classic(df: DataFrame, size: int = 3, shape: tuple[int, int] | None = None) -> DataFrame:
    """Close, open, close with an ellipse of size x size pixels (3: a cross).

    Without a shape images are dense grids. With one (height, width) pixels may be missing: they count in no extreme, and get one where the
    element reaches a pixel that has a value.
    """
    if shape:
        return classic(dense(df, *shape), size).where("v is not null")
    for how in ("max", "min", "min", "max", "max", "min"):
        df = ellipse_extreme(df, size, how)
    return df


def directional(df: DataFrame, kv: int = 5, kh: int = 5, bridge: bool = True) -> DataFrame:
    """Close along the columns, then along the rows, then (if asked) with the 3 x 3 square."""
    df = close_along(close_along(df, "y", kv), "x", kh)
    return close_along_square(df) if bridge else df


def close_along_square(df: DataFrame) -> DataFrame:
    for how in ("max", "min"):
        df = along(along(df, "y", 1, 1, how), "x", 1, 1, how)
    return df


def morphology(df: DataFrame, mode: str = "directional", kv: int = 5, kh: int = 5, bridge: bool = True, size: int = 3, shape: tuple[int, int] | None = None) -> DataFrame:
    return df if mode == "none" else classic(df, size, shape) if mode == "classic" else directional(df, kv, kh, bridge)


def shave_weak(mask: DataFrame, prob: DataFrame, below: float) -> DataFrame:
    """Opens the part of the mask where the probability is low, along the columns, then along the rows, with lines of three; set pixels
    of higher probability stay and don't hold up their weak neighbours."""
    both = mask.join(prob.select("image", "y", "x", F.col("v").alias("_p")), ["image", "y", "x"]).withColumn("_strong", F.when(F.col("_p") < below, 0.0).otherwise(F.col("v")))
    weak = both.withColumn("v", F.when(F.col("_p") < below, F.col("v")).otherwise(0.0)).drop("_p", "_strong")
    opened = open_along(open_along(weak, "y", 3), "x", 3).select("image", "y", "x", F.col("v").alias("_o"))
    return both.join(opened, ["image", "y", "x"]).withColumn("v", F.greatest("_o", "_strong")).drop("_o", "_p", "_strong")


def neighbours(on: DataFrame, steps: list[tuple[int, int]] = EIGHT) -> DataFrame:
    """image, y, x, ny, nx: pairs of set pixels that touch, each in both directions; or only those with given steps from (ny, nx) to (y, x).

    Pixels grow with the images, and files of them are small for the rows they hold: they are joined by shuffle, never sent to the driver.
    """
    moves = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])
    sent = on.select("image", F.col("y").alias("ny"), F.col("x").alias("nx"), F.explode(moves).alias("m")).select("image", (F.col("ny") + F.col("m.dy")).alias("y"), (F.col("nx") + F.col("m.dx")).alias("x"), "ny", "nx")
    return on.select("image", "y", "x").join(sent.hint("merge"), ["image", "y", "x"])


def degrees(on: DataFrame) -> DataFrame:
    """Set pixels with the number of set neighbours."""
    d = neighbours(on).groupBy("image", "y", "x").agg(F.count(F.lit(1)).alias("degree"))
    return on.select("image", "y", "x").join(d, ["image", "y", "x"], "left").na.fill(0, ["degree"])


def prune_ends(on: DataFrame, rounds: int) -> DataFrame:
    """Removes pixels with one neighbour, so many times."""
    for _ in range(rounds):
        on = degrees(on).where("degree <> 1").drop("degree")
    return on


def label(on: DataFrame) -> DataFrame:
    """image, y, x, label: 8-connected components of set pixels, named by their first pixel (y, then x).

    The table of components grows with the pixels, though its file is small: it is joined by shuffle, never sent to the driver.
    """
    code = lambda y, x: F.shiftleft(F.col("image").cast("long"), 40) + F.shiftleft(F.col(y).cast("long"), 20) + F.col(x)
    edges = neighbours(on, ONWARD).select(code("y", "x").alias("a"), code("ny", "nx").alias("b"))
    got = components(edges)
    return on.select("image", "y", "x", code("y", "x").alias("_c")).join(got.hint("merge"), F.col("_c") == F.col("node"), "left").select("image", "y", "x", F.coalesce("root", "_c").alias("label"))


def large_components(labelled: DataFrame, least_pixels: int, least_rows: int) -> DataFrame:
    good = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.max("y") - F.min("y") + 1).alias("h")).where((F.col("n") >= least_pixels) & (F.col("h") >= least_rows))
    return labelled.join(good.select("label").hint("merge"), "label", "left_semi")


def hysteresis(df: DataFrame, low: float, high: float) -> DataFrame:
    """Components of pixels above `low` that hold one above `high`."""
    weak = df.where(F.col("v") > low)
    named = label(weak).join(weak, ["image", "y", "x"])
    return named.join(named.where(F.col("v") > high).select("label").distinct(), "label", "left_semi").select("image", "y", "x")


def junction_suppression(on: DataFrame, prob: DataFrame) -> DataFrame:
    """Drops junctions (three neighbours or more) next to a set pixel of higher probability."""
    p = on.join(prob.select("image", "y", "x", "v"), ["image", "y", "x"])
    near = neighbours(on).join(p.select("image", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv")), ["image", "ny", "nx"])
    top = near.groupBy("image", "y", "x").agg(F.max("nv").alias("nv"), F.count(F.lit(1)).alias("degree"))
    return p.join(top, ["image", "y", "x"], "left").where(F.coalesce((F.col("degree") < 3) | (F.col("nv") <= F.col("v")), F.lit(True))).select("image", "y", "x")


def reflect(i: Column, n: int) -> Column:
    """Index into n pixels of a place beyond the end, mirrored without repeating the last pixel."""
    return F.when(i < n, i).otherwise(2 * (n - 1) - i) if n > 1 else F.lit(0)


def pad(df: DataFrame, height: int, width: int, to_h: int, to_w: int) -> DataFrame:
    """Mirrored below and to the right; each extra row or column is sent by its source, at most once each way."""
    ys = F.filter(F.array(F.col("y"), F.when(F.col("y") < height - 1, 2 * (height - 1) - F.col("y"))), lambda c: c.isNotNull() & (c < to_h))
    xs = F.filter(F.array(F.col("x"), F.when(F.col("x") < width - 1, 2 * (width - 1) - F.col("x"))), lambda c: c.isNotNull() & (c < to_w))
    return df.select("image", "v", F.explode(ys).alias("y"), "x").where(F.col("y") < to_h).select("image", "v", "y", F.explode(xs).alias("x")).select("image", "y", "x", "v")


def tile_starts(n: int, size: int, stride: int) -> list[int]:
    """Tile origins; the last tile is flush with the edge."""
    if n <= size:
        return [0]
    starts = list(range(0, n - size + 1, stride))
    return starts if starts[-1] == n - size else [*starts, n - size]


def blend(tiles: DataFrame, size: int) -> DataFrame:
    """One value per pixel from overlapping tiles (image, ty, tx, y, x, v): weights 0.25 + 0.75 Hann, both ways."""
    hann = lambda k: 0.5 - 0.5 * F.cos(2 * F.pi() * k / (size - 1))
    w = (0.25 + 0.75 * hann(F.col("y") - F.col("ty"))) * (0.25 + 0.75 * hann(F.col("x") - F.col("tx")))
    return tiles.groupBy("image", "y", "x").agg((F.sum(F.col("v") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("v"))


def auto_threshold(df: DataFrame, low: float = 15.0, high: float = 25.0, sweep: tuple[float, float, int] = (0.12, 0.30, 19)) -> DataFrame:
    """image, threshold: of the sweep's thresholds (first, last, how many; two at least) the first whose coverage is nearest the middle of
    [low, high] percent."""
    first, last, n = sweep[0], sweep[1], max(2, sweep[2])
    t = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(float(first)) + k * F.lit((last - first) / (n - 1)))
    # Each pixel adds to the thresholds it reaches: n counts per image and task before the exchange.
    size = df.groupBy("image").agg(F.count(F.lit(1)).alias("_n"))
    hit = df.select("image", "v", F.posexplode(t).alias("k", "t")).groupBy("image", "k", "t").agg(F.count_if(F.col("v") >= F.col("t")).alias("c"))
    off = F.round(F.abs(100 * F.col("c") / F.col("_n") - (low + high) / 2), 9)
    return hit.join(size, "image").groupBy("image").agg(F.min_by("t", F.struct(off, F.col("k"))).alias("threshold"))


def resize_weights(n: int, to: int, how: str) -> list[tuple[int, int, float]]:
    """(out, at, w): how much of each of n samples goes into each of `to` new ones.

    area: by the share of the new cell that a sample covers. linear: the two samples beside the new cell's middle, no smoothing.
    bilinear: a triangle around the middle as wide as two cells of the coarser grid.
    """
    scale, out = n / to, []
    for o in range(to):
        middle = (o + 0.5) * scale
        if how == "area":
            w = {i: min((o + 1) * scale, i + 1) - max(o * scale, i) for i in range(math.floor(o * scale), min(n, math.ceil((o + 1) * scale)))}
        elif how == "linear":
            at = min(max(middle - 0.5, 0.0), n - 1.0)
            i = min(math.floor(at), max(n - 2, 0))
            w = {i: 1 - (at - i), min(i + 1, n - 1): at - i} if n > 1 else {0: 1.0}
        elif how == "bilinear":
            reach = max(scale, 1.0)
            w = {i: max(0.0, 1 - abs(i + 0.5 - middle) / reach) for i in range(max(0, int(middle - reach + 0.5)), min(n, int(middle + reach + 0.5)))}
        else:
            raise ValueError(f"no such resampling: {how}")
        total = sum(w.values())
        out += [(o, i, x / total) for i, x in w.items() if x > 1e-12]
    return out


def resize(df: DataFrame, height: int, width: int, to_height: int, to_width: int, how: str = "area") -> DataFrame:
    """Images of height x width pixels resampled to any other size: rows by a table of weights, then columns by another.

    The tables have a few rows for each row and column of an image and are broadcast; a sum of rows is combined before the exchange.
    """
    spark = df.sparkSession
    for axis, other, n, to in (("y", "x", height, to_height), ("x", "y", width, to_width)):
        table = spark.createDataFrame(resize_weights(n, to, how), "out int, at int, w double")
        met = df.join(F.broadcast(table), F.col(axis) == F.col("at"))
        df = met.groupBy("image", other, F.col("out").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return df.select("image", "y", "x", "v")


def resize_bytes(df: DataFrame, channels: list[str], height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """image, y, x and channels of whole numbers (0 to 255), resampled by triangles along the columns, then along the rows, and rounded
    after each, as image libraries do."""
    spark = df.sparkSession
    for axis, other, n, to in (("x", "y", width, to_width), ("y", "x", height, to_height)):
        if n == to:
            continue
        table = spark.createDataFrame(resize_weights(n, to, "bilinear"), "out int, at int, w double")
        met = df.join(F.broadcast(table), F.col(axis) == F.col("at"))
        byte = lambda c: F.floor(F.round(F.sum(F.col(c) * F.col("w")), 6) + 0.5).cast("int").alias(c)
        df = met.groupBy("image", other, F.col("out").alias(axis)).agg(*[byte(c) for c in channels])
    return df.select("image", "y", "x", *channels)


def target_size(width: int, height: int, to_width: int | None, to_height: int | None) -> tuple[int, int]:
    """Width and height of a resized image: what is asked, the other side in proportion (halves to even), one at least."""
    if to_width and to_height:
        return to_width, to_height
    if to_width:
        return to_width, max(1, round(height * to_width / max(1, width)))
    if to_height:
        return max(1, round(width * to_height / max(1, height))), to_height
    return width, height


def hex_color(value: str | None) -> tuple[int, int, int] | None:
    """Red, green and blue of #rgb or #rrggbb, with or without the mark; none for none or blank."""
    raw = (value or "").strip().lstrip("#")
    if not raw:
        return None
    raw = "".join(c * 2 for c in raw) if len(raw) == 3 else raw
    if len(raw) != 6 or any(c not in "0123456789abcdefABCDEF" for c in raw):
        raise ValueError(f"not a color of six hexadecimal digits: {value!r}")
    return int(raw[:2], 16), int(raw[2:4], 16), int(raw[4:], 16)


def heatmap_of_image(df: DataFrame, height: int, width: int, cfg: dict | None = None) -> DataFrame:
    """image, y, x, v (0 to 255), or r, g, b without grayscale: uploads as heatmaps.

    df has image, y, x, r, g, b and, where there is transparency, a, of images of one size. They are laid over alpha_background, resized
    to target_width and target_height, projected to the axis from low_hex to high_hex or to their luminance, inverted and cut at
    binary_threshold, as far as cfg asks for each. Two equal axis colors and a threshold outside [0, 1] are refused.
    """
    cfg = cfg or {}
    cut = float(cfg.get("binary_threshold", 0.5))
    if not 0.0 <= cut <= 1.0:
        raise ValueError("binary_threshold lies between 0 and 1")
    rgb, low, high = ["r", "g", "b"], hex_color(cfg.get("low_hex")), hex_color(cfg.get("high_hex"))
    under = hex_color(cfg.get("alpha_background", "#000000")) or (0, 0, 0)
    if "a" in df.columns:
        over = lambda c, k: F.floor((F.col(c) * F.col("a") + F.lit(k) * (255 - F.col("a"))) / 255 + 0.5).cast("int")
        df = df.withColumns({c: over(c, k) for c, k in zip(rgb, under, strict=True)})
    to_width, to_height = target_size(width, height, cfg.get("target_width", cfg.get("internal_width")), cfg.get("target_height", cfg.get("internal_height")))
    df = resize_bytes(df.select("image", "y", "x", *rgb), rgb, height, width, to_height, to_width)
    if not cfg.get("grayscale", True):
        return df
    if low and high:
        axis = [b - a for a, b in zip(low, high, strict=True)]
        if not any(axis):
            raise ValueError("low_hex and high_hex are different colors")
        along = sum(((F.col(c) - a) * d for c, a, d in zip(rgb, low, axis, strict=True)), F.lit(0)) / sum(d * d for d in axis)
        gray = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    else:
        gray = (0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")) / 255
    gray = 1 - gray if cfg.get("invert") else gray
    gray = (F.round(gray, 9) >= cut).cast("double") if cfg.get("binary_grayscale") else gray
    return df.select("image", "y", "x", F.floor(F.round(gray * 255, 6)).cast("int").alias("v"))


def thin(on: DataFrame) -> DataFrame:
    """One-pixel skeletons by two-subiteration parallel thinning; one image a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = {(int(y), int(x)) for y, x in zip(pdf["y"], pdf["x"], strict=True)}
        ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
        while True:
            before = len(pixels)
            for first in (True, False):
                gone = []
                for y, x in pixels:
                    p = [(y + a, x + b) in pixels for a, b in ring]
                    rises = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                    sides = (not (p[0] and p[2] and p[4]) and not (p[2] and p[4] and p[6])) if first else (not (p[0] and p[2] and p[6]) and not (p[0] and p[4] and p[6]))
                    if rises == 1 and 2 <= sum(p) <= 6 and sides:
                        gone.append((y, x))
                pixels.difference_update(gone)
            if len(pixels) == before:
                break
        out = sorted(pixels)
        return pd.DataFrame({"image": pdf["image"].iloc[0], "y": [p[0] for p in out], "x": [p[1] for p in out]})

    return on.select("image", "y", "x").groupBy("image").applyInPandas(run, "image long, y int, x int")


def line(y0: int, x0: int, y1: int, x1: int) -> list[tuple[int, int]]:
    """Integer points between two pixels, ends included (Bresenham)."""
    dy, dx = abs(y1 - y0), abs(x1 - x0)
    sy, sx, err, out = (1 if y1 >= y0 else -1), (1 if x1 >= x0 else -1), dx - dy, []
    while True:
        out.append((y0, x0))
        if (y0, x0) == (y1, x1):
            return out
        e = 2 * err
        if e > -dy:
            err, x0 = err - dy, x0 + sx
        if e < dx:
            err, y0 = err + dx, y0 + sy


def line_points(y0: Column, x0: Column, y1: Column, x1: Column) -> Column:
    """The points of `line` as [y, x] pairs: one for each step of the longer side, the other side rounded, halves to the start's side."""
    dy, dx = F.abs(y1 - y0), F.abs(x1 - x0)
    n = F.greatest(dy, dx)

    def at(k: Column, start: Column, end: Column, side: Column) -> Column:
        steps = F.when(n == 0, 0).otherwise(F.floor((2 * k * side + n - 1) / F.greatest(2 * n, F.lit(1))))
        return (start + F.when(end >= start, steps).otherwise(-steps)).cast("int")

    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: F.array(at(k, y0, y1, dy), at(k, x0, x1, dx)))


def _bridged(lit: np.ndarray, p: np.ndarray, max_gap: int, max_dx: int, least: float, most: int) -> np.ndarray:
    """Draws the lines between ends of one skeleton (rows by columns, 0 and 1)."""
    around = np.pad(lit, 1)
    near = sum(around[1 + a : 1 + a + lit.shape[0], 1 + b : 1 + b + lit.shape[1]] for a, b in EIGHT)
    ys, xs = np.nonzero((lit == 1) & (near == 1))
    rows = {int(y): xs[ys == y].tolist() for y in np.unique(ys)}
    out, made = lit.copy(), 0

    def partners(y: int, x: int) -> Iterator[tuple[int, int]]:
        below = y + 1
        while below <= y + max_gap and below in rows:
            yield from ((below, other) for other in rows[below] if abs(other - x) <= max_dx)
            below += 1

    for start in zip(ys.tolist(), xs.tolist(), strict=True):
        for end in partners(*start):
            at = tuple(np.array(line(*start, *end)).T)
            if made < most and out[at].mean() <= 0.25 and p[at].mean() >= least:
                out[at] = 1
                made += 1
    return out


def bridge_gaps(on: DataFrame, prob: DataFrame, max_gap: int = 18, max_dx: int = 7, least: float = 0.11, most: int = 2000) -> DataFrame:
    """Joins ends of skeletons across rows by lines that are mostly off (a quarter of the pixels set at most) and likely enough on
    average; at most `most` an image. The result is thinned.

    An end looks for partners in the rows below it, up to max_gap, and only as far as every row on the way has an end somewhere; it may be
    joined with several. on are set pixels, prob all pixels of the images.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        lit, p = np.zeros((y.max() + 1, x.max() + 1), np.uint8), np.zeros((y.max() + 1, x.max() + 1))
        lit[y, x], p[y, x] = pdf["on"], pdf["v"]
        ys, xs = np.nonzero(_bridged(lit, p, max_gap, max_dx, least, most))
        return pd.DataFrame({"image": pdf["image"].iloc[0], "y": ys.astype("int32"), "x": xs.astype("int32")})

    marked = prob.select("image", "y", "x", "v").join(on.select("image", "y", "x", F.lit(True).alias("on")), ["image", "y", "x"], "left").na.fill(False, ["on"])
    return thin(marked.groupBy("image").applyInPandas(run, "image long, y int, x int"))


def overlaps(points: DataFrame) -> DataFrame:
    """a, b, shared, overlap, mean_dx of tracks (image, track, y, x) that share rows: shared rows over those of the shorter track."""
    size = points.groupBy("image", "track").agg(F.count(F.lit(1)).alias("n"))
    p = points.join(size, ["image", "track"])
    q = p.select("image", "y", F.col("track").alias("b"), F.col("x").alias("xb"), F.col("n").alias("nb"))
    met = p.withColumnRenamed("track", "a").join(q, ["image", "y"]).where("a < b")
    g = met.groupBy("image", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("na"), F.first("nb").alias("nb"), F.avg(F.abs(F.col("x") - F.col("xb"))).alias("mean_dx"))
    return g.select("image", "a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("overlap"), "mean_dx")


def greedy_dedupe(tracks: DataFrame, pairs: DataFrame, overlap: float, dx: float) -> DataFrame:
    """Tracks (image, track, score, n) that stay when, best first, each drops those that overlap with it and lie close.

    The pairs that conflict are few; each image's are folded in one group.
    """
    bad = pairs.where((F.col("overlap") >= overlap) & (F.col("mean_dx") <= dx))
    both = bad.select("image", F.col("a").alias("track"), F.col("b").alias("other")).unionByName(bad.select("image", F.col("b").alias("track"), F.col("a").alias("other")))
    rows = tracks.join(both.groupBy("image", "track").agg(F.collect_list("other").alias("others")), ["image", "track"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "n", "track"], ascending=[False, False, True])
        kept: set[int] = set()
        for t, others in zip(pdf["track"], pdf["others"], strict=True):
            if others is None or not kept.intersection(others):
                kept.add(t)
        return pdf[pdf["track"].isin(kept)][["image", "track", "score", "n"]]

    return rows.groupBy("image").applyInPandas(run, "image long, track long, score double, n long")


def gap_candidates(ends: DataFrame, max_gap: int, max_dx: float) -> DataFrame:
    """Pairs of an end and a start below it: a band join on rows, dealt by bands of max_gap rows."""
    a = ends.select("image", F.col("track").alias("a"), "y1", "x1", F.explode(F.array(F.floor(F.col("y1") / max_gap), F.floor(F.col("y1") / max_gap) + 1)).alias("band"))
    b = ends.select("image", F.col("track").alias("b"), "y0", "x0", F.floor(F.col("y0") / max_gap).alias("band"))
    met = a.join(b, ["image", "band"])
    gap = F.col("y0") - F.col("y1")
    return met.where((gap > 0) & (gap <= max_gap) & (F.abs(F.col("x0") - F.col("x1")) <= max_dx) & (F.col("a") != F.col("b"))).select("image", "a", "b", gap.alias("gap"))


def extend_ends(ends: DataFrame, prob: DataFrame, rows: int = 10, dx: int = 3, least: float = 0.12) -> DataFrame:
    """image, track, side (-1 above the start, 1 below the end), i, y, x: the points by which tracks grow.

    From each end (columns as of merge_chains) a walk goes row by row to the most probable pixel at most dx aside, the leftmost of equals,
    until that is below `least`, the image ends, or `rows` steps are made. prob has image, y, x, v; pixels it lacks count as 0. An image is
    one group, its tracks walk together.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["image", "track", "side", "i", "y", "x"])
        if left.empty or right.empty:
            return empty
        h, w = int(right["y"].max()) + 1, int(right["x"].max()) + 1
        grid = np.full((h, w + 2 * dx), -np.inf)
        grid[:, dx : dx + w] = 0.0
        grid[right["y"], right["x"] + dx] = right["v"]
        found = [empty]
        for side, cy, cx in ((-1, "y0", "x0"), (1, "y1", "x1")):
            on = left[["track", cy, cx]].set_axis(["track", "y", "x"], axis=1)
            for i in range(rows):
                on = on.assign(y=on["y"] + side)
                on = on[on["y"].between(0, h - 1) & on["x"].between(-dx, w - 1 + dx)]
                if on.empty:
                    break
                at = on["x"].to_numpy()[:, None] + np.arange(-dx, dx + 1)
                near = np.where((at >= 0) & (at < w), grid[on["y"].to_numpy()[:, None], np.clip(at, -dx, w - 1 + dx) + dx], -np.inf)
                best = near.argmax(1)
                on = on.assign(x=on["x"] - dx + best)[near[np.arange(len(on)), best] >= least]
                found.append(on.assign(side=side, i=i))
        out = pd.concat([f for f in found if len(f)] or [empty])
        return out.assign(image=left["image"].iloc[0])[["image", "track", "side", "i", "y", "x"]]

    return ends.groupBy("image").cogroup(prob.select("image", "y", "x", "v").groupBy("image")).applyInPandas(run, "image long, track long, side int, i int, y int, x int")


def track_limits(points: DataFrame) -> DataFrame:
    """image, track, y0, x0, y1, x1: the first and the last point of each track (image, track, y, x) by row, then column."""
    g = points.groupBy("image", "track").agg(F.min(F.struct("y", "x")).alias("a"), F.max(F.struct("y", "x")).alias("b"))
    return g.select("image", "track", F.col("a.y").alias("y0"), F.col("a.x").alias("x0"), F.col("b.y").alias("y1"), F.col("b.x").alias("x1"))


def bridges(ends: DataFrame, prob: DataFrame, max_gap: int, max_dx: int, least: float) -> DataFrame:
    """image, a, ya, b, yb: gap_candidates whose straight bridge (as many points as rows to go, between the ends) has a mean probability of
    at least `least`; ya and yb are the rows in which the two tracks start."""
    e, s = ends.select("image", F.col("track").alias("a"), F.col("y0").alias("ya"), F.col("x1").alias("xa"), F.col("y1").alias("ea")), ends.select("image", F.col("track").alias("b"), F.col("y0").alias("yb"), F.col("x0").alias("xb"))
    c = gap_candidates(ends, max_gap, max_dx).join(e, ["image", "a"]).join(s, ["image", "b"])
    part = F.explode(F.sequence(F.lit(1), F.col("gap").cast("int"))).alias("k")
    k = c.select("image", "a", "ya", "b", "yb", "gap", "ea", "xa", "xb", part)
    on = lambda u, v: F.floor(F.col(u) + F.col("k") * (F.col(v) - F.col(u)) / (F.col("gap") + 1)).cast("int")
    k = k.withColumn("y", on("ea", "yb")).withColumn("x", on("xa", "xb")).join(prob.select("image", "y", "x", "v"), ["image", "y", "x"], "left")
    mean = k.groupBy("image", "a", "ya", "b", "yb").agg(F.avg(F.coalesce("v", F.lit(0.0))).alias("p"))
    return mean.where(F.col("p") >= least).drop("p")


def chained(pairs: DataFrame) -> DataFrame:
    """image, track, chain of tracks that follow another: heads in order of their start take the first free follower, then its follower.

    pairs as of bridges; those of an image are few and are folded in one group. Tracks that are no one's follower don't come out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        follow = {a: g["b"].tolist() for a, g in pdf.sort_values(["yb", "b"]).groupby("a")}
        used: set[int] = set()
        rows = []
        for head in pdf[["ya", "a"]].drop_duplicates().sort_values(["ya", "a"])["a"]:
            here = None if head in used else head
            while here is not None:
                here = next((b for b in follow.get(here, ()) if b not in used), None)
                if here is not None:
                    used.add(here)
                    rows.append((pdf["image"].iloc[0], here, head))
            used.add(head)
        return pd.DataFrame(rows, columns=["image", "track", "chain"])

    return pairs.groupBy("image").applyInPandas(run, "image long, track long, chain long")


def refine(points: DataFrame, prob: DataFrame, rows: int = 10, dx: int = 3, least: float = 0.12, max_gap: int = 6, max_dx: int = 4, bridge_least: float = 0.10) -> DataFrame:
    """image, track, y, x: tracks grown at both ends, joined where one ends shortly above another and the bridge is probable enough.

    A row may hold several points afterwards; kernels.collapse leaves one. A joined track keeps its topmost part's name.
    """
    grown = stash(points.unionByName(extend_ends(track_limits(points), prob, rows, dx, least).select("image", "track", "y", "x")), "grown-tracks")
    chains = chained(bridges(track_limits(grown), prob, max_gap, max_dx, bridge_least))
    return grown.join(chains, ["image", "track"], "left").select("image", F.coalesce("chain", "track").alias("track"), "y", "x")


def nearest_within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """q, track, dist: the nearest point (other than q itself) within the radius."""
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.sequence(F.lit(-1), F.lit(1))
    q = queries.select("q", F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(near).alias("i"), cell("x").alias("cx"), cell("y").alias("cy")).select("*", F.explode(near).alias("j"))
    q = q.select("q", "qx", "qy", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    met = q.join(points.select("track", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")), ["cx", "cy"])
    dist = F.sqrt(F.pow(F.col("qx") - F.col("x"), F.lit(2)) + F.pow(F.col("qy") - F.col("y"), F.lit(2)))
    met = met.where("track <> q").withColumn("dist", dist).where(F.col("dist") <= radius)
    return met.groupBy("q").agg(F.min_by("track", F.struct("dist", "track")).alias("track"), F.min("dist").alias("dist"))


def rescale(c: Column, scale: float) -> Column:
    """A pixel's centre in another resolution, half-even."""
    return F.bround((c + 0.5) * scale - 0.5).cast("int")


def row_normalise(df: DataFrame) -> DataFrame:
    """Each row over its mean (if positive), then the image spread over [0, 1]."""
    mean = F.avg("v").over(Window.partitionBy("image", "y"))
    d = df.withColumn("v", F.when(mean > 0, F.col("v") / mean).otherwise(F.col("v")))
    w = Window.partitionBy("image")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return d.withColumn("v", F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(0.0))
