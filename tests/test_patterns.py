"""Pattern rewriting, one-way tracks, ellipses, resampling and lines against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators import patterns as P


def pixels(spark, images):
    return spark.createDataFrame([(i, y, x) for i, on in enumerate(images) for y, x in on], "image long, y int, x int")


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["image"], set()).add((r["y"], r["x"]))
    return out


STEP = dict(zip(P.NAMES, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)], strict=True))


def plain_round(on, fill, clear, h=9, w=9):
    fits = lambda p, pattern: all((p[0] + STEP[n][0], p[1] + STEP[n][1]) in on for n in pattern[0].split()) and not any((p[0] + STEP[n][0], p[1] + STEP[n][1]) in on for n in pattern[1].split())
    return {p for p in ((y, x) for y in range(h) for x in range(w)) if (p in on and not any(fits(p, c) for c in clear)) or (p not in on and any(fits(p, f) for f in fill))}


@pytest.fixture(scope="module")
def random_images():
    r = random.Random(11)
    return [{(y, x) for y in range(9) for x in range(9) if r.random() < density} for density in (0.1, 0.3, 0.5, 0.7, 0.9) for _ in range(8)]


@pytest.mark.parametrize("fill, clear", [(P.FILL_SIDES, []), (P.FILL_HALVES, P.CLEAR_HALVES), ([], P.CHEW_ENDS)])
def test_one_round_equals_plain_version(spark, random_images, fill, clear):
    out = got(P.rewrite(pixels(spark, random_images), fill, clear))
    for i, on in enumerate(random_images):
        assert out.get(i, set()) == plain_round(on, fill, clear)


def test_chewing_ends_at_a_fixed_point(spark, random_images):
    images = [*random_images, {(4, x) for x in range(9)}, {(4, 4)}]
    df, rounds, still = P.rewrite_all(pixels(spark, images), [], P.CHEW_ENDS)
    out = got(df)
    for i, on in enumerate(images):
        while (new := plain_round(on, [], P.CHEW_ENDS)) != on:
            on = new
        assert out.get(i, set()) == on
    assert still == 0 and rounds <= 9
    # A line of nine is chewed from both ends, four rounds and one that changes nothing.
    assert out[len(images) - 2] == {(4, 4)}


def test_swinging_masks_end_at_the_bound(spark):
    swing = [("W E", "")], [("W E", "")]
    df, rounds, still = P.rewrite_all(pixels(spark, [{(0, 0), (0, 2)}, {(3, 3)}]), *swing, most=4)
    assert rounds == 4 and still == 1 and got(df)[1] == {(3, 3)}


def test_beginnings(spark):
    column = {(y, 4) for y in range(2, 8)}
    out = got(P.beginnings(pixels(spark, [column, {(0, 0), (0, 1), (0, 2)}, column | {(2, 5), (2, 6)}])))
    # A row is chewed to its middle; a hook's inner pixel has two neighbours and stays, so nothing begins there.
    assert out == {0: {(2, 4)}, 1: {(0, 1)}}


def test_one_way_tracks(spark):
    h, w = 24, 30
    a = np.zeros((2, h, w))
    for y in range(20):
        a[0, y, 3 + y // 4 : 6 + y // 4] = 0.9  # three pixels wide
        a[1, y, 20] = 0.8
    a[0, 5:7, 25] = 0.9  # too short
    prob = spark.createDataFrame([(i, y, x, float(a[i, y, x])) for i in range(2) for y in range(h) for x in range(w)], "image long, y int, x int, v double")
    rows = P.one_way_tracks(prob, 0.5).collect()
    assert {(r["image"], r["track"]) for r in rows} == {(0, 0), (1, 0)}
    for r in rows:
        assert r["x"] == 20 if r["image"] else abs(r["x"] - (4 + r["y"] // 4)) <= 1
    for i in (0, 1):
        ys = sorted(r["y"] for r in rows if r["image"] == i)
        assert ys == list(range(ys[0], ys[-1] + 1)) and len(ys) >= 16


def test_branches_go_and_ends_stay(spark):
    line = {(y, 5) for y in range(12)}
    out = got(P.prune_branches(pixels(spark, [line | {(6, 6), (6, 7)}, line | {(6, x) for x in range(6, 12)}, {(0, 0), (0, 1)}]), 2))
    assert out == {0: line, 1: line | {(6, x) for x in range(6, 12)}}


def test_empty(spark):
    none = pixels(spark, [{(0, 0)}]).where("1 = 0")
    assert P.rewrite_all(none, [], P.CHEW_ENDS)[0].count() == 0 and P.beginnings(none).count() == 0
    assert P.one_way_tracks(none.withColumn("v", F.lit(1.0)), 0.5).count() == 0


def test_ellipse_extremes(spark):
    rng = np.random.default_rng(2)
    a = rng.random((9, 11))
    df = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(9) for x in range(11)], "image long, y int, x int, v double")
    for size in (1, 3, 5, 9):
        cells = [(dy, dx) for dy, reach in grid.ellipse(size) for dx in range(-reach, reach + 1)]
        for how, f in (("max", max), ("min", min)):
            want = {(y, x): f(a[y + dy, x + dx] for dy, dx in cells if 0 <= y + dy < 9 and 0 <= x + dx < 11) for y in range(9) for x in range(11)}
            assert {(r["y"], r["x"]): r["v"] for r in grid.ellipse_extreme(df, size, how).collect()} == want


def test_resize(spark):
    rng = np.random.default_rng(3)
    a = rng.random((12, 10))
    df = spark.createDataFrame([(7, y, x, float(a[y, x])) for y in range(12) for x in range(10)], "image long, y int, x int, v double")

    def resized(h, w, how):
        out = np.full((h, w), np.nan)
        for r in grid.resize(df, 12, 10, h, w, how).collect():
            out[r["y"], r["x"]] = r["v"]
        return out

    assert np.allclose(resized(4, 5, "area"), a.reshape(4, 3, 5, 2).mean((1, 3)))
    assert np.allclose(resized(12, 10, "linear"), a) and np.allclose(resized(12, 10, "bilinear"), a) and np.allclose(resized(12, 10, "area"), a)
    at = np.clip((np.arange(17) + 0.5) * 12 / 17 - 0.5, 0, 11)
    want = np.stack([np.interp(at, np.arange(12), a[:, x]) for x in range(10)], 1)
    assert np.allclose(resized(17, 10, "linear"), want) and np.allclose(resized(17, 10, "bilinear"), want)
    for how in ("area", "linear", "bilinear"):
        for n, to in ((50, 37), (5, 13), (1, 4), (7, 1)):
            sums = {}
            for o, i, x in grid.resize_weights(n, to, how):
                assert 0 <= i < n
                sums[o] = sums.get(o, 0) + x
            assert sums.keys() == set(range(to)) and all(abs(s - 1) < 1e-9 for s in sums.values())
    with pytest.raises(ValueError):
        grid.resize_weights(3, 2, "cubic")


def test_lines(spark):
    r = random.Random(5)
    ends = [tuple(r.randint(-9, 9) for _ in range(4)) for _ in range(300)] + [(0, 0, 0, 0), (0, 0, 3, 6), (0, 0, 6, 3), (2, 2, 5, 5)]
    df = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "k int, a int, b int, c int, d int")
    for row in df.select("k", grid.line_points(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert [tuple(p) for p in row[1]] == grid.line(*ends[row[0]])


def test_heatmaps_of_images(spark):
    rows = [(0, y, x, 40 * y, 30 * x, 7, 255 if x else 0) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(rows, "image long, y int, x int, r int, g int, b int, a int")
    plain = {(r["y"], r["x"]): r["v"] for r in grid.heatmap_of_image(df.drop("a"), 4, 5).collect()}
    assert plain == {(y, x): int((0.2126 * 40 * y + 0.7152 * 30 * x + 0.0722 * 7) / 255 * 255 + 1e-9) for y in range(4) for x in range(5)}
    clear = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in grid.heatmap_of_image(df, 4, 5, {"grayscale": False, "alpha_background": "#f00"}).collect()}
    assert clear[2, 0] == (255, 0, 0) and clear[2, 3] == (80, 90, 7)
    assert grid.heatmap_of_image(df, 4, 5, {"internal_height": 2}).count() == 2 * 2  # five columns halved, to even
    assert grid.target_size(64, 50, None, None) == (64, 50) and grid.target_size(1000, 1, 3, None) == (3, 1) and grid.target_size(9, 9, 4, 7) == (4, 7)
    assert grid.hex_color(" ") is None and grid.hex_color("#0aF") == (0, 170, 255)
    for cfg in ({"binary_threshold": 2}, {"low_hex": "#111", "high_hex": "111111"}, {"low_hex": "#12"}, {"low_hex": "#gggggg"}):
        with pytest.raises(ValueError):
            grid.heatmap_of_image(df, 4, 5, cfg)
