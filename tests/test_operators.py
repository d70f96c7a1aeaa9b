"""Operators against plain NumPy, properties that must hold, and plans that must not have nested loops."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import config, plans
from tidemark.operators import grid, kernels, relational, tracks
from tidemark.operators.components import components
from tidemark.sources import files

RATE = 20.0


def sine_tracks(spark, n=200):
    """position = a + b frame + A sin(2 pi f frame / rate), three tracks; then a flat one, and ones of one and two samples."""
    rows = []
    for k, (f, a) in enumerate([(1.0, 5.0), (2.0, 3.0), (0.5, 8.0)]):
        rows += [(k, i, float(i), 10 + 0.1 * i + a * math.sin(2 * math.pi * f * i / RATE)) for i in range(n)]
    rows += [(10, i, float(i), 4.0) for i in range(30)] + [(11, 0, 0.0, 1.0), (12, 0, 0.0, 1.0), (12, 1, 1.0, 2.0)]
    return spark.createDataFrame(rows, "track_index long, i int, frame double, position double")


def test_known_waves_are_recovered(spark):
    res = tracks.detrend(sine_tracks(spark)).cache()
    freq = {r["track_index"]: r["frequency"] for r in tracks.dominant_frequency(res, RATE, 0.1, 9.0).collect()}
    assert freq[0] == pytest.approx(1.0, abs=0.06) and freq[1] == pytest.approx(2.0, abs=0.06) and freq[2] == pytest.approx(0.5, abs=0.06)
    peaks = tracks.find_peaks(res, 1.0)
    n = {r["track_index"]: r["count"] for r in peaks.groupBy("track_index").count().collect()}
    assert n[0] == 10 and n[1] == 20 and n[2] == 5 and n[10] == n[11] == n[12] == 1
    rows = tracks.wave_rows(res, peaks, tracks.dominant_frequency(res, RATE, 0.1, 9.0), RATE).collect()
    assert len(rows) == sum(n.values())
    for r in rows:
        assert r["fit_amp"] + r["fit_offset"] == pytest.approx(r["residual"])
        assert r["frame1"] <= r["frame2"]
        if r["track_index"] == 1 and 0 < r["peak_ord"] - 1 < 19:
            assert r["fit_amp"] == pytest.approx(3.0, abs=0.3)
    by = {(r["track_index"], r["peak_ord"]): r for r in rows}
    assert all(by[(t, k)]["frame2"] == by[(t, k + 1)]["frame1"] for t, k in by if (t, k + 1) in by)
    res.unpersist()


def walk_prominence(x, p):
    def side(step):
        low, i = x[p], p
        while 0 <= i < len(x) and x[i] <= x[p]:
            low, i = min(low, x[i]), i + step
        return low

    return x[p] - max(side(-1), side(1))


def test_prominence_by_walking(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(4, 50)).round(1)
    rows = [(k, i, float(i), float(v)) for k in range(4) for i, v in enumerate(x[k])]
    df = spark.createDataFrame(rows, "track_index long, i int, frame double, residual double").withColumn("position", F.col("residual"))
    got = {(r["track_index"], r["peak_i"]): r["prominence"] for r in tracks.prominences(df).collect()}
    want = {(k, i): walk_prominence(x[k], i) for k in range(4) for i in range(1, 49) if x[k][i] > x[k][i - 1] and x[k][i] > x[k][i + 1]}
    assert got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=3, max_size=40))
def test_find_peaks_kernel(values):
    x = np.array(values, float)
    out = kernels.find_peaks(x, 1.0, 0.0)
    for p, prom in zip(out["peak_i"], out["prominence"], strict=True):
        assert prom == walk_prominence(x, p) >= 1
    spaced = kernels.find_peaks(x, 0.0, 0.0, 4)["peak_i"].to_numpy()
    assert all(b - a >= 4 for a, b in zip(spaced, spaced[1:], strict=False))


def test_robust_line_ignores_outliers():
    x = np.arange(100.0)
    y = 0.01 * x + np.where(x % 10 == 0, 50.0, 0.0)
    fit = kernels.robust_line(x, y)
    assert np.abs(fit - 0.01 * x)[x % 10 != 0].max() < 1.0
    assert np.allclose(kernels.robust_line(x[:1], y[:1]), y[0]) and len(kernels.robust_line(x[:0], y[:0])) == 0


def test_suppression_keeps_dominant():
    assert kernels.suppressed(np.array([3, 5, 20]), np.array([10.0, 4.0, 2.0]), 4, 0.55).tolist() == [True, False, True]
    assert kernels.suppressed(np.array([3, 5]), np.array([10.0, 8.0]), 4, 0.55).tolist() == [True, True]


def test_wavelet_peaks_find_bumps():
    x = np.exp(-((np.arange(120) - 30) ** 2) / 18) + np.exp(-((np.arange(120) - 80) ** 2) / 18)
    found = kernels.wavelet_peaks(x, [1.0, 2.0, 3.0, 4.0, 5.0])
    assert {30, 80} <= set(found.sort_values("strength", ascending=False)["peak_i"].head(2) // 1 * 1) or all(min(abs(found["peak_i"] - c)) <= 1 for c in (30, 80))


RULE_ROWS = [(1, 5, 2, 3.0, "Wave"), (2, 10, 0, None, "ripple"), (3, 20, 4, float("nan"), None)]


@pytest.mark.parametrize(
    ("rule", "want"),
    [(("mean_amplitude", "<", "1"), {2}), (("mean_amplitude", "<", ""), {1, 2, 3}), (("points", "between", "20", "6"), {2, 3}), (("points", "between", "6", None), {1, 2, 3}), (("sample", "contains", "WA"), {1}), (("sample", "!=", "wave"), {2, 3}),
     (("unknown", ">", "1"), {1, 2, 3}), (("points", "~", "1"), {1, 2, 3}), (("num_peaks", "==", "4"), {3}), (("points", ">", "x"), {1, 2, 3})],
)
def test_rules(spark, rule, want):
    df = spark.createDataFrame(RULE_ROWS, "track_index long, points long, num_peaks long, mean_amplitude double, sample string")
    assert {r[0] for r in relational.apply_rules(df, [rule]).collect()} == want


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", {"x": 1}), (2, "b", None)], "k long, v string, m map<string,int>")
    new = spark.createDataFrame([(1, None, {"y": 2, "x": 3}), (3, "c", None)], "k long, v string, m map<string,int>")
    once = relational.upsert(old, new, ["k"], maps=["m"])
    assert {r["k"]: (r["v"], r["m"]) for r in once.collect()} == {1: ("a", {"x": 3, "y": 2}), 2: ("b", {}), 3: ("c", {})}
    again = relational.upsert(once, new, ["k"], maps=["m"])
    assert {str(r) for r in again.collect()} == {str(r) for r in once.collect()}


def test_job_states(spark):
    log = spark.createDataFrame([(1, 1, "in_progress"), (1, 2, "queued"), (1, 3, "failed"), (1, 4, "in_progress"), (1, 5, "completed"), (1, 6, "failed"), (2, 1, "completed")], "job_id long, seq long, status string")
    assert {tuple(r) for r in relational.job_states(log).collect()} == {(1, "completed", 2), (2, "queued", 1)}


def grid_of(spark, *rows):
    return spark.createDataFrame([(0, y, x, float(c != ".")) for y, r in enumerate(rows) for x, c in enumerate(r)], "image long, y int, x int, v double")


def shown(df, h, w):
    on = {(r["y"], r["x"]) for r in df.collect()}
    return ["".join("#" if (y, x) in on else "." for x in range(w)) for y in range(h)]


def test_grid_operators(spark):
    g = grid_of(spark, "##....#", "##...#.", "....#..", ".......", "#.....#")
    on = g.where("v = 1").select("image", "y", "x")
    labels = {(r["y"], r["x"]): r["label"] for r in grid.label(on).collect()}
    assert len(set(labels.values())) == 4 and labels[(0, 6)] == labels[(2, 4)] and labels[(0, 0)] == labels[(1, 1)] == 0
    assert shown(grid.prune_ends(on, 1), 5, 7) == ["##.....", "##...#.", ".......", ".......", "#.....#"]
    assert {(r["y"], r["x"]) for r in grid.large_components(grid.label(on), 3, 3).collect()} == {(0, 6), (1, 5), (2, 4)}
    closed = grid.close_along(grid_of(spark, "#.#.", "....", "#...", "...."), "x", 3).where("v = 1")
    assert shown(closed, 4, 4)[0].startswith("###")
    thin = grid.thin(grid_of(spark, ".......", ".#####.", ".#####.", ".#####.", ".......").where("v = 1"))
    assert 1 <= thin.count() <= 5


def test_bridge_line_and_tiles(spark):
    assert grid.line(0, 0, 2, 4) == [(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)] or grid.line(0, 0, 2, 4)[-1] == (2, 4)
    assert grid.tile_starts(50, 32, 16) == [0, 16, 18] and grid.tile_starts(20, 32, 16) == [0] and grid.tile_starts(64, 32, 16) == [0, 16, 32]
    g = grid_of(spark, "..#..", "..#..", ".....", "..#..", "..#..").withColumn("p", F.lit(0.9))
    joined = grid.bridge_gaps(g.where("v = 1"), g.select("image", "y", "x", F.col("p").alias("v")), 4, 1)
    assert {r["y"] for r in joined.collect()} == {0, 1, 3, 4}  # a row between has no end, which stops the search
    # Ends at rows 1 and 9 of the third column, and an end in each row between, further right.
    lit, p = np.zeros((11, 12), np.uint8), np.full((11, 12), 0.9)
    lit[[0, 1, 9, 10], 2] = 1
    for y in range(2, 9):
        lit[y, 6:8] = 1 if y % 2 == 0 else 0
        lit[y, 10:12] = 1 if y % 2 else 0
    assert grid._bridged(lit, p, 18, 0, 0.11, 2000)[:, 2].tolist() == [1] * 11
    assert grid._bridged(lit, p, 7, 0, 0.11, 2000)[:, 2].sum() == 4  # too far
    assert grid._bridged(lit, p, 18, 0, 0.95, 2000)[:, 2].sum() == 4  # too unlikely
    gap = lit.copy()
    gap[5] = 0  # a row without an end
    assert grid._bridged(gap, p, 18, 0, 0.11, 2000)[:, 2].sum() == 4
    short = np.zeros((6, 8), np.uint8)
    short[[0, 1, 4, 5], 2] = 1
    short[2:4, 6:8] = [[1, 1], [0, 0]]
    assert (grid._bridged(short, np.ones((6, 8)), 18, 0, 0.11, 2000) == short).all()  # over a quarter of the line is set


def test_shave_and_hysteresis(spark):
    solid = grid_of(spark, ".....", ".###.", ".###.", ".###.", ".....")
    prob = solid.withColumn("v", F.when((F.col("y") == 2) & (F.col("x") == 2), 0.05).otherwise(0.9))
    # A weak pixel among strong ones is a line of one, so it goes.
    assert shown(grid.shave_weak(solid, prob, 0.1).where("v = 1"), 5, 5) == [".....", ".###.", ".#.#.", ".###.", "....."]
    assert shown(grid.shave_weak(solid, solid.withColumn("v", F.lit(0.05)), 0.1).where("v = 1"), 5, 5) == [".....", ".###.", ".###.", ".###.", "....."]
    steps = grid_of(spark, "##.##").withColumn("v", F.when(F.col("x") == 0, 0.2).when(F.col("x") == 3, 0.21).when(F.col("x") == 2, 0.1).otherwise(0.15))
    assert {r["x"] for r in grid.hysteresis(steps, 0.1, 0.2).collect()} == {3, 4}


def test_fallback_peaks(spark):
    nan = float("nan")
    values = {1: [0.0, nan, 3.0, 1.0, 3.0], 2: [nan, nan, nan], 3: [0.0, 9.0, 0.0, 5.0, 0.0]}
    df = spark.createDataFrame([(t, i, float(i), v, v) for t, vs in values.items() for i, v in enumerate(vs)], "track_index long, i int, frame double, position double, residual double")
    none = df.select("track_index", F.col("i").alias("peak_i"), "frame", "position", "residual", F.col("residual").alias("prominence"))
    got = {(r["track_index"], r["peak_i"]): (r["prominence"], r["fallback_peak"]) for r in tracks.with_fallback(df, none.where("1 = 0")).collect()}
    assert got == {(1, 2): (1.0, True), (2, 1): (None, True), (3, 1): (9.0, True)}
    one = none.where("track_index = 3 and peak_i = 3")
    assert {(r["peak_i"], r["fallback_peak"]) for r in tracks.with_fallback(df, one, 2).where("track_index = 3").collect()} == {(3, False), (1, True)}
    assert tracks.with_fallback(df, one, 1).where("track_index = 3").count() == 1


def test_dedupe_is_idempotent(spark):
    t = spark.createDataFrame([(0, k, s, 10) for k, s in enumerate([0.9, 0.8, 0.7])], "image long, track long, score double, n long")
    pairs = spark.createDataFrame([(0, 0, 1, 0.9, 1.0), (0, 1, 2, 0.9, 1.0)], "image long, a long, b long, overlap double, mean_dx double")
    kept = grid.greedy_dedupe(t, pairs, 0.5, 2.0)
    assert {r["track"] for r in kept.collect()} == {0, 2}
    assert {r["track"] for r in grid.greedy_dedupe(kept, pairs, 0.5, 2.0).collect()} == {0, 2}


def test_components_on_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(edges).collect()} == {0}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.integers(0, 1000))
def test_png_round_trip(h, w, channels, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, channels)).astype(np.uint8)
    assert (files.png_decode(files.png_encode(a[:, :, 0] if channels == 1 else a)) == a).all()


def test_table_cells_fail_on_text(spark):
    bad = spark.createDataFrame([("a.csv", bytearray(b"1;2\n3;x\n"))], "path string, content binary")
    with pytest.raises(Exception, match="not a number"):
        files.table_cells(bad).collect()
    good = spark.createDataFrame([("a.csv", bytearray("﻿1;2\n\n3;4,5\n".replace(",", ".").encode()))], "path string, content binary")
    assert [r["v"] for r in files.table_cells(good).orderBy("row", "col").collect()] == [1.0, 2.0, 3.0, 4.5]


def test_config():
    cfg = config.effective({"kymo": {"morphology": {"dir_kv": 7}}, "peaks": {"prominence": 2.0}})
    assert cfg["kymo"]["morphology"]["directional"] == {"kv": 7, "kh": 5, "diag_bridge": True} and cfg["peaks"]["width"] == 1.0
    assert config.axis_order(cfg) == "yx" and config.axis_order({"kymo": {"backend": "other"}}) == "xy" and config.axis_order({"kymo": {"track_xy_order": "XY"}}) == "xy"
    assert config.providers("a, b,") == ["a", "b"] and config.providers(None) is None
    for bad in ([], {"period": {"x": 1}}):
        with pytest.raises(ValueError):
            config.validate(bad)


@pytest.mark.parametrize("name", ["h2_wave_rows", "h1_peak_rows", "g10_prominence", "d4_track_overlap", "d7_nearest_track", "d2_gap_candidates", "i13_connected_components", "d9_latest_upload"])
def test_no_nested_loops(spark, name):
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    plan = plans.queries()["h5_track_detail"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vec_id,7)" in plan


def test_polynomials_of_any_degree(spark):
    rng = np.random.default_rng(8)
    made = {k: (np.sort(rng.choice(np.arange(400.0), n, replace=False)), rng.normal(size=n) * 50) for k, n in enumerate((1, 2, 3, 6, 40, 200))}
    rows = [(k, i, float(x), float(y)) for k, (xs, ys) in made.items() for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    df = spark.createDataFrame(rows, "track_index long, i int, frame double, position double")
    for degree in (0, 1, 2, 5, 9):
        got = {}
        for r in tracks.detrend_polynomial(df, degree).orderBy("track_index", "i").collect():
            got.setdefault(r["track_index"], []).append(r["baseline"])
        for k, (xs, ys) in made.items():
            fit = np.polynomial.Polynomial.fit(xs, ys, degree)(xs) if len(xs) > degree else ys
            assert np.allclose(got[k], fit, atol=1e-8 * max(1, np.abs(ys).max()))
    plan = tracks.detrend_polynomial(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    gap = df.where("track_index = 4").withColumn("position", F.when(F.col("i") != 7, F.col("position")))
    xs, ys = made[4]
    keep = np.arange(len(xs)) != 7
    want = np.polynomial.Polynomial.fit(xs[keep], ys[keep], 3)(xs)
    assert np.allclose([r["baseline"] for r in tracks.detrend_polynomial(gap, 3).orderBy("i").collect()], want)


@pytest.mark.parametrize("few", [0, 100, 10_000])
def test_components_either_way(spark, few):
    """By rounds, and in one task, of a random forest with cycles, numbers of either sign and repeated edges."""
    rng = np.random.default_rng(few)
    pairs = [(int(a) * 7 - 900, int(b) * 7 - 900) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(10_000, 10_150)] + [(5, 5), (-893, -900)] * 2
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), few).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), few).count() == 0
