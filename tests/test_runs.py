"""Configured peaks, refined tracks, track files and event payloads against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid, kernels, relational, tracks
from tidemark.sources import files


def noisy(spark, n=120):
    random = np.random.default_rng(3)
    rows = [(k, i, float(i), 0.2 * i + 6 * math.sin(2 * math.pi * i / (12 + 4 * k)) + float(random.normal(0, 0.5))) for k in range(3) for i in range(n)]
    return spark.createDataFrame(rows + [(9, i, float(i), 4.0) for i in range(20)] + [(10, 0, 0.0, 1.0)], "track_index long, i int, frame double, position double")


@pytest.mark.parametrize("how", [{"prominence": 2.0, "width": 1.0, "distance": 4, "minimum_per_track": 1}, {"adaptive": True, "rel_mad_k": 1.5}, {"prominence": 1e9, "minimum_per_track": 0}])
def test_detection_follows_the_configuration(spark, how):
    res = kernels.robust_tracks(noisy(spark)).cache()
    freq = tracks.dominant_frequency(res, 1.0, 0.02, 0.45).cache()
    got = {(r["track_index"], r["peak_i"]): r for r in kernels.detect(res, how, freq).collect()}
    period = {r["track_index"]: 1 / r["frequency"] for r in freq.collect()}
    want = {}
    for t, g in res.toPandas().groupby("track_index"):
        x = g.sort_values("i")["residual"].to_numpy()
        found = kernels.find_peaks_adaptive(x, period[t], k=1.5) if how.get("adaptive") else kernels.find_peaks(x, how["prominence"], 1.0, how.get("distance"))
        for r in found.itertuples():
            want[t, r.peak_i] = (r.prominence, r.width, False)
        if found.empty and how.get("minimum_per_track", 1):
            want[t, int(np.argmax(x))] = (float(x.max() - np.median(x)), None, True)
    assert set(got) == set(want)
    for k, (prominence, width, spare) in want.items():
        assert got[k]["prominence"] == pytest.approx(prominence) and got[k]["width"] == (None if width is None else pytest.approx(width)) and got[k]["fallback_peak"] == spare


def test_widths_equal_the_kernel_and_bulge_seconds(spark):
    res = tracks.detrend(noisy(spark)).cache()
    rows = tracks.bulge(tracks.widths(res, tracks.find_peaks(res, 2.0)), 4.0).where("not fallback_peak").collect()
    plain = {t: g.sort_values("i")["residual"].to_numpy() for t, g in res.toPandas().groupby("track_index")}
    assert rows
    for r in rows:
        prominence, width = kernels.peak_shape(plain[r["track_index"]], np.array([r["peak_i"]]))
        assert (r["bulge_prominence_px"], r["bulge_width_frames"], r["bulge_width_s"]) == pytest.approx((prominence[0], width[0], width[0] / 4))


def test_flat_track_has_no_width(spark):
    res = tracks.detrend(noisy(spark)).where("track_index = 9")
    assert [r["width"] for r in tracks.widths(res, tracks.find_peaks(res, 2.0)).collect()] == [None]


def plain_refined(points, prob, rows, dx, least, max_gap, max_dx, bridge):
    """Tracks as sets of points by chain, pixel by pixel."""
    h, w = prob.shape

    def walk(y, x, step):
        out = []
        while len(out) < rows and 0 <= y + step < h:
            y += step
            x = max((c for c in range(max(0, x - dx), min(w - 1, x + dx) + 1)), key=lambda c: (prob[y, c], -c))
            if prob[y, x] < least:
                break
            out.append((y, x))
        return out

    grown = {t: sorted(p) for t, p in points.items()}
    grown = {t: [*walk(*p[0], -1)[::-1], *p, *walk(*p[-1], 1)] for t, p in grown.items()}
    order, used, out = sorted(grown, key=lambda t: (grown[t][0][0], t)), set(), {}
    for head in order:
        if head in used:
            continue
        used.add(head)
        line, last = list(grown[head]), grown[head][-1]
        while True:
            for t in order:
                (sy, sx), gap = grown[t][0], grown[t][0][0] - last[0]
                if t not in used and 0 < gap <= max_gap and abs(sx - last[1]) <= max_dx:
                    over = [prob[last[0] + (k * gap) // (gap + 1), last[1] + (k * (sx - last[1])) // (gap + 1)] for k in range(1, gap + 1)]
                    if np.mean(over) >= bridge:
                        break
            else:
                break
            used.add(t)
            line, last = line + grown[t], grown[t][-1]
        out[head] = set(line)
    return out


@pytest.mark.parametrize("bridge", [0.0, 0.3, 0.9])
def test_refined_tracks(spark, bridge):
    random = np.random.default_rng(11)
    pixels, rows, want = [], [], {}
    how = {"rows": 3, "dx": 2, "least": 0.55, "max_gap": 6, "max_dx": 4}
    for image in range(3):
        prob = np.round(random.random((40, 24)), 3)
        points = {}
        for t in range(8):
            y, x = int(random.integers(0, 34)), int(random.integers(2, 22))
            points[t] = [(y + k, int(np.clip(x + random.integers(-1, 2), 0, 23))) for k in range(int(random.integers(1, 6)))]
        pixels += [(image, y, x, float(prob[y, x])) for y in range(40) for x in range(24)]
        rows += [(image, t, y, x) for t, p in points.items() for y, x in p]
        want |= {(image, t): p for t, p in plain_refined(points, prob, 3, 2, 0.55, 6, 4, bridge).items()}
    p, v = spark.createDataFrame(rows, "image long, track long, y int, x int"), spark.createDataFrame(pixels, "image long, y int, x int, v double")
    got = {}
    for r in grid.refine(p, v, **how, bridge_least=bridge).collect():
        got.setdefault((r["image"], r["track"]), set()).add((r["y"], r["x"]))
    assert got == want


def test_tracks_without_an_image_stay(spark):
    p = spark.createDataFrame([(1, 1, 4, 2), (1, 1, 5, 2)], "image long, track long, y int, x int")
    none = spark.createDataFrame([], "image long, y int, x int, v double")
    assert sorted(map(tuple, grid.refine(p, none).collect())) == [(1, 1, 4, 2), (1, 1, 5, 2)]


def test_track_files(spark, tmp_path):
    import io

    def blob(a):
        out = io.BytesIO()
        np.save(out, a)
        return out.getvalue()

    (tmp_path / "in").mkdir()
    (tmp_path / "a.npy").write_bytes(blob(np.array([5, 7], np.int16)))
    (tmp_path / "in" / "b.npy").write_bytes(blob(np.array([[2.0, 9.0, 0], [1.0, 8.0, 0], [2.0, 7.0, 0]])))
    (tmp_path / "c.txt").write_text("no")
    blobs = files.read_blobs(spark, str(tmp_path), "*.npy")
    assert {r["name"]: bytes(r["content"]) for r in blobs.collect()} == {p.name: p.read_bytes() for p in tmp_path.rglob("*.npy")}
    got = sorted((r["path"][-5:], r["i"], r["frame"], r["position"]) for r in files.array_tracks(blobs).collect())
    assert got == [("a.npy", 0, 0.0, 5.0), ("a.npy", 1, 1.0, 7.0), ("b.npy", 0, 1.0, 8.0), ("b.npy", 1, 2.0, 9.0), ("b.npy", 2, 2.0, 7.0)]
    turned = [r["frame"] for r in files.array_tracks(blobs.where("name = 'b.npy'"), "xy").orderBy("i").collect()]
    assert turned == [7.0, 8.0, 9.0]
    bad = spark.createDataFrame([("x", bytearray(blob(np.zeros((2, 2, 2)))))], "path string, content binary")
    with pytest.raises(Exception, match="one dimension or two columns"):
        files.array_tracks(bad).collect()


def test_short_tracks_have_no_file(spark):
    t = spark.createDataFrame([(1, 0, 0.0, 1.0), (2, 1, 1.0, 5.0), (2, 0, 0.0, 4.0)], "track_index long, i int, frame double, position double")
    back = files.array_tracks(files.array_files(t, least=2)).orderBy("i").collect()
    assert [tuple(r) for r in back] == [("2.npy", 0, 0.0, 4.0), ("2.npy", 1, 1.0, 5.0)]


def test_loose_numbers(spark):
    texts = {"null": 0.0, '""': 0.0, '" 3 "': 3.0, "true": 1.0, "false": 0.0, '"abc"': None, "1e400": None, '"1d"': None, "-.5e1": None, "-0.5e1": -5.0, '"-.5e1"': -5.0}
    rows = spark.createDataFrame([(k, f'{{"track_index": {k}}}') for k in texts], "k string, t string")
    got = {r["k"]: r["n"] for r in rows.select("k", relational.overlay_tracks(F.col("t"))["track_index"].alias("n")).collect()}
    assert got == texts
    odd = spark.createDataFrame([("[]",), ("",), (None,), ("{}",), ('{"track_index": 1, "poly": 5, "peaks": null}',)], "t string").select(relational.overlay_tracks(F.col("t")).alias("o"))
    assert sorted((r["o"] and (r["o"]["poly"], r["o"]["peaks"], r["o"]["mean_amplitude"]) for r in odd.collect()), key=str) == [([], [], None), None, None, None, None]
