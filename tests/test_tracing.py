"""Tracing through crossings against a plain walk, crops and masks against arrays."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators import tracing as T


def pixels(spark, images):
    rows = [(i, y, x) for i, (_, on) in enumerate(images) for y, x in on]
    return spark.createDataFrame(rows, "image long, y int, x int")


def drawn(*rows):
    return [(y, x) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"]


def plain_tracks(on):
    """All tracks of one skeleton: every undirected step once, the straightest pairs of steps joined inside each pixel."""
    on = set(on)
    around = lambda p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]

    def joined(p, q):
        return q in on and (p[0] == q[0] or p[1] == q[1] or ((p[0], q[1]) not in on and (q[0], p[1]) not in on))

    def turn(p, a, b):
        u, v = (p[0] - a[0], p[1] - a[1]), (b[0] - p[0], b[1] - p[1])
        return (u[0] * v[0] + u[1] * v[1]) / math.hypot(*u) / math.hypot(*v)

    follow = {}
    for p in on:
        near = [q for q in around(p) if joined(p, q)]
        ranked = sorted(((-round(turn(p, a, b), 9), i, j) for i, a in enumerate(near) for j, b in enumerate(near) if i < j))
        free = set(range(len(near)))
        for _, i, j in ranked:
            if {i, j} <= free:
                free -= {i, j}
                follow[near[i], p], follow[near[j], p] = near[j], near[i]
        for i in range(len(near)):
            follow.setdefault((near[i], p), None)
    tracks, used = [], set()

    def walk(a, b):
        out = [a, b]
        used.update([(a, b), (b, a)])
        while (c := follow[out[-2], out[-1]]) is not None and (out[-1], c) not in used:
            used.update([(out[-1], c), (c, out[-1])])
            out.append(c)
        return out

    steps = sorted((p, q) for p in on for q in around(p) if joined(p, q))
    for p, q in steps:  # ends first, then circles
        if follow[q, p] is None and (p, q) not in used:
            tracks.append(walk(p, q))
    for p, q in steps:
        if (p, q) not in used:
            tracks.append(walk(p, q)[:-1])
    return tracks


def found(df):
    out = {}
    for r in df.orderBy("image", "track", "i").collect():
        out.setdefault((r["image"], r["track"]), []).append((r["i"], (r["y"], r["x"])))
    for points in out.values():
        assert [i for i, _ in points] == list(range(len(points)))
    return {k: [p for _, p in v] for k, v in out.items()}


def normal(track):
    """A track read either way; circles from any pixel."""
    return min(track, track[::-1])


def test_two_crossing_lines_are_two_whole_tracks(spark):
    cross = [(i, i) for i in range(9)] + [(i, 8 - i) for i in range(9)]
    plus = [(4, x) for x in range(9)] + [(y, 4) for y in range(9)]
    got = found(T.trace(pixels(spark, [("x", set(cross)), ("+", set(plus))]), 3))
    assert {k: sorted(v) for k, v in got.items()} == {(0, 0): sorted((i, i) for i in range(9)), (0, 1): sorted((i, 8 - i) for i in range(9)), (1, 0): sorted((y, 4) for y in range(9)), (1, 1): sorted((4, x) for x in range(9))}
    assert sum((4, 4) in v for k, v in got.items() if k[0] == 0) == 2


def test_branch_ends_at_the_track_it_meets(spark):
    got = found(T.trace(pixels(spark, [("T", set([(y, 3) for y in range(7)] + [(3, x) for x in range(4, 8)]))]), 2))
    assert sorted(map(len, got.values())) == [5, 7] and all((3, 3) in v for v in got.values())


def test_circle_and_lone_pixel(spark):
    ring = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]
    got = found(T.trace(pixels(spark, [("o", set(ring) | {(9, 9)})]), 1))
    assert sorted(map(len, got.values())) == [1, 8] and got[0, 0][0] == (0, 1) and set(got[0, 0]) == set(ring)


@pytest.mark.parametrize("density", [0.25, 0.45, 0.7])
def test_random_grids_equal_plain_walks(spark, density):
    r = random.Random(int(density * 100))
    images = [(i, {(y, x) for y in range(8) for x in range(8) if r.random() < density}) for i in range(60)]
    got = found(T.trace(pixels(spark, images), 2))
    for i, on in images:
        want = [t for t in plain_tracks(on) if len(t) >= 2]
        mine = [v for (image, _), v in got.items() if image == i]
        steps = lambda t, closed: sorted(tuple(sorted(s)) for s in [*zip(t, t[1:]), *([(t[-1], t[0])] if closed else [])])
        is_circle = lambda t: max(abs(t[0][0] - t[-1][0]), abs(t[0][1] - t[-1][1])) == 1 and len(t) > 2
        # Open tracks agree pixel by pixel; circles, which may begin elsewhere, by their pixels.
        assert sorted(sorted(t) for t in mine) == sorted(sorted(t) for t in want)
        assert sorted(normal(t) for t in mine if not is_circle(t)) == sorted(normal(t) for t in want if not is_circle(t))
        assert len(steps(mine[0], False)) == len(mine[0]) - 1 if mine else True


def test_every_step_is_in_one_track(spark):
    r = random.Random(4)
    on = {(y, x) for y in range(30) for x in range(30) if r.random() < 0.4}
    seen = []
    for t in found(T.trace(pixels(spark, [("", on)]), 2)).values():
        seen += [tuple(sorted(s)) for s in zip(t, t[1:])]
    assert len(seen) == len(set(seen))


def test_long_track_takes_few_rounds(spark):
    n = 3000
    on = spark.range(n).select(F.lit(0).alias("image"), F.col("id").cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("x"))
    _, circles, rounds = T._ranked(T.half_edges(on), "t")
    assert rounds <= 13 and circles.isEmpty()
    assert T.trace(on).count() == n


def test_scores_decide_where_given(spark):
    """The scores turn both tracks at the crossing."""
    on = pixels(spark, [("+", set([(4, x) for x in range(9)] + [(y, 4) for y in range(9)]))])
    up, left, right, down = 1, 3, 4, 6
    chosen = spark.createDataFrame([(0, 4, 4, up, left, 0.9), (0, 4, 4, up, down, 0.5), (0, 4, 4, right, down, 0.2), (0, 4, 4, left, right, 0.8)], "image long, y int, x int, a int, b int, score double")
    got = found(T.trace(on, 3, chosen=chosen))
    assert sorted(map(sorted, got.values())) == sorted([sorted([(y, 4) for y in range(5)] + [(4, x) for x in range(4)]), sorted([(y, 4) for y in range(4, 9)] + [(4, x) for x in range(5, 9)])])


def test_branch_scores_prefer_probable_corridors(spark):
    on = pixels(spark, [("+", set([(4, x) for x in range(9)] + [(y, 4) for y in range(9)]))])
    v = F.when((F.col("x") < 4) | (F.col("y") < 4), 0.9).otherwise(0.2)
    scores = T.branch_scores(on, on.withColumn("v", v), steps=20, top=3)
    got = {(r["a"], r["b"]): round(r["score"], 3) for r in scores.collect()}
    assert got == {(1, 3): 0.9, (1, 4): 0.55, (1, 6): 0.55, (3, 4): 0.55, (3, 6): 0.55, (4, 6): 0.2}
    assert {(r["a"], r["b"]) for r in T.branch_scores(on, on.withColumn("v", v), least=0.5).collect()} == {(1, 3)}
    turned = found(T.trace(on, 3, chosen=scores))
    assert {len(t) for t in turned.values()} == {9} and all({(0, 4), (4, 0)} <= set(t) or {(8, 4), (4, 8)} <= set(t) for t in turned.values())


def test_harvest_takes_what_is_left(spark):
    """A short branch on each side of a long line: together they are a track once the line is gone, if the gap closes; alone they aren't."""
    on = set([(y, 5) for y in range(20)] + [(10, x) for x in range(9)])
    got = T.harvest(pixels(spark, [("", on)]), 8)
    assert got.select("round").distinct().count() == 1 and sorted(map(len, found(got).values())) == [9, 20]
    assert T.harvest(pixels(spark, [("", {(0, 0), (0, 1)})]), 8).count() == 0


def test_straightest_takes_the_first_of_equals(spark):
    on = pixels(spark, [("+", {(0, 1), (1, 0), (1, 1), (1, 2), (2, 1)})])
    got = {(r["y"], r["x"], r["came"]): r["goes"] for r in T.straightest(on).where("y = 1 and x = 1").collect()}
    assert got == {(1, 1, 1): 6, (1, 1, 6): 1, (1, 1, 3): 4, (1, 1, 4): 3}


def test_empty(spark):
    none = pixels(spark, [("", {(0, 0)})]).where("1 = 0")
    assert T.trace(none).count() == 0 and T.harvest(none).count() == 0 and T.path_mask(none).count() == 0


def test_crops_at_borders(spark):
    h, w = 7, 9
    rng = np.random.default_rng(1)
    a = rng.random((2, h, w))
    values = spark.createDataFrame([(i, y, x, float(a[i, y, x])) for i in range(2) for y in range(h) for x in range(w)], "image long, y int, x int, v double")
    places = [(i, y, x) for i in range(2) for y, x in ((0, 0), (6, 8), (3, 4), (0, 8), (6, 0), (2, 1), (-5, 0), (0, 30))]
    at = spark.createDataFrame(places + places[:1], "image long, y int, x int")
    got = T.crops(at, values, 2, 3).collect()
    assert len(got) == len(places) + 1
    for r in got:
        big = np.pad(a[r["image"]], 40)
        assert np.allclose(big[40 + r["y"] - 2 : 40 + r["y"] + 3, 40 + r["x"] - 3 : 40 + r["x"] + 4].ravel(), r["crop"])


def test_path_mask(spark):
    path = spark.createDataFrame([(0, 2, 2), (0, 0, 0)], "image long, y int, x int")
    got = {(r["y"], r["x"]) for r in T.path_mask(path, 2, 5, 5).collect()}
    disc = {(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dx) <= {0: 2, 1: 2, 2: 0}[abs(dy)]}
    assert got == {(y + dy, x + dx) for y, x in ((2, 2), (0, 0)) for dy, dx in disc if 0 <= y + dy < 5 and 0 <= x + dx < 5}
    assert T.path_mask(path).count() == 2 and grid.ellipse(3) == [(-1, 0), (0, 1), (1, 0)] and grid.ellipse(7)[1:3] == [(-2, 2), (-1, 3)]
