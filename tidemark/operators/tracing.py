"""Tracks along skeletons, crossings included: every step between two pixels belongs to exactly one track.

A step in one direction is a half-edge. Which half-edge follows another is settled inside a pixel by its eight neighbours alone: at each
pixel its steps are paired, the straightest pair first, so a track that comes in by one step of a pair goes out by the other. Pixels
where tracks cross thus belong to several tracks, steps to one. Chains of half-edges are numbered by pointer doubling, as many looks as the
longest track has binary digits: in arrays, one image a group, or, for images of very many half-edges, by joins.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import ellipse
from tidemark.sources.stash import stash

#: Directions 0 to 7, row by row; 7 - k is the opposite of k.
STEPS = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))
NONE = 15
#: Images of at most so many pixels, or half-edges, are followed as arrays, each in one group.
FEW = 500_000


def straightness(came: int, goes: int) -> float:
    """Cosine of the turn of a track that comes from the neighbour in direction `came` and goes to the one in `goes`; 1 is straight on."""
    (ay, ax), (by, bx) = STEPS[came], STEPS[goes]
    return -(ay * by + ax * bx) / math.sqrt((ay * ay + ax * ax) * (by * by + bx * bx))


def open_directions(code: int) -> list[int]:
    """The neighbours of a code that a step leads to: diagonal ones only where no set pixel lies beside both, so that corners aren't cut."""
    is_set = lambda dy, dx: code >> STEPS.index((dy, dx)) & 1
    return [k for k, (dy, dx) in enumerate(STEPS) if code >> k & 1 and (not dy or not dx or not (is_set(dy, 0) or is_set(0, dx)))]


def pairing(code: int, sharpest: float = -1.0) -> list[int]:
    """For each direction the one that it is paired with, or NONE. Straightest pairs first, then in the order of directions; where three
    or more steps meet, turns sharper than `sharpest` aren't made."""
    k = open_directions(code)
    pairs = sorted((-round(straightness(a, b), 9), a, b) for i, a in enumerate(k) for b in k[i + 1 :])
    out = [NONE] * 8
    for turn, a, b in pairs:
        if out[a] == out[b] == NONE and (len(k) == 2 or -turn >= sharpest):
            out[a], out[b] = b, a
    return out


def ring_table(values: list[int]) -> Column:
    """values[code], of 256 values by the neighbours' code, as a long."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("code") + 1)


def packed(directions: list[int]) -> int:
    """Eight directions as four bits each."""
    return sum(d << 4 * k for k, d in enumerate(directions))


def ring_codes(on: DataFrame, empty: bool = False) -> DataFrame:
    """image, y, x, code: set pixels with their set neighbours, bit k for the one in direction k. One exchange; each pixel tells the nine
    places around it, and bits are combined there. With empty also empty pixels next to set ones, and a column is_on."""
    told = [F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(STEPS)]
    told.append(F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(256).alias("bit")))
    sent = on.select("image", "y", "x", F.explode(F.array(*told)).alias("t")).select("image", (F.col("y") + F.col("t.dy")).alias("y"), (F.col("x") + F.col("t.dx")).alias("x"), "t.bit")
    codes = sent.groupBy("image", "y", "x").agg(F.bit_or("bit").alias("code"))
    if empty:
        return codes.select("image", "y", "x", F.col("code").bitwiseAND(255).alias("code"), (F.col("code") >= 256).alias("is_on"))
    return codes.where("code >= 256").withColumn("code", F.col("code") - 256)


def open_steps(on: DataFrame) -> DataFrame:
    """image, y, x, ny, nx: the steps that tracks may take, each once, from the pixel that comes first by row and column."""
    onward = [(k, s) for k, s in enumerate(STEPS) if s > (0, 0)]
    codes = ring_codes(on).withColumn("_open", ring_table([sum(1 << k for k in open_directions(c)) for c in range(256)]))
    to = F.array(*[F.when(F.col("_open").bitwiseAND(F.lit(1 << k).cast("long")) > 0, F.struct((F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx"))) for k, (dy, dx) in onward])
    return codes.select("image", "y", "x", F.explode(to).alias("t")).where("t is not null").select("image", "y", "x", "t.ny", "t.nx")


def step_degrees(on: DataFrame) -> DataFrame:
    """image, y, x, degree: set pixels with the number of steps that lead from them."""
    return ring_codes(on).select("image", "y", "x", ring_table([len(open_directions(c)) for c in range(256)]).alias("degree"))


def straightest(on: DataFrame) -> DataFrame:
    """image, y, x, came, goes: at each junction (three neighbours or more), for each neighbour that a track may come from, the neighbour
    that continues best: the largest product of the two steps, the first by row and column of equals."""

    def best(code: int, came: int) -> int:
        near = [k for k in range(8) if code >> k & 1]
        if len(near) < 3 or came not in near:
            return NONE
        product = lambda k: -(STEPS[came][0] * STEPS[k][0] + STEPS[came][1] * STEPS[k][1])
        return max((k for k in near if k != came), key=lambda k: (product(k), -k))

    table = ring_table([packed([best(code, k) for k in range(8)]) for code in range(256)])
    each = ring_codes(on).select("image", "y", "x", table.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("came"))
    return each.select("image", "y", "x", "came", _nibble(F.col("p"), F.col("came")).alias("goes")).where(F.col("goes") != NONE)


def _nibble(pairs: Column, k: Column) -> Column:
    """The direction that is paired with k."""
    return F.get(F.transform(F.array(*[F.lit(1 << 4 * i).cast("long") for i in range(8)]), lambda unit: F.floor(pairs / unit).bitwiseAND(F.lit(15).cast("long"))), k).cast("int")


def _moved(y: str, x: str, k: str) -> tuple[Column, Column]:
    """The pixel one step from (y, x) in direction k."""
    to = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in STEPS]), F.col(k) + 1)
    return F.col(y) + to(0), F.col(x) + to(1)


def edge_id(y: Column, x: Column, k: Column) -> Column:
    """A half-edge by its pixel and direction: ordered by row, column, direction. Rows and columns below 2^28."""
    return F.shiftleft(y.cast("long"), 32) + F.shiftleft(x.cast("long"), 4) + k


def matched(chosen: DataFrame) -> DataFrame:
    """image, y, x, pairs: pairs of steps at a pixel by score, the best first, as long as both are free.

    chosen has image, y, x, a, b (directions) and score. A pixel has 28 pairs at most, so its array is short.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    empty = F.struct(F.lit(0).alias("used"), F.lit(packed([NONE] * 8)).cast("long").alias("pairs"))
    bit = lambda k: F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), k + 1)
    nibble = lambda k, v: F.element_at(F.array(*[F.lit(1 << 4 * i).cast("long") for i in range(8)]), k + 1) * (F.lit(NONE) - v)

    def add(got: Column, p: Column) -> Column:
        both = bit(p["a"]) + bit(p["b"])
        pairs = got["pairs"] - nibble(p["a"], p["b"]) - nibble(p["b"], p["a"])
        return F.when(got["used"].bitwiseAND(both) == 0, F.struct((got["used"] + both).alias("used"), pairs.alias("pairs"))).otherwise(got)

    return chosen.groupBy("image", "y", "x").agg(order.alias("o")).select("image", "y", "x", F.aggregate("o", empty, add)["pairs"].alias("pairs"))


def half_edges(on: DataFrame, sharpest: float = -1.0, chosen: DataFrame | None = None) -> DataFrame:
    """image, y, x, k, id, prev: every step from a pixel, and the half-edge that a track comes by before it (null: a track begins here)."""
    codes = ring_codes(on).select(
        "image", "y", "x", ring_table([sum(1 << k for k in open_directions(c)) for c in range(256)]).alias("open"), ring_table([packed(pairing(c, sharpest)) for c in range(256)]).alias("pairs")
    )
    if chosen is not None:
        codes = codes.join(matched(chosen).withColumnRenamed("pairs", "_own"), ["image", "y", "x"], "left").withColumn("pairs", F.coalesce("_own", "pairs")).drop("_own")
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get(F.transform(F.array(*[F.lit(1 << i) for i in range(8)]), lambda b: F.col("open").bitwiseAND(b.cast("long")) > 0), k))
    each = codes.select("image", "y", "x", "pairs", F.explode(bits).alias("k")).withColumn("_c", _nibble(F.col("pairs"), F.col("k")))
    back = F.when(F.col("_c") != NONE, F.col("_c"))
    each = each.withColumn("_c", back)
    py, px = _moved("y", "x", "_c")
    return each.select("image", "y", "x", "k", edge_id(F.col("y"), F.col("x"), F.col("k")).alias("id"), edge_id(py, px, 7 - F.col("_c")).alias("prev"))


def reverse_id(y: str, x: str, k: str) -> Column:
    ry, rx = _moved(y, x, k)
    return edge_id(ry, rx, 7 - F.col(k))


def _ranked(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Half-edges with root (the first of their chain) and rank, those that run in a circle with the least of it, and the rounds it took.

    Pointer doubling: whoever doesn't know its root yet asks the half-edge that its pointer names, which has looked twice as far. Chains
    end in every round in which one is left; where none does, only circles remain, and they are done once no smaller id turns up.
    """
    begins = F.col("prev").isNull()
    now = edges.select("image", "id", F.when(begins, F.col("id")).alias("root"), F.when(begins, 0).otherwise(1).cast("long").alias("rank"), F.col("prev").alias("ptr"), F.least("id", F.coalesce("prev", "id")).alias("least"))
    done, now, rounds, waiting = [], stash(now, f"{name}-0"), 0, None
    done.append(now.where("root is not null"))
    now = now.where("root is null")
    while True:
        known = reduce(DataFrame.unionByName, done).unionByName(now)
        asked = known.select("image", F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("rank").alias("_rank"), F.col("ptr").alias("_ptr"), F.col("least").alias("_least"))
        step = now.join(asked, (now["image"] == asked["image"]) & (now["ptr"] == asked["_id"])).drop(asked["image"])
        new = step.select("image", "id", F.col("_root").alias("root"), (F.col("rank") + F.col("_rank")).alias("rank"), F.col("_ptr").alias("ptr"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("_moved"))
        rounds += 1
        wrote = stash(new, f"{name}-{rounds}")
        s = wrote.agg(F.count_if(F.col("root").isNotNull()).alias("found"), F.count_if(F.col("root").isNull()).alias("open"), F.count_if(F.col("_moved") & F.col("root").isNull()).alias("moved")).first()
        done.append(wrote.where("root is not null").drop("_moved"))
        now = wrote.where("root is null").drop("_moved")
        if not s["open"] or not s["found"] and not s["moved"] and waiting == 0:
            return reduce(DataFrame.unionByName, done).select("image", "id", "root", "rank"), now, rounds
        waiting = s["found"] + s["moved"]


def numpy_half_edges(y: np.ndarray, x: np.ndarray, open_of: np.ndarray, pair_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns y, x, k, id, prev (-1: none) of half_edges for one image's distinct pixels, of the tables of open and paired directions
    by code; pixels without any step have one row, with k = 8."""
    at = (y << 32) + (x << 4)
    known = np.sort(at)
    near = [at + (dy << 32) + (dx << 4) for dy, dx in STEPS]
    code = sum((known[np.minimum(np.searchsorted(known, to), len(known) - 1)] == to).astype(np.int64) << k for k, to in enumerate(near))
    pixel, k = np.nonzero(open_of[code])
    came = pair_of[code[pixel], k]
    prev = np.where(came != NONE, np.stack(near)[came % 8, pixel] + 7 - came, -1)
    alone = np.flatnonzero(~open_of[code].any(axis=1))
    pixel, k = np.concatenate((pixel, alone)), np.concatenate((k, np.full(len(alone), 8)))
    return y[pixel], x[pixel], k, at[pixel] + k, np.concatenate((prev, np.full(len(alone), -1)))


def numpy_tracks(y: np.ndarray, x: np.ndarray, k: np.ndarray, name: np.ndarray, prev: np.ndarray, least_points: int) -> tuple[np.ndarray, ...]:
    """track, i, y, x of one image's half-edges; prev is -1 where a track begins, and k 8 for pixels without any step.

    Pointer doubling as in _ranked, over places in the sorted ids; the place after the last stands for half-edges that aren't there.
    """
    order = np.argsort(name)
    y, x, k, name, prev = (c[order] for c in (y, x, k, name, prev))
    n, steps = len(name), np.array([*STEPS, (0, 0)])[k]
    ny, nx = y + steps[:, 0], x + steps[:, 1]

    def place(of: np.ndarray) -> np.ndarray:
        p = np.minimum(np.searchsorted(name, of), n - 1)
        return np.where(name[p] == of, p, n)

    back = place((ny << 32) + (nx << 4) + 7 - k)
    first, here = prev == -1, np.arange(n)
    begins, names = np.append(first, False), np.append(name, np.iinfo(np.int64).max)
    before = np.append(np.where(first, here, place(prev)), n)

    def followed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        root, rank, least = before, (before != np.arange(n + 1)).astype(np.int64), np.minimum(names, names[before])
        for _ in range(n.bit_length()):
            rank, least, root = rank + rank[root], np.minimum(least, least[root]), root[root]
        return root, rank, least

    root, rank, least = followed()
    circle = ~begins[root] & (root != n)
    if circle.any():
        # A circle is cut at its least half-edge and followed again. Of its two directions the one with the smaller least stays.
        stays = circle[:n] & (least[:n] < least[back])
        before[:n] = np.where(stays & (name == least[:n]), here, before[:n])
        root, rank, _ = followed()
        stays = np.append(stays, False)
    else:
        stays = circle
    root, rank = root[:n], rank[:n]
    # A chain's last half-edge tells its direction, and brings one more point.
    last = np.flatnonzero(begins[root])
    last = last[np.lexsort((rank[last], root[last]))]
    last = last[np.append(root[last][1:] != root[last][:-1], True)] if len(last) else last
    last = last[(k[last] == 8) | (name[root[last]] < (ny << 32)[last] + (nx << 4)[last] + 7 - k[last])]
    kept = np.zeros(n + 1, bool)
    kept[root[last]] = True
    on, last = np.flatnonzero(kept[root] | stays[:n]), last[k[last] != 8]
    root, rank = np.concatenate((root[on], root[last])), np.concatenate((rank[on], rank[last] + 1))
    y, x = np.concatenate((y[on], ny[last])), np.concatenate((x[on], nx[last]))
    long = np.bincount(root, minlength=n) >= max(least_points, 1)
    keep = long[root]
    return (np.cumsum(long) - 1)[root[keep]], rank[keep], y[keep], x[keep]


def _numbers(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(table.column(c).to_numpy().astype(np.int64) for c in names)


def _many(rows: DataFrame, few: int) -> DataFrame:
    """The images of more than few rows."""
    return stash(rows.groupBy("image").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("image"), "many")


def _kind(rows: DataFrame) -> str:
    return f"image {rows.schema['image'].dataType.simpleString()}"


def trace(on: DataFrame, least_points: int = 3, sharpest: float = -1.0, chosen: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """image, track, i, y, x: the tracks of skeletons, each pixel in its order.

    Every step between neighbouring set pixels is in exactly one track, whatever its direction; pixels where tracks cross are in several,
    and a track that ends at another keeps the pixel where they meet. A track runs from its end that comes first by row and column;
    circles begin at their first pixel. Tracks are numbered by where they begin; those of fewer than least_points pixels are left out.

    Where three or more steps meet, the straightest pair goes on (see pairing), or that of the highest score where `chosen` (image, y, x,
    a, b, score) has some for the pixel, as a trained decision would give them. Repeated pixels count once; an empty table gives none.
    Images of more than `few` half-edges are followed by joins, which no task does alone.
    """
    on = on.select("image", "y", "x")
    edges = half_edges(on, sharpest, chosen)
    if least_points <= 1:
        on = stash(on, "trace-pixels")
        edges = half_edges(on, sharpest, chosen)
        alone = step_degrees(on).where("degree = 0").select("image", "y", "x", F.lit(8).alias("k"), edge_id(F.col("y"), F.col("x"), F.lit(8)).alias("id"), F.lit(None).cast("long").alias("prev"))
        edges = edges.unionByName(alone)
    edges = stash(edges.where("image is not null and id is not null"), "half-edges")
    many = _many(edges, few)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y, x, k, name = _numbers(table, "y", "x", "k", "id")
        found = numpy_tracks(y, x, k, name, table.column("prev").fill_null(-1).to_numpy(), least_points)
        return pa.table({"image": pa.repeat(key[0], len(found[0])), **{c: v.astype(np.int32) for c, v in zip(("track", "i", "y", "x"), found, strict=True)}})

    follow = lambda e: e.groupBy("image").applyInArrow(run, f"{_kind(e)}, track int, i int, y int, x int")
    if many.isEmpty():
        return follow(edges)
    return follow(edges.join(many, "image", "left_anti")).unionByName(_trace_joined(stash(edges.join(many, "image", "left_semi"), "many-half-edges"), least_points))


def _trace_joined(edges: DataFrame, least_points: int) -> DataFrame:
    """trace of half-edges, by joins over all images at once."""
    alone, edges = edges.where("k = 8"), edges.where("k < 8")
    ranked, circles, _ = _ranked(edges, "chains")
    place = edges.select("image", "id", "y", "x", "k")
    if not circles.isEmpty():
        # A circle is cut at its least half-edge and ranked again. Of its two directions the one with the smaller least stays.
        ring = stash(circles.select("image", "id", "least").join(edges.select("image", "id", "prev", "y", "x", "k"), ["image", "id"]), "circles")
        other = ring.select("image", reverse_id("y", "x", "k").alias("id"), F.col("least").alias("_other"))
        one = ring.join(other, ["image", "id"]).where(F.col("least") < F.col("_other"))
        cut = one.select("image", "id", F.when(F.col("id") != F.col("least"), F.col("prev")).alias("prev"))
        rounds, _, _ = _ranked(cut, "circle-chains")
        ring_points = rounds.join(place, ["image", "id"]).select("image", "root", "rank", "y", "x")
    last = F.max_by(F.struct("id", "rank", "y", "x", "k"), "rank")
    ends = ranked.join(place, ["image", "id"]).groupBy("image", "root").agg(last.alias("e")).select("image", "root", "e.rank", "e.y", "e.x", "e.k")
    ends = ends.where(F.col("root") < reverse_id("y", "x", "k"))
    ny, nx = _moved("y", "x", "k")
    points = ranked.join(ends.select("image", "root"), ["image", "root"]).join(place, ["image", "id"]).select("image", "root", "rank", "y", "x")
    points = points.unionByName(ends.select("image", "root", (F.col("rank") + 1).alias("rank"), ny.alias("y"), nx.alias("x")))
    if not circles.isEmpty():
        points = points.unionByName(ring_points)
    points = points.unionByName(alone.select("image", F.col("id").alias("root"), F.lit(0).cast("long").alias("rank"), "y", "x"))
    points = stash(points, "track-points")
    tracks = points.groupBy("image", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_points)
    tracks = tracks.select("image", "root", (F.row_number().over(Window.partitionBy("image").orderBy("root")) - 1).alias("track"))
    return points.join(tracks, ["image", "root"]).select("image", "track", F.col("rank").cast("int").alias("i"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


def harvest(on: DataFrame, least_points: int = 8, rounds: int = 50, sharpest: float = -1.0, few: int = FEW) -> DataFrame:
    """image, round, track, i, y, x: tracks of least_points pixels or more, then those of what they leave, until none is found.

    What a round found is taken out of the skeleton, so that pieces which its crossings had cut off grow together. Images whose
    skeleton gives no more drop out; `rounds` is the most that are made. An image goes through its rounds in one group; only those of more
    than `few` pixels go round by round together.
    """
    left = stash(on.select("image", "y", "x").where("image is not null and y is not null and x is not null"), "harvest-skeleton")
    many = _many(left, few)
    open_of = np.array([[k in open_directions(c) for k in range(8)] for c in range(256)])
    pair_of = np.array([pairing(c, sharpest) for c in range(256)])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at, found = np.unique(np.stack(_numbers(table, "y", "x")), axis=1), []
        for k in range(rounds):
            got = numpy_tracks(*numpy_half_edges(*at, open_of, pair_of), least_points)
            if not len(got[0]):
                break
            found.append(np.stack((np.full(len(got[0]), k), *got)))
            spot = lambda p: (p[0] << 32) + p[1]
            at = at[:, ~np.isin(spot(at), spot(got[2:]))]
            if not at.size:
                break
        rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        return pa.table({"image": pa.repeat(key[0], rows.shape[1]), **{c: v.astype(np.int32) for c, v in zip(("round", "track", "i", "y", "x"), rows, strict=True)}})

    follow = lambda p: p.groupBy("image").applyInArrow(run, f"{_kind(p)}, round int, track int, i int, y int, x int")
    if many.isEmpty():
        return follow(left)
    return follow(left.join(many, "image", "left_anti")).unionByName(_harvest_joined(left.join(many, "image", "left_semi").distinct(), least_points, rounds, sharpest, few))


def _harvest_joined(on: DataFrame, least_points: int, rounds: int, sharpest: float, few: int) -> DataFrame:
    left, found = stash(on, "harvest-skeleton"), []
    for k in range(rounds):
        got = stash(trace(left, least_points, sharpest, few=few).withColumn("round", F.lit(k)), "harvest-tracks")
        if k and got.isEmpty():
            break
        found.append(got)
        rest = left.join(got.select("image").distinct(), "image", "left_semi").join(got.select("image", "y", "x"), ["image", "y", "x"], "left_anti")
        left = stash(rest, "harvest-skeleton")
    return reduce(DataFrame.unionByName, found).select("image", "round", "track", "i", "y", "x")


def crops(at: DataFrame, values: DataFrame, up: int, left: int, by: tuple[str, ...] = ("image",)) -> DataFrame:
    """at with a column crop: the window of 2 * up + 1 rows and 2 * left + 1 columns around (y, x) as an array, row by row, 0 outside the image.

    values is dense: image, y, x from 0, v. Its rows become arrays first; a window then gathers rows, not pixels.
    """
    wide = values.groupBy(*by, "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("_row"))
    names = at.columns
    asked = at.withColumn("_of", F.monotonically_increasing_id())
    asked = stash(asked, "crop-places")
    rows = asked.select("_of", *by, "x", F.explode(F.sequence(F.col("y") - up, F.col("y") + up)).alias("y")).join(wide, [*by, "y"])
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    start, end = F.col("x") - left, F.col("x") + left
    width = F.size("_row")
    inside = F.when((end < 0) | (start >= width), F.array().cast("array<double>")).otherwise(F.slice("_row", F.greatest(start, F.lit(0)) + 1, F.least(end, width - 1) - F.greatest(start, F.lit(0)) + 1))
    before = F.least(F.greatest(-start, F.lit(0)), F.lit(2 * left + 1))
    cut = F.concat(zeros(before), inside, zeros(F.lit(2 * left + 1) - before - F.size(inside)))
    parts = rows.groupBy("_of").agg(F.collect_list(F.struct("y", cut.alias("c"))).alias("_rows"))
    whole = asked.join(parts, "_of", "left")
    found = lambda y: F.filter("_rows", lambda r: r["y"] == y)
    line = lambda y: F.coalesce(F.get(found(y), F.lit(0))["c"], zeros(F.lit(2 * left + 1)))
    return whole.withColumn("crop", F.flatten(F.transform(F.sequence(F.col("y") - up, F.col("y") + up), line))).select(*names, "crop")


def path_mask(path: DataFrame, radius: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """image, y, x: the pixels of a path and those within an ellipse of the radius around them, inside the image where its size is given."""
    around = [F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, reach in ellipse(2 * radius + 1) for dx in range(-reach, reach + 1)]
    sent = path.select("image", "y", "x", F.explode(F.array(*around)).alias("m")).select("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    inside = (F.lit(height is None) | F.col("y").between(0, (height or 0) - 1)) & (F.lit(width is None) | F.col("x").between(0, (width or 0) - 1))
    return sent.where(inside).distinct()


def branch_scores(on: DataFrame, prob: DataFrame, steps: int = 64, top: int = 8, least: float = 0.0) -> DataFrame:
    """image, y, x, a, b, score for `chosen`: of each step out of a junction the mean of the `top` highest probabilities along its corridor.

    A corridor is followed from the junction to the next junction or end, `steps` pixels at most. Corridors whose highest probability is
    below `least` aren't scored. A pair's score is its two corridors' mean, with the straightness as a tie-breaker. prob has image, y,
    x, v: the output of any decision function.
    """
    codes = ring_codes(on).withColumn("open", ring_table([sum(1 << k for k in open_directions(c)) for c in range(256)]))
    codes = stash(codes.withColumn("n", F.bit_count("open")).join(prob.select("image", "y", "x", "v"), ["image", "y", "x"]), "branch-codes")
    out = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get(F.transform(F.array(*[F.lit(1 << i) for i in range(8)]), lambda b: F.col("open").bitwiseAND(b.cast("long")) > 0), k)))
    steps_out = codes.where("n >= 3").select("image", F.col("y").alias("jy"), F.col("x").alias("jx"), out.alias("a"))
    ny, nx = _moved("jy", "jx", "a")
    walk = steps_out.select("image", "jy", "jx", "a", ny.alias("y"), nx.alias("x"), F.col("a").alias("k"))
    seen = []
    for _ in range(steps):
        here = stash(walk.join(codes, ["image", "y", "x"]), "branch-walk")
        seen.append(here.select("image", "jy", "jx", "a", "v"))
        on_way = here.where("n = 2")
        if on_way.isEmpty():
            break
        nxt = _nibble(_pairs_of(), 7 - F.col("k"))
        walk = on_way.withColumn("k", nxt)
        wy, wx = _moved("y", "x", "k")
        walk = walk.select("image", "jy", "jx", "a", wy.alias("y"), wx.alias("x"), "k")
    values = reduce(DataFrame.unionByName, seen).groupBy("image", "jy", "jx", "a").agg(F.slice(F.reverse(F.array_sort(F.collect_list("v"))), 1, top).alias("best"))
    mean = F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")
    scored = values.where(F.get("best", F.lit(0)) >= least).select("image", F.col("jy").alias("y"), F.col("jx").alias("x"), "a", mean.alias("s"))
    pairs = scored.join(scored.select("image", "y", "x", F.col("a").alias("b"), F.col("s").alias("t")), ["image", "y", "x"]).where("a < b")
    straight = F.element_at(F.array(*[F.lit(straightness(a, b)) for a in range(8) for b in range(8)]), F.col("a") * 8 + F.col("b") + 1)
    return pairs.select("image", "y", "x", "a", "b", ((F.col("s") + F.col("t")) / 2 + straight * 1e-6).alias("score"))


def _pairs_of() -> Column:
    return ring_table([packed(pairing(c)) for c in range(256)])
