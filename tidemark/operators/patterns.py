"""Pattern rewriting of pixel masks: each round looks at the eight neighbours of every pixel and sets or clears it, all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import grid
from tidemark.operators.tracing import STEPS, ring_codes, ring_table, step_degrees
from tidemark.sources.stash import stash

#: A pattern: neighbours that must be set, neighbours that must not; others don't matter.
Pattern = tuple[str, str]
#: Directions by name, row by row as tracing.STEPS has them.
NAMES = ("NW", "N", "NE", "W", "E", "SW", "S", "SE")

# The patterns of the alternative engine.
#: A gap with three of its four sides set is filled.
FILL_SIDES: list[Pattern] = [("N E S", ""), ("N W E", ""), ("N W S", ""), ("W E S", "")]
#: A gap with three sides and the corners between them set is filled.
FILL_HALVES: list[Pattern] = [("N NE E SE S", ""), ("NW N NE W E", ""), ("NW N W SW S", ""), ("W E SW S SE", "")]
#: A pixel with three sides and the corners between them empty goes.
CLEAR_HALVES: list[Pattern] = [("", "N NE E SE S"), ("", "NW N NE W E"), ("", "NW N W SW S"), ("", "W E SW S SE")]
#: A pixel whose only neighbour is beside it in its row goes.
CHEW_ENDS: list[Pattern] = [("E", "NW N NE W SW S SE"), ("W", "NW N NE E SW S SE")]
#: A pixel with nothing above or beside it: where a track begins.
BEGINNINGS: list[Pattern] = [("", "NW N NE W E")]


def _bits(names: str) -> int:
    return sum(1 << NAMES.index(n) for n in names.split())


def matches(patterns: list[Pattern]) -> list[int]:
    """For each of the 256 codes of neighbours whether any pattern fits, 0 or 1."""
    asked = [(_bits(on), _bits(off)) for on, off in patterns]
    return [int(any(code & on == on and not code & off for on, off in asked)) for code in range(256)]


def rewrite(on: DataFrame, fill: list[Pattern], clear: list[Pattern]) -> DataFrame:
    """image, y, x: one synchronous round. Empty pixels that a fill pattern fits are set, set ones that a clear pattern fits are cleared.

    Only pixels with a set neighbour can change, so the images' sizes don't matter; fill patterns must need something on opposite sides,
    or else they would set pixels beyond the border.
    """
    codes = ring_codes(on, empty=True)
    stays = F.when(F.col("is_on"), ring_table(matches(clear)) == 0).otherwise(ring_table(matches(fill)) == 1)
    return codes.where(stays).select("image", "y", "x")


def rewrite_all(on: DataFrame, fill: list[Pattern], clear: list[Pattern], most: int = 500) -> tuple[DataFrame, int, int]:
    """Rounds until nothing changes, `most` at most: the pixels, the rounds made and the images that still changed in the last one.

    Images that no longer change aren't looked at again. With the same patterns a mask might swing between two states for ever; the
    bound ends that, and the last number tells.
    """
    moving, settled, rounds, open_images = stash(on.select("image", "y", "x").distinct(), "rewrite"), [], 0, 0
    while rounds < most:
        new = stash(rewrite(moving, fill, clear), "rewrite")
        rounds += 1
        one = moving.withColumn("_a", F.lit(1)).join(new.withColumn("_b", F.lit(1)), ["image", "y", "x"], "full")
        changed = stash(one.where("_a is null or _b is null").select("image").distinct(), "rewrite-changed")
        settled.append(new.join(changed, "image", "left_anti"))
        moving = new.join(changed, "image", "left_semi")
        open_images = changed.count()
        if not open_images:
            break
    for part in settled:
        moving = moving.unionByName(part)
    return moving, rounds, open_images


def smooth_sides(on: DataFrame) -> DataFrame:
    return rewrite(on, FILL_SIDES, [])


def smooth_halves(on: DataFrame) -> DataFrame:
    return rewrite(on, FILL_HALVES, CLEAR_HALVES)


def chew_ends(on: DataFrame, most: int = 500) -> DataFrame:
    """Horizontal ends are taken off, again and again."""
    return rewrite_all(on, [], CHEW_ENDS, most)[0]


def beginnings(on: DataFrame) -> DataFrame:
    """image, y, x: the pixels at which tracks begin, once horizontal ends are off."""
    return chew_ends(on).transform(lambda c: ring_codes(c)).where(ring_table(matches(BEGINNINGS)) == 1).select("image", "y", "x")


def prune_branches(on: DataFrame, size: int) -> DataFrame:
    """Branches of up to `size` pixels go, while what is left gets its ends back: ends are taken off so many times, then as many times
    the ends that remain grow along the pixels that were there. Pieces of twice the size or less go altogether."""
    on = on.select("image", "y", "x").distinct()
    left = on
    for _ in range(size):
        left = stash(step_degrees(left).where("degree <> 1").drop("degree"), "prune")
    for _ in range(size):
        ends = step_degrees(left).where("degree = 1").select("image", "y", "x")
        around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in STEPS])).alias("m")
        near = ends.select("image", "y", "x", around).select("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
        left = stash(left.unionByName(near.join(on.hint("merge"), ["image", "y", "x"], "left_semi")).distinct(), "prune")
    return left


def one_way_tracks(prob: DataFrame, threshold: float, least_pixels: int = 3, least_frames: int = 3) -> DataFrame:
    """image, track, y, x: tracks of movement in one direction, where no two tracks of an image touch.

    The mask above the threshold is thinned, smoothed three times, thinned and freed of branches of two pixels; each component with
    enough pixels and rows is a track, with the mean of its pixels in each row (halves to even). Tracks whose first and last row are
    less than least_frames apart go. Tracks are numbered by their first pixel.
    """
    on = stash(grid.thin(prob.where(F.col("v") >= threshold)), "one-way-mask")
    for _ in range(3):
        on = smooth_sides(on)
    on = prune_branches(stash(grid.thin(on), "one-way-thin"), 2)
    # Tables of pixels and tracks grow with the images and are joined by shuffle, however small their files are.
    # Rows from the first to the last, apart by least_frames or more.
    parts = grid.large_components(grid.label(on), least_pixels, least_frames + 1)
    mean = parts.groupBy("image", "label", "y").agg(F.bround(F.avg("x")).cast("int").alias("x"))
    tracks = mean.groupBy("image", "label").agg((F.max("y") - F.min("y")).alias("span")).where(F.col("span") >= least_frames)
    number: Column = F.row_number().over(Window.partitionBy("image").orderBy("label")) - 1
    return mean.join(tracks.select("image", "label", number.cast("long").alias("track")).hint("merge"), ["image", "label"]).select("image", "track", "y", "x")
