"""Image operators: ten rows of embedding arrays stand for images, 50 rows of 64 pixels each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import grid as G
from tidemark.operators import kernels as K
from tidemark.operators import patterns as P
from tidemark.operators import tracing as R
from tidemark.plans.registry import query, r6, table
from tidemark.sources.stash import stash

IMG = "WITH e AS (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings), img AS (SELECT CAST(vec_id // 50 AS BIGINT) AS image, CAST(vec_id % 50 AS INTEGER) AS y, CAST(k AS INTEGER) AS x, CAST(embedding[k + 1] AS DOUBLE) * 100.0 AS v FROM e)"
UNIT = IMG + ", top AS (SELECT image, max(v) AS m FROM img GROUP BY 1), unit AS (SELECT image, y, x, least(1.0, greatest(0.0, v / m)) AS v FROM img JOIN top USING (image))"
ON = IMG + ", lit AS (SELECT image, y, x FROM img WHERE v >= 12)"
#: Tracks over an image: one per array of 25, over 31 rows that begin at a multiple of three.
TRK = "WITH e AS (SELECT vec_id, embedding, unnest(range(31)) AS k FROM embeddings), trk AS (SELECT CAST(vec_id // 25 AS BIGINT) AS image, CAST(vec_id % 25 AS BIGINT) AS track, CAST(k + (vec_id % 7) * 3 AS INTEGER) AS y, CAST(round(CAST(embedding[k + 1] AS DOUBLE) * 20) + vec_id % 5 AS INTEGER) AS x FROM e)"
MOVES = ", mv AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dy, dx))"


def degree_sql(name: str, source: str) -> str:
    return f", {name} AS (SELECT o.image, o.y, o.x, (SELECT count(*) FROM {source} q WHERE q.image = o.image AND q.y BETWEEN o.y - 1 AND o.y + 1 AND q.x BETWEEN o.x - 1 AND o.x + 1) - 1 AS degree FROM {source} o)"


def frame_sql(name: str, source: str, axis: str, before: int, after: int, how: str) -> str:
    other = "x" if axis == "y" else "y"
    return f", {name} AS (SELECT image, y, x, {how}(v) OVER (PARTITION BY image, {other} ORDER BY {axis} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS v FROM {source})"


def cross_sql(name: str, source: str, how: str) -> str:
    return f", {name} AS (SELECT image, y, x, {how}(v) AS v FROM (SELECT image, y + dy AS y, x + dx AS x, v FROM {source}, (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) t(dy, dx)) WHERE y BETWEEN 0 AND 49 AND x BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"


def images(spark: SparkSession, d: str) -> DataFrame:
    return G.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding", 50, 100.0)


def unit(spark: SparkSession, d: str) -> DataFrame:
    return G.normalise(images(spark, d))


def lit(spark: SparkSession, d: str, at: float = 12.0) -> DataFrame:
    return images(spark, d).where(F.col("v") >= at).select("image", "y", "x")


def pixels(df: DataFrame) -> DataFrame:
    return df.select("image", "y", "x", r6("v"))


PIX = " SELECT image, y, x, round(v, 6) AS v FROM "


@query("c5_keep_extremes", IMG + " SELECT image, y, x, round(CASE WHEN v BETWEEN -5 AND 5 THEN 0 ELSE abs(v) END, 6) AS v FROM img")
def keep_extremes(spark: SparkSession, d: str) -> DataFrame:
    return pixels(images(spark, d).withColumn("v", G.keep_extremes(F.col("v"), -5, 5)))


@query("c6_nan_to_zero", IMG + " SELECT image, y, x, round(CASE WHEN x % 9 < 2 THEN 0 ELSE abs(v) END, 6) AS v FROM img")
def nan_to_zero(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("x") % 9 == 0, F.lit(float("nan"))).when(F.col("x") % 9 == 1, F.lit(float("inf"))).otherwise(F.col("v"))
    return pixels(images(spark, d).withColumn("v", v).withColumn("v", G.keep_extremes(F.col("v"), 0, 0)))


@query("c7_vertical_flip", IMG + " SELECT image, max(y) OVER (PARTITION BY image) - y AS y, x, round(v, 6) AS v FROM img")
def vertical_flip(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.flip(images(spark, d)))


@query("c8_max_normalise", UNIT + PIX + "unit")
def max_normalise(spark: SparkSession, d: str) -> DataFrame:
    return pixels(unit(spark, d))


HOT = "CAST(floor(least(1.0, greatest(0.0, {})) * 255 + 0.5) AS INTEGER)"


@query("c9_colormap", UNIT + f" SELECT image, y, x, {HOT.format('0.0416 + v * (1 - 0.0416) / 0.365079')} AS r, {HOT.format('(v - 0.365079) / (0.746032 - 0.365079)')} AS g, {HOT.format('(v - 0.746032) / (1 - 0.746032)')} AS b FROM (SELECT image, y, x, round(v, 6) AS v FROM unit)")
def colormap(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = G.hot(F.col("v"))
    return pixels(unit(spark, d)).select("image", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


@query("n5_table_to_heatmap", IMG + ", k AS (SELECT image, 49 - y AS y, x, CASE WHEN v BETWEEN -8 AND 8 THEN 0 ELSE abs(v) END AS v FROM img), t AS (SELECT image, max(v) AS m FROM k GROUP BY 1), u AS (SELECT image, y, x, round(least(1.0, greatest(0.0, v / m)), 6) AS v FROM k JOIN t USING (image))" + f" SELECT image, y, x, {HOT.format('0.0416 + v * (1 - 0.0416) / 0.365079')} AS r, {HOT.format('(v - 0.365079) / (0.746032 - 0.365079)')} AS g, {HOT.format('(v - 0.746032) / (1 - 0.746032)')} AS b FROM u")
def table_to_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned, extremes kept, flipped, normalised, coloured."""
    k = images(spark, d).withColumn("v", G.keep_extremes(F.col("v"), -8, 8))
    r, g, b = G.hot(F.col("v"))
    return pixels(G.normalise(G.flip(k, 50))).select("image", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


@query("c10_resize_shape", "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN p_size ELSE CASE WHEN p_partkey % 4 = 2 THEN greatest(1, CAST(round_even((40 + p_size) * 7 / 50.0, 0) AS INTEGER)) ELSE 40 + p_size END END AS w, CASE WHEN p_partkey % 4 = 0 THEN 7 WHEN p_partkey % 4 = 1 THEN greatest(1, CAST(round_even(50 * p_size / (40.0 + p_size), 0) AS INTEGER)) WHEN p_partkey % 4 = 2 THEN 7 ELSE 50 END AS h FROM part")
def resize_shape(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    w, h = S.resized(40 + F.col("p_size"), F.lit(50), F.when(k < 2, F.col("p_size")), F.when((k == 0) | (k == 2), F.lit(7)))
    return table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("c11_luminance", IMG + " SELECT image, y, x, round(0.2126 * v + 0.7152 * (v + 1) + 0.0722 * y, 6) AS v FROM img")
def luminance(spark: SparkSession, d: str) -> DataFrame:
    return pixels(images(spark, d).withColumn("v", 0.2126 * F.col("v") + 0.7152 * (F.col("v") + 1) + 0.0722 * F.col("y")))


@query("c12_hex_axis", IMG + " SELECT image, y, x, round(least(1.0, greatest(0.0, (x * 4 * 255.0 + y * 5 * 128 + 7 * 64) / (255 * 255 + 128 * 128 + 64 * 64))), 6) AS v FROM img")
def hex_axis(spark: SparkSession, d: str) -> DataFrame:
    """Place of (4x, 5y, 7) on the axis from #000000 to #ff8040."""
    from functools import reduce

    low, high = [[S.hex_channel(F.lit(c), k) for k in range(3)] for c in ("#000", "#ff8040")]
    rgb = [F.col("x") * 4, F.col("y") * 5, F.lit(7)]
    dot = reduce(lambda a, b: a + b, [(rgb[k] - low[k]) * (high[k] - low[k]) for k in range(3)])
    norm = reduce(lambda a, b: a + b, [(high[k] - low[k]) * (high[k] - low[k]) for k in range(3)])
    return pixels(images(spark, d).withColumn("v", F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / norm))))


@query("c13_hex_parse", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN 170 ELSE 18 END AS r, CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_size % 3 = 1 THEN 187 ELSE 171 END AS g FROM part")
def hex_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.element_at(F.array(F.lit("#12ABef"), F.lit("#aBc"), F.lit("#12x")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.hex_channel(c, 0).alias("r"), S.hex_channel(c, 1).alias("g"))


@query("c14_invert_threshold", UNIT + " SELECT image, y, x, CAST(floor((CASE WHEN 1 - v >= 0.4 THEN 1 ELSE 1 - v END) * 255) AS INTEGER) AS b FROM (SELECT image, y, x, round(v, 6) AS v FROM unit)")
def invert_threshold(spark: SparkSession, d: str) -> DataFrame:
    g = 1 - F.col("v")
    return pixels(unit(spark, d)).select("image", "y", "x", F.floor(F.when(g >= 0.4, 1.0).otherwise(g) * 255).cast("int").alias("b"))


@query("n6_image_to_heatmap", UNIT + " SELECT image, y, x, CAST(floor((1 - v) * 255) AS INTEGER) AS b FROM (SELECT image, y, x, round(0.2126 * v + 0.7152 * v + 0.0722 * v, 6) AS v FROM unit)")
def image_to_heatmap(spark: SparkSession, d: str) -> DataFrame:
    lum = 0.2126 * F.col("v") + 0.7152 * F.col("v") + 0.0722 * F.col("v")
    return pixels(unit(spark, d).withColumn("v", lum)).select("image", "y", "x", F.floor((1 - F.col("v")) * 255).cast("int").alias("b"))


TRIANGLES = "w{a} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, greatest(0.0, 1 - abs(i + 0.5 - (o + 0.5) * s) / greatest(s, 1)) AS w FROM (SELECT unnest(range({to})) AS o), (SELECT unnest(range({n})) AS i), (SELECT {n} / {to}.0 AS s)) WHERE w > 0)"
BYTE = "CAST(floor(round(sum({c} * w), 6) + 0.5) AS INTEGER) AS {c}"
OVER_SQL = UNIT + ", px AS (SELECT image, y, x, CAST(floor(v * 255) AS INTEGER) AS r, CAST(floor((1 - v) * 255) AS INTEGER) AS g, (y * 5) % 256 AS b, 255 - x * 2 AS a FROM unit), ov AS (SELECT image, y, x, CAST(floor((r * a + 16 * (255 - a)) / 255.0 + 0.5) AS INTEGER) AS r, CAST(floor((g * a + 32 * (255 - a)) / 255.0 + 0.5) AS INTEGER) AS g, CAST(floor((b * a + 48 * (255 - a)) / 255.0 + 0.5) AS INTEGER) AS b FROM px)"
SIZED_SQL = OVER_SQL + ", " + TRIANGLES.format(a="x", n=64, to=40) + ", " + TRIANGLES.format(a="y", n=50, to=31) + ", hx AS (SELECT image, y, o AS x, " + ", ".join(BYTE.format(c=c) for c in "rgb") + " FROM ov JOIN wx ON wx.i = ov.x GROUP BY 1, 2, 3), hy AS (SELECT image, o AS y, x, " + ", ".join(BYTE.format(c=c) for c in "rgb") + " FROM hx JOIN wy ON wy.i = hx.y GROUP BY 1, 2, 3)"


def uploaded(spark: SparkSession, d: str) -> DataFrame:
    """Images with colors and transparency."""
    v = F.col("v")
    byte = lambda c: F.floor(c * 255).cast("int")
    return unit(spark, d).select("image", "y", "x", byte(v).alias("r"), byte(1 - v).alias("g"), ((F.col("y") * 5) % 256).alias("b"), (255 - F.col("x") * 2).alias("a"))


@query("n6_image_to_heatmap_axis", SIZED_SQL + " SELECT image, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(floor(round((1 - least(1.0, greatest(0.0, ((r - 10) * 190 + (g - 200) * -150 + (b - 30) * 20) / CAST(190 * 190 + 150 * 150 + 20 * 20 AS DOUBLE)))) * 255, 6)) AS INTEGER) AS v FROM hy")
def image_to_heatmap_axis(spark: SparkSession, d: str) -> DataFrame:
    """Laid over a background, resized in proportion, projected to an axis of colors, inverted."""
    cfg = {"alpha_background": "#102030", "target_width": 40, "low_hex": "0ac81e", "high_hex": "#c83232", "invert": True}
    return G.heatmap_of_image(uploaded(spark, d), 50, 64, cfg)


@query("n6_image_to_heatmap_binary", SIZED_SQL + " SELECT image, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN round((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255, 9) >= 0.6 THEN 255 ELSE 0 END AS v FROM hy")
def image_to_heatmap_binary(spark: SparkSession, d: str) -> DataFrame:
    """The luminance, cut at a threshold."""
    cfg = {"alpha_background": "#102030", "target_width": 40, "target_height": 31, "binary_grayscale": True, "binary_threshold": 0.6}
    return G.heatmap_of_image(uploaded(spark, d), 50, 64, cfg)


STRETCH = UNIT + ", inv AS (SELECT image, y, x, CASE WHEN avg(v) OVER (PARTITION BY image) > 0.5 THEN 1 - v ELSE v END AS v FROM unit), q AS (SELECT image, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM inv GROUP BY 1), st AS (SELECT image, y, x, CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (v - lo) / (hi - lo))) ELSE v END AS v FROM inv JOIN q USING (image))"


@query("c15_polarity_stretch", STRETCH + PIX + "st")
def polarity(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.stretch(unit(spark, d)))


@query("c16_threshold", UNIT + " SELECT image, y, x FROM unit WHERE v >= 0.4")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return unit(spark, d).where("v >= 0.4").select("image", "y", "x")


@query("c17_logits_to_probability", IMG + " SELECT image, y, x, round(1 / (1 + exp(-v)), 6) AS v FROM img")
def logits(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.probability(images(spark, d)))


@query("n11_gray_range", IMG + " SELECT image, y, x, round(CASE WHEN max(abs(v)) OVER (PARTITION BY image) > 1 THEN abs(v) / 255 ELSE abs(v) END, 6) AS v FROM img")
def gray_range(spark: SparkSession, d: str) -> DataFrame:
    v = F.abs("v")
    return pixels(images(spark, d).withColumn("v", F.when(F.max(v).over(Window.partitionBy("image")) > 1, v / 255).otherwise(v)))


@query("n12_segmentation_preprocess", STRETCH + PIX + "st")
def preprocess(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.stretch(unit(spark, d)))


@query("n13_mask_conversion", IMG + " SELECT image, y, x, CASE WHEN v >= 12 THEN 255 ELSE 0 END AS byte, v >= 12 AS is_on FROM img")
def mask_conversion(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).select("image", "y", "x", ((F.col("v") >= 12).cast("int") * 255).alias("byte")).withColumn("is_on", F.col("byte") > 0)


@query("d1_neighbour_join", ON + MOVES + " SELECT a.image, a.y, a.x, b.y AS ny, b.x AS nx FROM lit a JOIN mv ON true JOIN lit b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx")
def neighbour_join(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbours(lit(spark, d)).select("image", "y", "x", "ny", "nx")


@query("i18_endpoints_junctions", ON + degree_sql("dg", "lit") + " SELECT image, y, x, degree FROM dg WHERE degree = 1 OR degree >= 3")
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(lit(spark, d)).where("degree = 1 or degree >= 3").select("image", "y", "x", "degree")


@query("i17_endpoint_pruning", ON + degree_sql("d1", "lit") + ", p1 AS (SELECT image, y, x FROM d1 WHERE degree <> 1)" + degree_sql("d2", "p1") + " SELECT image, y, x FROM d2 WHERE degree <> 1")
def pruning(spark: SparkSession, d: str) -> DataFrame:
    return G.prune_ends(lit(spark, d), 2).select("image", "y", "x")


@query("i16_junction_nms", ON + ", p AS (SELECT image, y, x, v FROM img WHERE v >= 12), n AS (SELECT a.image, a.y, a.x, any_value(a.v) AS v, count(b.v) AS degree, max(b.v) AS nv FROM p a LEFT JOIN p b ON b.image = a.image AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (b.y <> a.y OR b.x <> a.x) GROUP BY 1, 2, 3) SELECT image, y, x FROM n WHERE degree < 3 OR nv <= v")
def junction_nms(spark: SparkSession, d: str) -> DataFrame:
    return G.junction_suppression(lit(spark, d), images(spark, d))


DIRECT = frame_sql("a1", "img", "y", 2, 2, "max") + frame_sql("a2", "a1", "y", 2, 2, "min") + frame_sql("a3", "a2", "x", 2, 2, "max") + frame_sql("a4", "a3", "x", 2, 2, "min")


@query("i10_directional_morphology", IMG + DIRECT + frame_sql("b1", "a4", "y", 1, 1, "max") + frame_sql("b2", "b1", "x", 1, 1, "max") + frame_sql("b3", "b2", "y", 1, 1, "min") + frame_sql("b4", "b3", "x", 1, 1, "min") + PIX + "b4")
def directional(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.morphology(images(spark, d), "directional", 5, 5, True))


@query("i9_classic_morphology", IMG + "".join(cross_sql(f"c{k + 1}", f"c{k}" if k else "img", how) for k, how in enumerate(("max", "min", "min", "max", "max", "min"))) + PIX + "c6")
def classic(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.morphology(images(spark, d), "classic", shape=(50, 64)))


def ellipse_sql(name: str, source: str, how: str, spans: dict[int, int]) -> str:
    cells = ", ".join(f"({dy}, {dx})" for dy, reach in spans.items() for dx in range(-reach, reach + 1))
    return f", {name} AS (SELECT image, y, x, {how}(v) AS v FROM (SELECT image, y + dy AS y, x + dx AS x, v FROM {source}, (VALUES {cells}) t(dy, dx)) WHERE y BETWEEN 0 AND 49 AND x BETWEEN 0 AND 63 GROUP BY 1, 2, 3)"


def classic_sql(spans: dict[int, int]) -> str:
    return IMG + "".join(ellipse_sql(f"c{k + 1}", f"c{k}" if k else "img", how, spans) for k, how in enumerate(("max", "min", "min", "max", "max", "min"))) + PIX + "c6"


@query("i9_classic_morphology_5", classic_sql({-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}))
def classic_5(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.classic(images(spark, d), 5, (50, 64)))


@query("i9_classic_morphology_7", classic_sql({-3: 0, -2: 2, -1: 3, 0: 3, 1: 3, 2: 2, 3: 0}))
def classic_7(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.morphology(images(spark, d), "classic", size=7, shape=(50, 64)))


@query("i11_weak_shave", IMG + ", mk AS (SELECT image, y, x, CASE WHEN v >= 5 AND v < 10 THEN 1.0 ELSE 0.0 END AS v FROM img)" + frame_sql("s1", "mk", "y", 1, 1, "min") + frame_sql("s2", "s1", "y", 1, 1, "max") + frame_sql("s3", "s2", "x", 1, 1, "min") + frame_sql("s4", "s3", "x", 1, 1, "max") + " SELECT image, y, x, CASE WHEN img.v >= 10 THEN 1.0 ELSE s4.v END AS v FROM s4 JOIN img USING (image, y, x)")
def weak_shave(spark: SparkSession, d: str) -> DataFrame:
    img = images(spark, d)
    return G.shave_weak(img.withColumn("v", (F.col("v") >= 5).cast("double")), img, 10.0).select("image", "y", "x", "v")


@query("i1_reflect_padding", IMG + " SELECT image, y2 AS y, x2 AS x, round(v, 6) AS v FROM (SELECT unnest(range(64)) AS y2) JOIN (SELECT unnest(range(80)) AS x2) ON true JOIN img ON img.y = CASE WHEN y2 < 50 THEN y2 ELSE 98 - y2 END AND img.x = CASE WHEN x2 < 64 THEN x2 ELSE 126 - x2 END")
def padding(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.pad(images(spark, d), 50, 64, 64, 80))


TILES = "SELECT * FROM (VALUES (0, 0), (16, 0), (18, 0), (0, 16), (16, 16), (18, 16), (0, 32), (16, 32), (18, 32)) t(ty, tx)"


def tiled(spark: SparkSession, d: str) -> DataFrame:
    origins = F.array(*[F.struct(F.lit(a).alias("ty"), F.lit(b).alias("tx")) for a in G.tile_starts(50, 32, 16) for b in G.tile_starts(64, 32, 16)])
    t = images(spark, d).select("*", F.explode(origins).alias("t")).select("image", "y", "x", "v", "t.ty", "t.tx")
    return t.where(F.col("y").between(F.col("ty"), F.col("ty") + 31) & F.col("x").between(F.col("tx"), F.col("tx") + 31))


@query("i2_tiling", IMG + f", t AS ({TILES}) SELECT image, ty, tx, count(*) AS pixels, round(sum(v), 6) AS total FROM img JOIN t ON y BETWEEN ty AND ty + 31 AND x BETWEEN tx AND tx + 31 GROUP BY 1, 2, 3")
def tiling(spark: SparkSession, d: str) -> DataFrame:
    return tiled(spark, d).groupBy("image", "ty", "tx").agg(F.count(F.lit(1)).alias("pixels"), r6(F.sum("v"), "total"))


@query("i3_hann_blend", IMG + f", t AS ({TILES}), b AS (SELECT image, y, x, v * (1 + ty / 100.0) AS v, (0.25 + 0.75 * (0.5 - 0.5 * cos(2 * pi() * (y - ty) / 31))) * (0.25 + 0.75 * (0.5 - 0.5 * cos(2 * pi() * (x - tx) / 31))) AS w FROM img JOIN t ON y BETWEEN ty AND ty + 31 AND x BETWEEN tx AND tx + 31) SELECT image, y, x, round(sum(v * w) / greatest(sum(w), 1e-6), 6) AS v FROM b GROUP BY 1, 2, 3")
def hann_blend(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.blend(tiled(spark, d).withColumn("v", F.col("v") * (1 + F.col("ty") / 100)), 32))


@query("i7_map_fusion", UNIT + " SELECT a.image, a.y, a.x, round(greatest(a.v, 0.8 * coalesce(b.v, 0)), 6) AS v FROM unit a LEFT JOIN (SELECT image, y, 63 - x AS x, v FROM unit) b USING (image, y, x)")
def map_fusion(spark: SparkSession, d: str) -> DataFrame:
    a = unit(spark, d)
    b = a.select("image", "y", (63 - F.col("x")).alias("x"), F.col("v").alias("u"))
    return pixels(a.join(b, ["image", "y", "x"], "left").withColumn("v", F.greatest("v", 0.8 * F.coalesce("u", F.lit(0.0)))))


@query("i15_probability_floor", ON + degree_sql("dg", "lit") + ", f AS (SELECT image, least(14.0, greatest(12.5, quantile_cont(v, 0.1))) AS floor FROM img JOIN lit USING (image, y, x) GROUP BY 1) SELECT d.image, d.y, d.x FROM dg d JOIN img USING (image, y, x) JOIN f ON f.image = d.image WHERE NOT (d.degree <= 2 AND img.v < f.floor)")
def probability_floor(spark: SparkSession, d: str) -> DataFrame:
    on, img = lit(spark, d), images(spark, d)
    p = on.join(img, ["image", "y", "x"])
    low = p.groupBy("image").agg(F.least(F.lit(14.0), F.greatest(F.lit(12.5), F.percentile("v", F.lit(0.1)))).alias("floor"))
    return G.degrees(on).join(p, ["image", "y", "x"]).join(low, "image").where(~((F.col("degree") <= 2) & (F.col("v") < F.col("floor")))).select("image", "y", "x")


@query("i13_connected_components")
def connected(spark: SparkSession, d: str) -> DataFrame:
    return G.label(lit(spark, d, 16.0))


@query("e12_component_stats")
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.large_components(G.label(lit(spark, d, 14.0)), 6, 3)


@query("i8_hysteresis")
def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    return G.hysteresis(images(spark, d), 14.0, 22.0)


@query("i14_thinning")
def thinning(spark: SparkSession, d: str) -> DataFrame:
    return G.thin(lit(spark, d, 6.0))


@query("i20_gap_bridging")
def bridging(spark: SparkSession, d: str) -> DataFrame:
    return G.bridge_gaps(G.thin(lit(spark, d, 6.0)), unit(spark, d))


@query("i23_graph_walk")
def graph_walk(spark: SparkSession, d: str) -> DataFrame:
    """Tracks through crossings: each step between pixels of the skeleton in one track, crossings in several."""
    return R.trace(G.thin(lit(spark, d, 6.0)))


@query("i23_harvest")
def harvest(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of eight points or more, round by round."""
    return R.harvest(G.thin(lit(spark, d, 6.0)), 8)


#: Steps between set pixels, each once: to the right, or to the row below; diagonal ones only where no set pixel lies beside both.
STEPS_SQL = """, st AS (SELECT a.image, a.y, a.x, b.y AS ny, b.x AS nx FROM lit a JOIN (VALUES (0,1),(1,-1),(1,0),(1,1)) m(dy, dx) ON true JOIN lit b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx
WHERE dy = 0 OR dx = 0 OR NOT EXISTS (SELECT 1 FROM lit c WHERE c.image = a.image AND ((c.y = a.y AND c.x = b.x) OR (c.y = b.y AND c.x = a.x))))"""


@query("n14_visited_steps", ON + STEPS_SQL + " SELECT image, y, x, ny, nx, CAST(1 AS BIGINT) AS times FROM st")
def visited_steps(spark: SparkSession, d: str) -> DataFrame:
    """How often tracks take each step, in either direction."""
    t = stash(R.trace(lit(spark, d), 2), "n14-tracks")
    to = t.select("image", "track", (F.col("i") - 1).alias("i"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    # Circles are closed by the step back to their first pixel.
    ends = t.groupBy("image", "track").agg(F.max_by(F.struct("y", "x"), "i").alias("e"), F.min_by(F.struct("y", "x"), "i").alias("s"), F.max("i").alias("n"))
    met = t.join(to, ["image", "track", "i"]).select("image", "y", "x", "y2", "x2")
    apart = lambda c: F.abs(F.col(f"e.{c}") - F.col(f"s.{c}"))
    open_steps = R.open_steps(lit(spark, d)).select("image", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("ny").alias("_ny"), F.col("nx").alias("_nx"))
    close = ends.where((F.col("n") > 1) & (apart("y") <= 1) & (apart("x") <= 1)).select("image", F.col("e.y").alias("y"), F.col("e.x").alias("x"), F.col("s.y").alias("y2"), F.col("s.x").alias("x2"))
    sides = lambda p: p.select("image", F.least(F.struct("y", "x"), F.struct(F.col("y2").alias("y"), F.col("x2").alias("x"))).alias("p"), F.greatest(F.struct("y", "x"), F.struct(F.col("y2").alias("y"), F.col("x2").alias("x"))).alias("q"))
    flat = lambda p: sides(p).select("image", "p.y", "p.x", F.col("q.y").alias("ny"), F.col("q.x").alias("nx"))
    taken = flat(met)
    closing = flat(close).join(taken, ["image", "y", "x", "ny", "nx"], "left_anti")
    closing = closing.join(open_steps, (closing["image"] == open_steps["image"]) & (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x")) & (F.col("ny") == F.col("_ny")) & (F.col("nx") == F.col("_nx")), "left_semi")
    return taken.unionByName(closing).groupBy("image", "y", "x", "ny", "nx").agg(F.count(F.lit(1)).alias("times"))


@query("g24_branch_straightness", ON + MOVES + """, nb AS (SELECT a.image, a.y, a.x, row_number() OVER (PARTITION BY a.image, a.y, a.x ORDER BY dy, dx) - 1 AS nth, dy, dx, count(*) OVER (PARTITION BY a.image, a.y, a.x) AS degree FROM lit a JOIN mv ON true JOIN lit b ON b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx),
best AS (SELECT c.image, c.y, c.x, c.dy AS cy, c.dx AS cx, g.dy AS gy, g.dx AS gx, row_number() OVER (PARTITION BY c.image, c.y, c.x, c.dy, c.dx ORDER BY c.dy * g.dy + c.dx * g.dx, g.nth) AS place FROM nb c JOIN nb g ON g.image = c.image AND g.y = c.y AND g.x = c.x AND g.nth <> c.nth WHERE c.degree >= 3)
SELECT image, y, x, CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, CAST(gy AS INTEGER) AS gy, CAST(gx AS INTEGER) AS gx FROM best WHERE place = 1""")
def branch_straightness(spark: SparkSession, d: str) -> DataFrame:
    """At each junction, for each neighbour that a track may come from, the neighbour that goes straightest on."""
    step = lambda k, i: F.element_at(F.array(*[F.lit(s[i]) for s in R.STEPS]), F.col(k) + 1)
    return R.straightest(lit(spark, d)).select("image", "y", "x", step("came", 0).alias("cy"), step("came", 1).alias("cx"), step("goes", 0).alias("gy"), step("goes", 1).alias("gx"))


CROP_SQL = IMG + """, spot AS (SELECT image, y, x FROM img WHERE v >= 30), win AS (SELECT image, y, x, dy, dx FROM spot, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-5, 6)) AS dx))
SELECT w.image, w.y, w.x, CAST((dy + 3) * 11 + dx + 5 AS INTEGER) AS k, round(coalesce(i.v, 0), 6) AS v FROM win w LEFT JOIN img i ON i.image = w.image AND i.y = w.y + dy AND i.x = w.x + dx"""


@query("i21_crops", CROP_SQL)
def crops(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 7 x 11 pixels around bright pixels, zeros outside the image: the input of a decision function."""
    img = stash(images(spark, d), "crop-images")
    at = img.where("v >= 30").select("image", "y", "x")
    return R.crops(at, img, 3, 5).select("image", "y", "x", F.posexplode("crop").alias("k", "_v")).select("image", "y", "x", "k", r6("_v", "v"))


@query("i21_path_mask", TRK + " SELECT DISTINCT image, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM trk, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE track = 3 AND (abs(dy) < 2 OR dx = 0) AND y + dy BETWEEN 0 AND 49 AND x + dx BETWEEN 0 AND 63")
def path_mask(spark: SparkSession, d: str) -> DataFrame:
    """The corridor of two pixels around one track of each image."""
    return R.path_mask(points(spark, d).where("track = 3"), 2, 50, 64)


@query("i29_smooth_sides", ON + """, cand AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM lit, (VALUES (-1,0),(1,0),(0,-1),(0,1)) m(dy, dx)), sides AS (SELECT c.image, c.y, c.x, count(*) AS n FROM cand c JOIN (VALUES (-1,0),(1,0),(0,-1),(0,1)) m(dy, dx) ON true JOIN lit l ON l.image = c.image AND l.y = c.y + dy AND l.x = c.x + dx GROUP BY 1, 2, 3)
SELECT image, y, x FROM lit UNION SELECT image, CAST(y AS INTEGER), CAST(x AS INTEGER) FROM sides WHERE n >= 3""")
def smooth_sides(spark: SparkSession, d: str) -> DataFrame:
    """Gaps with three of four sides set are filled."""
    return P.smooth_sides(lit(spark, d))


HALF = "((s.n AND s.ne AND s.e AND s.se AND s.s) OR (s.nw AND s.n AND s.ne AND s.w AND s.e) OR (s.n AND s.nw AND s.w AND s.sw AND s.s) OR (s.w AND s.e AND s.sw AND s.s AND s.se))"


@query("i29_smooth_halves", IMG + ", b AS (SELECT image, y, x, v >= 12 AS o FROM img), r AS (SELECT *, coalesce(lag(o) OVER w, false) AS w_, coalesce(lead(o) OVER w, false) AS e_ FROM b WINDOW w AS (PARTITION BY image, y ORDER BY x)), s AS (SELECT image, y, x, o, w_ AS w, e_ AS e, coalesce(lag(o) OVER c, false) AS n, coalesce(lag(w_) OVER c, false) AS nw, coalesce(lag(e_) OVER c, false) AS ne, "
       "coalesce(lead(o) OVER c, false) AS s, coalesce(lead(w_) OVER c, false) AS sw, coalesce(lead(e_) OVER c, false) AS se FROM r WINDOW c AS (PARTITION BY image, x ORDER BY y)) SELECT image, y, x FROM s WHERE CASE WHEN o THEN NOT " + HALF.replace("s.", "NOT s.") + " ELSE " + HALF + " END")
def smooth_halves(spark: SparkSession, d: str) -> DataFrame:
    """Gaps with a full half around them are filled, pixels with an empty half around them go."""
    return P.smooth_halves(lit(spark, d))


@query("i29_chew_ends")
def chew_ends(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal ends taken off until none is left."""
    return P.chew_ends(lit(spark, d))


@query("i30_one_way_tracks")
def one_way_tracks(spark: SparkSession, d: str) -> DataFrame:
    return P.one_way_tracks(images(spark, d), 6.0)


@query("e10_mask_coverage", IMG + " SELECT image, round(100.0 * count(CASE WHEN v >= 12 THEN 1 END) / count(*), 6) AS coverage FROM img GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return images(spark, d).groupBy("image").agg(r6(100 * F.count_if(F.col("v") >= 12) / F.count(F.lit(1)), "coverage"))


@query("e11_auto_threshold", UNIT + ", th AS (SELECT k, 0.12 + k * (0.18 / 18) AS t FROM (SELECT unnest(range(19)) AS k)), c AS (SELECT image, k, t, round(abs(100.0 * count(CASE WHEN v >= t THEN 1 END) / count(*) - 20.0), 9) AS off FROM unit, th GROUP BY 1, 2, 3) SELECT image, round(t, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY off, k) AS n FROM c) WHERE n = 1")
def auto_threshold(spark: SparkSession, d: str) -> DataFrame:
    return G.auto_threshold(unit(spark, d), 15, 25, (0.12, 0.30, 19)).select("image", r6("threshold"))


@query("e11_auto_threshold_sweep", UNIT + ", th AS (SELECT k, 0.3 + k * (0.6 / 6) AS t FROM (SELECT unnest(range(7)) AS k)), c AS (SELECT image, k, t, round(abs(100.0 * count(CASE WHEN v >= t THEN 1 END) / count(*) - 5.0), 9) AS off FROM unit, th GROUP BY 1, 2, 3) SELECT image, round(t, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY off, k) AS n FROM c) WHERE n = 1")
def auto_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Another sweep and target."""
    return G.auto_threshold(unit(spark, d), 2, 8, (0.3, 0.9, 7)).select("image", r6("threshold"))


@query("e13_bounding_box", ON + " SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lit GROUP BY 1")
def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return lit(spark, d).groupBy("image").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query("e15_one_point_per_row", ON + " SELECT image, y, CAST(floor(median(x)) AS INTEGER) AS x FROM lit GROUP BY 1, 2")
def one_per_row(spark: SparkSession, d: str) -> DataFrame:
    return lit(spark, d).groupBy("image", "y").agg(F.floor(F.median("x")).cast("int").alias("x"))


@query("e16_mean_per_frame", ON + " SELECT image, y, round_even(avg(x), 0) AS x FROM lit GROUP BY 1, 2")
def mean_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return lit(spark, d).groupBy("image", "y").agg(F.rint(F.avg("x")).alias("x"))


@query("e20_debug_stats", IMG + " SELECT image, round(min(v), 6) AS low, round(max(v), 6) AS high, round(100.0 * avg(CASE WHEN v >= 12 THEN 1 ELSE 0 END), 6) AS mask, count(CASE WHEN v >= 12 THEN 1 END) AS pixels FROM img GROUP BY 1")
def debug_stats(spark: SparkSession, d: str) -> DataFrame:
    on = F.col("v") >= 12
    return images(spark, d).groupBy("image").agg(r6(F.min("v"), "low"), r6(F.max("v"), "high"), r6(100 * F.avg(on.cast("int")), "mask"), F.count_if(on).alias("pixels"))


@query("i26_rescale", ON + " SELECT image, y, x, CAST(round_even((y + 0.5) * 1.7 - 0.5, 0) AS INTEGER) AS y2, CAST(round_even((x + 0.5) * 0.45 - 0.5, 0) AS INTEGER) AS x2 FROM lit")
def rescaled(spark: SparkSession, d: str) -> DataFrame:
    return lit(spark, d).select("image", "y", "x", G.rescale(F.col("y"), 1.7).alias("y2"), G.rescale(F.col("x"), 0.45).alias("x2"))


@query("i27_row_normalise", UNIT + ", m AS (SELECT image, y, x, CASE WHEN avg(v) OVER (PARTITION BY image, y) > 0 THEN v / avg(v) OVER (PARTITION BY image, y) ELSE v END AS v FROM unit), r AS (SELECT image, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1) SELECT image, y, x, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM m JOIN r USING (image)")
def row_normalise(spark: SparkSession, d: str) -> DataFrame:
    return pixels(G.row_normalise(unit(spark, d)))


@query("i28_polarity_test", UNIT + " SELECT image, count(CASE WHEN v >= 0.5 THEN 1 END) > count(CASE WHEN 1 - v >= 0.5 THEN 1 END) AS inverted FROM unit GROUP BY 1")
def polarity_test(spark: SparkSession, d: str) -> DataFrame:
    return unit(spark, d).groupBy("image").agg((F.count_if(F.col("v") >= 0.5) > F.count_if(1 - F.col("v") >= 0.5)).alias("inverted"))


OVER = TRK + ", pr AS (SELECT a.image, a.track AS a, b.track AS b, count(*) AS shared, round(count(*) / 31.0, 6) AS overlap, round(avg(abs(a.x - b.x)), 6) AS mean_dx FROM trk a JOIN trk b ON a.image = b.image AND a.y = b.y AND a.track < b.track GROUP BY 1, 2, 3)"


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 31)).alias("k", "v"))
    return e.select(F.floor(F.col("vec_id") / 25).alias("image"), (F.col("vec_id") % 25).alias("track"), (F.col("k") + (F.col("vec_id") % 7) * 3).cast("int").alias("y"), (F.round(F.col("v").cast("double") * 20) + F.col("vec_id") % 5).cast("int").alias("x"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("image", "track").agg(F.median("x").alias("score"), F.count(F.lit(1)).alias("n"))


def track_ends(spark: SparkSession, d: str) -> DataFrame:
    """Short pieces, so that ends and starts lie near each other."""
    p = points(spark, d).withColumn("track", F.col("track") * 10 + F.floor(F.col("y") / 8))
    return p.groupBy("image", "track").agg(F.min("y").alias("y0"), F.min_by("x", "y").alias("x0"), F.max("y").alias("y1"), F.max_by("x", "y").alias("x1"))


@query("d4_track_overlap", OVER + " SELECT image, a, b, shared, overlap, mean_dx FROM pr")
def track_overlap(spark: SparkSession, d: str) -> DataFrame:
    return G.overlaps(points(spark, d)).select("image", "a", "b", "shared", r6("overlap"), r6("mean_dx"))


@query("d5_greedy_dedupe")
def greedy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return G.greedy_dedupe(scored(spark, d), G.overlaps(points(spark, d)), 0.6, 3.0)


@query("d6_subset_anti_join", OVER + " SELECT t.image, t.track FROM (SELECT DISTINCT image, track FROM trk) t WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image = t.image AND pr.b = t.track AND pr.shared >= 28)")
def subset_anti(spark: SparkSession, d: str) -> DataFrame:
    inside = G.overlaps(points(spark, d)).where("shared >= 28").select("image", F.col("b").alias("track")).distinct()
    return points(spark, d).select("image", "track").distinct().join(inside, ["image", "track"], "left_anti")


ENDS = TRK + ", ends AS (SELECT image, track * 10 + y // 8 AS track, min(y) AS y0, arg_min(x, y) AS x0, max(y) AS y1, arg_max(x, y) AS x1 FROM trk GROUP BY 1, 2)"


@query("d2_gap_candidates", ENDS + " SELECT a.image, a.track AS a, b.track AS b, b.y0 - a.y1 AS gap FROM ends a JOIN ends b ON a.image = b.image AND a.track <> b.track AND b.y0 - a.y1 > 0 AND b.y0 - a.y1 <= 4 AND abs(b.x0 - a.x1) <= 2")
def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return G.gap_candidates(track_ends(spark, d), 4, 2)


@query("d3_end_start_merge")
def end_start_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pieces joined to the piece that follows, where the bridge between them is probable enough."""
    limits = stash(G.track_limits(pieces(spark, d)), "d3-limits")
    chains = G.chained(G.bridges(limits, unit(spark, d), 6, 4, 0.10))
    return limits.select("image", "track").join(chains, ["image", "track"], "left").select("image", "track", F.coalesce("chain", "track").alias("chain"))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of tracks inside the image."""
    p = points(spark, d).withColumn("track", F.col("track") * 10 + F.floor(F.col("y") / 8))
    return p.withColumn("x", F.least(F.greatest("x", F.lit(0)), F.lit(63)))


PIECES = "pc AS (SELECT image, track * 10 + y // 8 AS track, y, least(greatest(x, 0), 63) AS x FROM trk)"


@query("i24_end_extension", "WITH RECURSIVE " + TRK.strip().removeprefix("WITH") + ", " + UNIT.strip().removeprefix("WITH").strip().replace("e AS (", "e2 AS (", 1).replace("FROM e)", "FROM e2)", 1) + ", " + PIECES + """,
nxt AS (SELECT c.image, c.y, c.x, s.side, arg_max(n.x, (n.v, -n.x)) AS nx, max(n.v) AS nv FROM unit c, (VALUES (-1), (1)) s(side), unit n WHERE n.image = c.image AND n.y = c.y + s.side AND n.x BETWEEN c.x - 3 AND c.x + 3 GROUP BY ALL),
fr AS (SELECT image, track, -1 AS side, arg_min(y, (y, x)) AS y, arg_min(x, (y, x)) AS x FROM pc GROUP BY 1, 2 UNION ALL SELECT image, track, 1, arg_max(y, (y, x)), arg_max(x, (y, x)) FROM pc GROUP BY 1, 2),
walk AS (SELECT image, track, side, -1 AS i, y, x FROM fr UNION ALL SELECT w.image, w.track, w.side, w.i + 1, w.y + w.side, n.nx FROM walk w JOIN nxt n ON n.image = w.image AND n.y = w.y AND n.x = w.x AND n.side = w.side AND n.nv >= 0.12 WHERE w.i < 9)
SELECT image, track, side, i, y, x FROM walk WHERE i >= 0""")
def end_extension(spark: SparkSession, d: str) -> DataFrame:
    return G.extend_ends(G.track_limits(pieces(spark, d)), unit(spark, d))


@query("i25_refine")
def refine(spark: SparkSession, d: str) -> DataFrame:
    """Ends extended, pieces joined over probable bridges, one point a row."""
    return K.collapse(G.refine(pieces(spark, d), unit(spark, d)))


@query("e9_track_score", TRK + " SELECT image, track, median(x) AS score FROM trk GROUP BY 1, 2")
def track_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("image", "track", "score")


@query("e19_recall_precision", TRK + ", g AS (SELECT image, track, y, x FROM trk WHERE track % 2 = 0), p AS (SELECT image, track, y, x FROM trk WHERE track % 2 = 1), h AS (SELECT g.image, g.track AS g, p.track AS p, count(DISTINCT g.y) AS hit FROM g JOIN p ON g.image = p.image AND abs(p.y - g.y) <= 3 AND sqrt(power(p.y - g.y, 2) + power(p.x - g.x, 2)) <= 3.2 GROUP BY 1, 2, 3), r AS (SELECT image, g, max(hit) / 31.0 AS recall FROM h GROUP BY 1, 2) SELECT image, round(sum(recall) / 13.0, 6) AS recall FROM r GROUP BY 1")
def recall(spark: SparkSession, d: str) -> DataFrame:
    """Even tracks as the truth, odd ones as found: the best share of matched rows per track, averaged."""
    p = points(spark, d)
    found = p.where("track % 2 = 1").select("image", F.col("track").alias("p"), F.explode(F.sequence(F.col("y") - 3, F.col("y") + 3)).alias("y"), F.col("y").alias("py"), F.col("x").alias("px"))
    met = p.where("track % 2 = 0").join(found, ["image", "y"]).where(F.sqrt(F.pow(F.col("py") - F.col("y"), F.lit(2)) + F.pow(F.col("px") - F.col("x"), F.lit(2))) <= 3.2)
    hit = met.groupBy("image", "track", "p").agg(F.count_distinct("y").alias("hit")).groupBy("image", "track").agg((F.max("hit") / 31.0).alias("r"))
    return hit.groupBy("image").agg(r6(F.sum("r") / 13.0, "recall"))
