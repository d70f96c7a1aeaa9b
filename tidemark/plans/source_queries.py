"""Uploads and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import runs
from tidemark.operators import grid as G
from tidemark.operators import tracks as T
from tidemark.plans import image_queries, track_queries
from tidemark.plans.registry import query, r6, table
from tidemark.sources import files


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Stand-ins for uploaded files: a workbook's, an old workbook's or a text's first bytes before a customer's name."""
    k = F.col("c_custkey") % 3
    head = F.when(k == 0, F.unhex(F.lit(files.XLSX))).when(k == 1, F.unhex(F.lit(files.XLS))).otherwise(F.lit(b""))
    return table(spark, d, "customer").select("c_custkey", F.concat(head, F.encode("c_name", "UTF-8")).alias("content"))


@query("a1_xlsx_sniff", "SELECT c_custkey, c_custkey % 3 = 0 AS is_xlsx FROM customer")
def xlsx_sniff(spark: SparkSession, d: str) -> DataFrame:
    return uploads(spark, d).select("c_custkey", files.is_xlsx(F.col("content")).alias("is_xlsx"))


@query("a2_xls_sniff", "SELECT c_custkey, c_custkey % 3 = 1 AS is_xls FROM customer")
def xls_sniff(spark: SparkSession, d: str) -> DataFrame:
    return uploads(spark, d).select("c_custkey", files.is_xls(F.col("content")).alias("is_xls"))


@query("a3_text_decode", "SELECT c_custkey, c_name || 'é' AS text FROM customer")
def text_decode(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey") % 3, F.encode("c_name", "UTF-8")
    marked, plain, latin = F.concat(F.unhex(F.lit("EFBBBF")), name, F.unhex(F.lit("C3A9"))), F.concat(name, F.unhex(F.lit("C3A9"))), F.concat(name, F.unhex(F.lit("E9")))
    return table(spark, d, "customer").select("c_custkey", files.decoded(F.when(k == 0, marked).when(k == 1, plain).otherwise(latin)).alias("text"))


@query("a4_table_scan", "WITH e AS (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings) SELECT CAST(vec_id AS VARCHAR) AS path, CAST(k // 8 AS INTEGER) AS row, CAST(k % 8 AS INTEGER) AS col, round(CAST(embedding[k + 1] AS DOUBLE), 6) AS v FROM e")
def table_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each array, written as a text of rows of eight numbers with a delimiter that is to be found, and read again."""
    sep = F.element_at(F.array(*[F.lit(x) for x in ",\t;|"]), (F.col("vec_id") % 4 + 1).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 8).cast("int")), lambda i: F.array_join(F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double").cast("string")), "~"))
    text = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.encode(F.replace(F.array_join(rows, "\n"), F.lit("~"), sep), "UTF-8").alias("content"))
    return files.table_cells(text).select("path", "row", "col", r6("v"))


@query("a5_image_scan", image_queries.UNIT + " SELECT CAST(image AS VARCHAR) || '.png' AS path, y, x, CAST(floor(v * 255) AS INTEGER) AS r FROM unit")
def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """Written as PNG files' bytes, and read again."""
    return files.image_pixels(files.image_files(image_queries.unit(spark, d))).select("path", "y", "x", "r")


@query("a6_grayscale_scan", image_queries.UNIT + " SELECT CAST(image AS VARCHAR) || '.png' AS path, y, x, CAST(floor(v * 255) AS DOUBLE) AS gray FROM unit")
def grayscale_scan(spark: SparkSession, d: str) -> DataFrame:
    gray = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"), 3)
    return files.image_pixels(files.image_files(image_queries.unit(spark, d))).select("path", "y", "x", gray.alias("gray"))


@query("b6_heatmap_png")
def heatmap_png(spark: SparkSession, d: str) -> DataFrame:
    return files.image_files(image_queries.unit(spark, d)).select("path", F.length("content").alias("bytes"))


@query("a11_braced_tracks", "WITH e AS (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings WHERE vec_id % 5 <> 0) SELECT vec_id, CAST(k AS INTEGER) AS i, CAST(k AS DOUBLE) AS frame, round(CAST(embedding[k + 1] AS DOUBLE) * 100) AS position FROM e")
def braced(spark: SparkSession, d: str) -> DataFrame:
    """Tracks printed in braces among other output."""
    point = lambda v, k: F.format_string("{%d, %d}", k, F.round(v.cast("double") * 100).cast("int"))
    text = F.concat(F.lit("loading {x}\n"), F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("{{"), F.array_join(F.transform("embedding", point), ", "), F.lit("}} done {1}"))).otherwise("nothing"))
    t = table(spark, d, "embeddings").select("vec_id", files.braced_tracks(text).alias("t")).select("vec_id", F.explode("t").alias("p")).select("vec_id", F.posexplode("p").alias("i", "q"))
    return t.select("vec_id", "i", F.get("q", F.lit(0)).alias("frame"), F.get("q", F.lit(1)).alias("position"))


W = track_queries
EXPORT_SQL = W.BASE + W.WAVES + """ SELECT CAST(track_index AS VARCHAR) || '-' || CAST(peak_ord AS VARCHAR) AS wave_id, CAST(peak_i AS VARCHAR) AS peak_i, wave_type, CASE WHEN fit_error IS NULL THEN '' ELSE 'x' END AS has_error FROM waves"""


@query("b1_waves_csv", EXPORT_SQL)
def waves_csv(spark: SparkSession, d: str) -> DataFrame:
    """Some columns of the export; the whole of it has duplicate names, as its readers expect, and is made by wave_export."""
    w = T.wave_rows(*W.analysed(spark, d), W.RATE, W.FRAC)
    out = files.wave_export(w)
    flat = out.toDF(*[f"c{k}" for k in range(len(out.columns))])
    return flat.select(F.col("c0").alias("wave_id"), F.regexp_replace("c22", r"\.0$", "").alias("peak_i"), F.col("c26").alias("wave_type"), F.when(F.col("c24") == "", "").otherwise("x").alias("has_error"))


@query("b2_visible_tracks_csv", W.BASE + " SELECT track_index, '\"' || string_agg(CAST(peak_i AS VARCHAR), ',' ORDER BY peak_i) || '\"' AS peaks FROM peaks GROUP BY 1 HAVING count(*) > 1")
def visible_tracks(spark: SparkSession, d: str) -> DataFrame:
    p = T.find_peaks(W.residuals(spark, d), W.PROMINENCE).groupBy("track_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("peak_i")), lambda x: x.cast("string")), ",").alias("l"), F.count(F.lit(1)).alias("n"))
    return p.where("n > 1").select("track_index", files.quoted(F.col("l")).alias("peaks"))


@query("b3_track_json", W.BASE + " SELECT track_index, '{\"track_index\":' || CAST(track_index AS VARCHAR) || ',\"peaks\":' || CAST(count(*) AS VARCHAR) || '}' AS json FROM peaks GROUP BY 1")
def track_json(spark: SparkSession, d: str) -> DataFrame:
    p = T.find_peaks(W.residuals(spark, d), W.PROMINENCE).groupBy("track_index").agg(F.count(F.lit(1)).alias("peaks"))
    return p.select("track_index", F.to_json(F.struct("track_index", "peaks")).alias("json"))


@query("b4_track_arrays", "SELECT user_id AS track_index, count(*) AS points FROM events GROUP BY 1 HAVING count(*) >= 60")
def track_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of enough points as arrays."""
    t = T.from_rows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").groupBy("track_index").agg(F.array_sort(F.collect_list(F.struct("frame", "position"))).alias("points"))
    return t.where(F.size("points") >= 60).select("track_index", F.size("points").cast("long").alias("points"))


def overlays(spark: SparkSession, d: str) -> DataFrame:
    out = runs.overlays(*W.analysed(spark, d), 16)
    return out.withColumn("sample", F.concat(F.lit('sample "'), F.col("track_index").cast("string"), F.lit('", new')))


POLY = ", k AS (SELECT CAST(floor(j * 63.0 / 15) AS INTEGER) AS i FROM (SELECT unnest(range(16)) AS j)), poly AS (SELECT track_index, count(*) AS points, round(sum(position), 4) AS x_sum, sum(frame) AS y_sum FROM tr JOIN k USING (i) GROUP BY 1), pp AS (SELECT track_index, count(*) AS peaks, round(avg(residual), 4) AS mean_amplitude, round(sum(residual * peak_i), 3) AS amp_sum FROM peaks GROUP BY 1)"


@query("b2_visible_tracks_whole", W.BASE + POLY + " SELECT track_index, 'sample \"' || track_index || '\", new' AS sample, CAST(points AS INTEGER) AS points, CAST(peaks AS INTEGER) AS peaks, mean_amplitude, round(frequency, 6) AS dominant_frequency, round(1 / frequency, 6) AS period, x_sum, y_sum, amp_sum FROM poly JOIN pp USING (track_index) JOIN freq USING (track_index)")
def visible_tracks_whole(spark: SparkSession, d: str) -> DataFrame:
    """All nine columns as CSV lines, read back by a CSV reader; the arrays are read from their JSON."""
    lines = files.csv_lines(files.visible_tracks(overlays(spark, d)))
    kinds = "track_index long, sample string, points int, peaks int, mean_amplitude double, dominant_frequency double, period double, poly string, peak_points string"
    back = lines.select(F.from_csv("line", kinds, {"escape": '"'}).alias("r")).select("r.*")
    poly, tops = F.from_json("poly", "array<struct<x:double,y:double>>"), F.from_json("peak_points", "array<struct<i:int,x:double,y:double,amp:double>>")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, p: s + f(p))
    return back.select(
        "track_index", "sample", "points", "peaks", F.round("mean_amplitude", 4).alias("mean_amplitude"), r6("dominant_frequency"), r6("period"), F.round(total(poly, lambda p: p["x"]), 4).alias("x_sum"),
        total(poly, lambda p: p["y"]).alias("y_sum"), F.round(total(tops, lambda p: p["amp"] * p["i"]), 3).alias("amp_sum"),
    )


@query("b3_track_documents", W.BASE + W.LOCAL + W.fit_sql("src") + ", s AS (SELECT track_index, count(*) AS samples, round(sum(residual * i * i), 2) AS residual_sum FROM res GROUP BY 1) SELECT track_index, any_value(samples) AS samples, any_value(residual_sum) AS residual_sum, count(*) AS peaks, round(sum(fit_amp), 4) AS amp_sum, CAST(sum(fit_lo + 3 * fit_hi) AS DOUBLE) AS window_sum, round(any_value(frequency), 6) AS freq_hz FROM fit JOIN s USING (track_index) JOIN freq USING (track_index) GROUP BY 1")
def track_documents(spark: SparkSession, d: str) -> DataFrame:
    """The document of every track, read back from its JSON."""
    res, peaks, freq = W.analysed(spark, d)
    docs = files.track_documents(overlays(spark, d), res, T.peak_rows(res, peaks, freq, W.RATE, W.FRAC, local=True))
    kinds = "track struct<freq_hz:double>, detail struct<track_index:bigint,samples:array<struct<i:int,residual:double>>,peaks:array<struct<fit_amp:double,fit_lo:int,fit_hi:int>>>"
    j = docs.select(F.from_json("json", kinds).alias("j")).select("j.detail.*", F.col("j.track.freq_hz").alias("freq_hz"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, p: s + f(p))
    return j.select(
        "track_index", F.size("samples").cast("long").alias("samples"), F.round(total(F.col("samples"), lambda p: p["residual"] * p["i"] * p["i"]), 2).alias("residual_sum"), F.size("peaks").cast("long").alias("peaks"),
        F.round(total(F.col("peaks"), lambda p: p["fit_amp"]), 4).alias("amp_sum"), total(F.col("peaks"), lambda p: p["fit_lo"] + 3 * p["fit_hi"]).alias("window_sum"), r6("freq_hz"),
    )


@query("b4_track_files", "WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT CAST(user_id AS VARCHAR) || '.npy' AS path, CAST(i AS INTEGER) AS i, CAST(i AS DOUBLE) AS frame, round(value, 6) AS position FROM e WHERE n >= 60")
def track_files(spark: SparkSession, d: str) -> DataFrame:
    """One .npy file's bytes for each track of 60 points or more, read again."""
    t = T.from_rows(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return files.array_tracks(files.array_files(t, 60)).select("path", "i", "frame", r6("position"))


@query("b1_waves_csv_whole", W.BASE + W.WAVES + """ SELECT track_index || '-' || peak_ord AS c00, CAST(track_index AS DOUBLE) AS c01, CAST(peak_ord AS DOUBLE) AS c02, round(frame1, 6) AS c03, round(frame2, 6) AS c04, round(period_frames, 6) AS c05, round(period_frames, 6) AS c06, round(freq_hz, 6) AS c07,
round(pos1, 6) AS c08, round(pos2, 6) AS c09, round(residual, 6) AS c10, round(pos1, 6) AS c11, round(pos2, 6) AS c12, round(frame1, 6) AS c13, round(frame2, 6) AS c14, round(frame1, 6) AS c15, round(frame2, 6) AS c16, round(frame2 - frame1, 6) AS c17, round(delta_pos, 6) AS c18,
round(CASE WHEN period_frames <> 0 THEN delta_pos / period_frames END, 6) AS c19, round(freq_hz, 6) AS c20, round(abs(delta_pos), 6) AS c21, round(frame, 6) AS c22, round(position, 6) AS c23, round(fit_error, 6) AS c24, 'true' AS c25, wave_type AS c26, round(type_score, 6) AS c27 FROM waves""")
def waves_csv_whole(spark: SparkSession, d: str) -> DataFrame:
    """All 28 columns as CSV lines, read back by a CSV reader; their names, some of them twice, give way to numbers."""
    out = files.wave_export(T.wave_rows(*W.analysed(spark, d), W.RATE, W.FRAC))
    names = [f"c{k:02d}" for k in range(len(out.columns))]
    text = {"c00", "c25", "c26"}
    kinds = ", ".join(f"{c} {'string' if c in text else 'double'}" for c in names)
    back = files.csv_lines(out.toDF(*names)).select(F.from_csv("line", kinds, {"escape": '"'}).alias("r")).select("r.*")
    return back.select(*[F.col(c) if c in text else F.round(c, 6).alias(c) for c in names])


DEBUG_SQL = image_queries.IMG + ", mk AS (SELECT image, y, x, CASE WHEN v >= 12 THEN 1.0 ELSE 0.0 END AS v FROM img)" + image_queries.DIRECT.replace("FROM img", "FROM mk") + " SELECT image, round(min(img.v), 4) AS low, round(max(img.v), 4) AS high, round(avg(img.v), 4) AS mean, CAST(sum(mk.v) AS BIGINT) AS raw, CAST(sum(a4.v) AS BIGINT) AS clean, round(100.0 * sum(a4.v) / count(*), 4) AS clean_percent FROM img JOIN mk USING (image, y, x) JOIN a4 USING (image, y, x) GROUP BY 1"


@query("b7_debug_stages", DEBUG_SQL)
def debug_stages(spark: SparkSession, d: str) -> DataFrame:
    """The probabilities, the raw mask and the cleaned one side by side, and their figures."""
    img = image_queries.images(spark, d)
    raw = img.withColumn("v", (F.col("v") >= 12).cast("double"))
    clean = G.directional(raw, 5, 5, False).withColumnRenamed("v", "clean")
    g = img.withColumn("raw", (F.col("v") >= 12).cast("double")).join(clean, ["image", "y", "x"]).groupBy("image")
    share = 100.0 * F.sum("clean") / F.count(F.lit(1))
    r4 = lambda c, name: F.round(c, 4).alias(name)
    return g.agg(r4(F.min("v"), "low"), r4(F.max("v"), "high"), r4(F.avg("v"), "mean"), F.sum("raw").cast("long").alias("raw"), F.sum("clean").cast("long").alias("clean"), r4(share, "clean_percent"))


@query("a7_npy_scan", track_queries.TR + " SELECT CAST(track_index AS VARCHAR) || '.npy' AS path, i, frame, round(position, 6) AS position FROM tr")
def npy_scan(spark: SparkSession, d: str) -> DataFrame:
    """Tracks written as .npy files' bytes, and read again."""
    return files.array_tracks(files.array_files(track_queries.tracks(spark, d))).select("path", "i", "frame", r6("position"))


@query("a12_blob_read")
def blob_read(spark: SparkSession, d: str) -> DataFrame:
    """The files of a table as blobs."""
    b = files.read_blobs(spark, f"{d}/nation.parquet", "*.parquet")
    return b.select("name", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("b5_tracks_csv", image_queries.TRK + " SELECT CAST(image AS VARCHAR) || ',' || CAST(track AS VARCHAR) || ',' || CAST(y AS VARCHAR) || ',' || CAST(x AS VARCHAR) AS line FROM trk")
def tracks_csv(spark: SparkSession, d: str) -> DataFrame:
    return image_queries.points(spark, d).select(F.concat_ws(",", "image", "track", "y", "x").alias("line"))


@query("b7_debug_stats", image_queries.IMG + " SELECT image, count(CASE WHEN v >= 12 THEN 1 END) AS raw, count(CASE WHEN v >= 20 THEN 1 END) AS strong FROM img GROUP BY 1")
def debug_stats(spark: SparkSession, d: str) -> DataFrame:
    return image_queries.images(spark, d).groupBy("image").agg(F.count_if(F.col("v") >= 12).alias("raw"), F.count_if(F.col("v") >= 20).alias("strong"))


@query("i4_area_resize", image_queries.IMG + " SELECT image, CAST(y // 5 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, round(avg(v), 6) AS v FROM img GROUP BY 1, 2, 3")
def area_resize(spark: SparkSession, d: str) -> DataFrame:
    g = image_queries.images(spark, d).groupBy("image", F.floor(F.col("y") / 5).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x"))
    return g.agg(r6(F.avg("v"), "v"))


AREA = "ax AS (SELECT o, i, greatest(0.0, least((o + 1) * s, i + 1) - greatest(o * s, i)) / s AS w FROM (SELECT unnest(range({to})) AS o), (SELECT unnest(range({n})) AS i), (SELECT {n} / {to}.0 AS s))"
LINEAR = "ax AS (SELECT o, i, greatest(0.0, 1 - abs(least(greatest((o + 0.5) * s - 0.5, 0), {n} - 1) - i)) AS w FROM (SELECT unnest(range({to})) AS o), (SELECT unnest(range({n})) AS i), (SELECT {n} / {to}.0 AS s))"
BILINEAR = "ax AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, greatest(0.0, 1 - abs(i + 0.5 - (o + 0.5) * s) / greatest(s, 1)) AS w FROM (SELECT unnest(range({to})) AS o), (SELECT unnest(range({n})) AS i), (SELECT {n} / {to}.0 AS s)))"


def resize_sql(kind: str, to_height: int, to_width: int) -> str:
    ys, xs = (kind.replace("ax AS", f"{a} AS").format(n=n, to=to) for a, n, to in (("wy", 50, to_height), ("wx", 64, to_width)))
    return image_queries.IMG + f", {ys}, {xs} SELECT image, CAST(wy.o AS INTEGER) AS y, CAST(wx.o AS INTEGER) AS x, round(sum(v * wy.w * wx.w), 6) AS v FROM img JOIN wy ON wy.i = img.y AND wy.w > 0 JOIN wx ON wx.i = img.x AND wx.w > 0 GROUP BY 1, 2, 3"


@query("i4_resize_area", resize_sql(AREA, 37, 41))
def resize_area(spark: SparkSession, d: str) -> DataFrame:
    """By no whole factor."""
    return image_queries.pixels(G.resize(image_queries.images(spark, d), 50, 64, 37, 41, "area"))


@query("i4_resize_linear", resize_sql(LINEAR, 73, 41))
def resize_linear(spark: SparkSession, d: str) -> DataFrame:
    """Larger one way, smaller the other."""
    return image_queries.pixels(G.resize(image_queries.images(spark, d), 50, 64, 73, 41, "linear"))


@query("i4_resize_bilinear", resize_sql(BILINEAR, 21, 90))
def resize_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return image_queries.pixels(G.resize(image_queries.images(spark, d), 50, 64, 21, 90, "bilinear"))


@query("i19_line_points", "WITH e AS (SELECT p_partkey, CAST(p_partkey % 13 AS INTEGER) AS y0, CAST(p_size AS INTEGER) AS y1, 0 AS x0, CAST(p_partkey % 7 AS INTEGER) AS x1 FROM part), n AS (SELECT *, greatest(abs(y1 - y0), abs(x1 - x0)) AS n FROM e), k AS (SELECT *, unnest(range(n + 1)) AS i FROM n) "
       "SELECT p_partkey, CAST(i AS INTEGER) AS i, CAST(CASE WHEN n = 0 THEN y0 ELSE y0 + sign(y1 - y0) * ceil(i * abs(y1 - y0) / CAST(n AS DOUBLE) - 0.5) END AS INTEGER) AS y, CAST(CASE WHEN n = 0 THEN x0 ELSE x0 + sign(x1 - x0) * ceil(i * abs(x1 - x0) / CAST(n AS DOUBLE) - 0.5) END AS INTEGER) AS x FROM k")
def line_points(spark: SparkSession, d: str) -> DataFrame:
    """Integer lines between each part's two points, as a table function would give them."""
    ends = (F.col("p_partkey") % 13).cast("int"), F.lit(0), F.col("p_size").cast("int"), (F.col("p_partkey") % 7).cast("int")
    p = table(spark, d, "part").select("p_partkey", F.posexplode(G.line_points(*ends)).alias("i", "p"))
    return p.select("p_partkey", "i", F.get("p", F.lit(0)).alias("y"), F.get("p", F.lit(1)).alias("x"))
