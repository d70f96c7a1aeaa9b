"""Uploads: format sniffing, text decoding, numeric tables, PNG images, track lists; and the exports."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of file formats.
XLSX, XLS, PNG = "504B0304", "D0CF11E0A1B11AE1", b"\x89PNG\r\n\x1a\n"


def is_xlsx(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 4)) == XLSX


def is_xls(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 8)) == XLS


def decoded(content: Column) -> Column:
    """Text: UTF-8 (without its mark) if valid, else Latin-1, which always is."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def delimiter(text: Column) -> Column:
    """The most frequent of tab, comma, semicolon and bar in the first line; comma if there is none."""
    line = F.element_at(F.split(text, "\n"), 1)
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate("\t,;|")]))
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def table_cells(files: DataFrame) -> DataFrame:
    """path, row, col, v of headerless numeric tables (path, content). A cell that isn't a number fails; blank lines are skipped.

    Workbooks fail here: reading them needs a library that isn't part of Spark.
    """
    text = files.select("path", F.when(is_xlsx(F.col("content")), F.raise_error(F.lit("workbooks can't be read"))).otherwise(decoded(F.col("content"))).alias("t"))
    lines = text.select("path", delimiter(F.col("t")).alias("d"), F.posexplode(F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x) != "")).alias("row", "line"))
    parts = F.split(F.replace(F.col("line"), F.col("d"), F.lit("\u0001")), "\u0001")
    cells = lines.select("path", "row", F.posexplode(parts).alias("col", "c"))
    number = F.when(F.trim("c") == "", float("nan")).otherwise(F.trim("c").try_cast("double"))
    return cells.select("path", "row", "col", F.when(number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.col("c"))).cast("double")).otherwise(number).alias("v"))


def png_encode(pixels: np.ndarray) -> bytes:
    """An 8-bit grayscale or RGB PNG."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1).astype(np.uint8)], axis=1).tobytes()
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """Height x width x channels of an 8-bit PNG that isn't interlaced or indexed."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, laced = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += n + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or laced or channels is None:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)
    out = np.zeros((h, w * channels), np.uint8)
    above = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, row = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 2:
            row = row + above
        elif kind:
            for i in range(len(row)):
                left, up, corner = (row[i - channels] if i >= channels else 0), above[i], (above[i - channels] if i >= channels else 0)
                near = left + up - corner
                paeth = min(((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner)))[2]
                row[i] = (row[i] + (left if kind == 1 else (left + up) // 2 if kind == 3 else paeth)) & 255
        above = row & 255
        out[y] = above
    return out.reshape(h, w, channels)


def image_pixels(files: DataFrame, background: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """path, y, x, r, g, b of PNG files (path, content), transparent pixels laid over the background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                a = png_decode(bytes(content)).astype(float)
                alpha = a[:, :, -1:] / 255 if a.shape[2] in (2, 4) else np.ones((*a.shape[:2], 1))
                rgb = np.repeat(a[:, :, :1], 3, axis=2) if a.shape[2] < 3 else a[:, :, :3]
                rgb = np.rint(rgb * alpha + np.array(background) * (1 - alpha)).astype(int)
                y, x = np.indices(a.shape[:2])
                yield pd.DataFrame({"path": path, "y": y.ravel(), "x": x.ravel(), "r": rgb[:, :, 0].ravel(), "g": rgb[:, :, 1].ravel(), "b": rgb[:, :, 2].ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, y int, x int, r int, g int, b int")


def image_files(pixels: DataFrame) -> DataFrame:
    """path, content: one grayscale PNG per image of pixel rows (image, y, x, v in [0, 1])."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), np.uint8)
        grid[pdf["y"], pdf["x"]] = np.floor(np.clip(pdf["v"], 0, 1) * 255).astype(np.uint8)
        return pd.DataFrame({"path": [f"{pdf['image'].iloc[0]}.png"], "content": [png_encode(grid)]})

    return pixels.groupBy("image").applyInPandas(run, "path string, content binary")


def read_blobs(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, content of the files below a folder (or of one file) on any file system Spark reads, whose names fit the pattern."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def array_files(tracks: DataFrame, least: int = 1) -> DataFrame:
    """path, content: one .npy file of (n, 2) doubles, frame and position, for each track (track_index, i, frame, position) of at least
    `least` points, named after the track."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=["path", "content"])
        out = io.BytesIO()
        np.save(out, pdf.sort_values("i")[["frame", "position"]].to_numpy(float))
        return pd.DataFrame({"path": [f"{pdf['track_index'].iloc[0]}.npy"], "content": [out.getvalue()]})

    return tracks.select("track_index", "i", "frame", "position").groupBy("track_index").applyInPandas(run, "path string, content binary")


def array_tracks(files: DataFrame, order: str = "yx") -> DataFrame:
    """path, i, frame, position of .npy files (path, content): two columns or more in 'yx' or 'xy' order, sorted stably by frame, or one
    dimension, whose frames count from 0. Any other shape fails. Pickled objects aren't read.
    """

    def one(path: str, content: bytes) -> pd.DataFrame:
        a = np.load(io.BytesIO(content), allow_pickle=False)
        if a.ndim == 1:
            frame, position = np.arange(len(a), dtype=float), a.astype(float)
        elif a.ndim == 2 and a.shape[1] >= 2:
            frame, position = (a[:, k].astype(float) for k in ((0, 1) if order == "yx" else (1, 0)))
            by = np.argsort(frame, kind="stable")
            frame, position = frame[by], position[by]
        else:
            raise ValueError(f"{path}: a track has one dimension or two columns, not the shape {a.shape}")
        return pd.DataFrame({"path": path, "i": np.arange(len(frame), dtype=np.int32), "frame": frame, "position": position})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield one(path, bytes(content))

    return files.select("path", "content").mapInPandas(run, "path string, i int, frame double, position double")


def braced_tracks(text: Column) -> Column:
    """array<array<array<double>>> of the first balanced {{{...}}} block in a text; null if there is none."""
    start = F.instr(text, "{{{")
    letters = F.split(F.substr(text, start), "")
    step = lambda s, c: F.when(s["done"], s).otherwise(_depth(s, c))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    n = F.aggregate(F.filter(letters, lambda c: c != ""), zero, step, lambda s: F.when(s["done"], s["n"]))
    block = F.when((start > 0) & n.isNotNull(), F.substr(text, start, n))
    return F.from_json(F.translate(block, "{}", "[]"), "array<array<array<double>>>")


def _depth(s: Column, c: Column) -> Column:
    depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
    return F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("done"))


#: The columns of the wave export, in order, and where each comes from.
WAVE_EXPORT = [
    ("wave_id", "wave_id"), ("track_id", "track_index"), ("wave_index", "wave_index"), ("Frame position 1 (y-axis)", "frame1"), ("Frame position 2 (y-axis)", "frame2"),
    ("Period In Frames (Frame 1- Frame 2)", "period_frames"), ("Period in Seconds", "period_s"), ("Frequency (Hertz)", "freq_hz"), ("Pixel Position 1 (x-axis)", "pos1"), ("Pixel Position 2 (x-axis)", "pos2"),
    ("Amplitude (Pixels)", "amplitude"), ("Position 1 (x-axis)", "pos1"), ("Position 2 (x-axis)", "pos2"), ("Frame 1 (y-axis)", "frame1"), ("Frame 2 (y-axis)", "frame2"), ("Frame 1 (seconds)", "t_start"),
    ("Frame 2 (seconds)", "t_end"), ("Seconds 2 - Seconds 1", "seconds_delta"), ("Position2 -Position 1", "delta_pos"), ("Velocity (pixels/sec)", "velocity"), ("Frequency (Hz)", "freq_hz"), ("Wavelength (Pixels)", "wavelength"),
    ("Peak Frame (y-axis)", "frame"), ("Peak Position (x-axis)", "position"), ("Fit Error (VNMSE)", "fit_error"), ("Fit Passes Peak", "fit_passes"), ("Wave Type", "wave_type"), ("Type Score", "type_score"),
]


def wave_export(waves: DataFrame) -> DataFrame:
    """The 28 columns of the wave table, nulls as empty text, ordered by track and wave."""
    w = waves.withColumns({
        "wave_id": F.format_string("%d-%d", "track_index", F.col("peak_ord")), "wave_index": F.col("peak_ord"), "amplitude": F.col("residual"), "seconds_delta": F.col("t_end") - F.col("t_start"), "fit_passes": F.lit(True),
    }).orderBy("track_index", "peak_ord")
    text = lambda c: F.coalesce(F.round(c, 6).cast("string") if w.schema[c].dataType.typeName() == "double" else F.col(c).cast("string"), F.lit(""))
    return w.select(*[text(c).alias(name) for name, c in WAVE_EXPORT])


def quoted(c: Column) -> Column:
    """A CSV field: in quotes, doubled inside, if it holds a comma, quote or line end."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


#: The columns of the table of visible tracks, in order.
VISIBLE = ("track_index", "sample", "points", "peaks", "mean_amplitude", "dominant_frequency", "period", "poly", "peak_points")


def visible_tracks(overlays: DataFrame) -> DataFrame:
    """The columns VISIBLE of overlays (track_index, sample, poly, peaks with amp, freq_hz, period); poly and peak_points as JSON text."""
    amps = F.filter(F.transform("peaks", lambda p: p["amp"]), lambda a: a.isNotNull())
    mean = F.when(F.size(amps) > 0, F.aggregate(amps, F.lit(0.0), lambda s, a: s + a) / F.size(amps))
    return overlays.select(
        "track_index", "sample", F.size("poly").alias("points"), F.size("peaks").alias("peaks"), mean.alias("mean_amplitude"), F.col("freq_hz").alias("dominant_frequency"), "period",
        F.to_json("poly").alias("poly"), F.to_json("peaks").alias("peak_points"),
    )


def csv_lines(df: DataFrame) -> DataFrame:
    """line: each row's columns as a CSV line, nulls empty, quoted where needed."""
    text = [F.coalesce(quoted(F.col(c).cast("string")), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws(",", *text).alias("line"))


def track_documents(overlays: DataFrame, samples: DataFrame, peaks: DataFrame) -> DataFrame:
    """track_index, json: {track, detail} of each track. track is its overlay; detail has the samples (frame, position, baseline, residual)
    in order and all columns of its peak rows, by peak_ord."""
    s = samples.groupBy("track_index").agg(F.array_sort(F.collect_list(F.struct("i", "frame", "position", "baseline", "residual"))).alias("samples"))
    p = peaks.groupBy("track_index").agg(F.array_sort(F.collect_list(F.struct("peak_ord", *[c for c in peaks.columns if c not in ("track_index", "peak_ord")]))).alias("peaks"))
    both = overlays.withColumnRenamed("peaks", "peak_points").join(s, "track_index").join(p, "track_index", "left")
    track = F.struct(*[c for c in both.columns if c not in ("samples", "peaks")])
    return both.select("track_index", F.to_json(F.struct(track.alias("track"), F.struct("track_index", "samples", "peaks").alias("detail"))).alias("json"))
