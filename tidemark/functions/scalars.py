"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
FNV_START, FNV_FACTOR = 2166136261, 16777619


def sample_id(name: Column) -> Column:
    """A number below ten million from a name: 32-bit FNV-1a over code points (below U+0080 the bytes)."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    mixed = F.aggregate(letters, F.lit(FNV_START), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(FNV_FACTOR)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return mixed % 10_000_000


def track_id(stem: Column) -> Column:
    """The number that a file stem is, else null."""
    return F.when(stem.rlike(r"^\d+$"), stem.try_cast("bigint"))


def safe_name(c: Column) -> Column:
    """Runs of characters that a path shouldn't have become one underscore."""
    return F.regexp_replace(c, "[^a-zA-Z0-9._-]+", "_")


def blob_path(root: str, job: Column, kind: Column, label: Column, file: Column) -> Column:
    """{root}/jobs/{job}/{kind}/{label if any}/{file}"""
    return F.concat_ws("/", F.lit(root), F.lit("jobs"), job.cast("string"), safe_name(kind), F.when(F.length(label) > 0, safe_name(label)), safe_name(file))


def is_image(content_type: Column, file: Column) -> Column:
    """By content type, or else by suffix."""
    suffix = F.lower(F.element_at(F.split(file, r"\."), -1))
    return F.coalesce(content_type.startswith("image/"), F.lit(False)) | (file.contains(".") & suffix.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"))


def hex_channel(color: Column, k: int) -> Column:
    """Channel k (0 to 2) of #rgb or #rrggbb; null if it is neither."""
    bare = F.lower(F.regexp_replace(F.trim(color), "^#", ""))
    full = F.when(F.length(bare) == 3, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    return F.when(full.rlike("^[0-9a-f]{6}$"), F.conv(F.substring(full, 2 * k + 1, 2), 16, 10).cast("int"))


def sample_name(path: Column) -> Column:
    """The grandparent folder's name, without _heatmap at its end."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -3), "_heatmap$", "")


def resized(width: Column, height: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Output size: both given, one given (the other in proportion, half-even, at least 1), or none."""
    at_least = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(1), F.bround(c).cast("int")))
    return F.coalesce(w, at_least(width * h / height), width), F.coalesce(h, at_least(height * w / width), height)


def duration(seconds: Column) -> Column:
    """Xm Ys"""
    s = F.floor(seconds).cast("int")
    return F.when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
