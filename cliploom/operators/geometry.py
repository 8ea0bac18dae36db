"""Crops, sizes and resolution buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return x.cast("int")


def _half(x: Column) -> Column:
    return F.floor(x / 2).cast("int")


def crop_windows(det: DataFrame, w: int, h: int, mode: str = "center", padding: float = 0.6) -> DataFrame:
    """Crop (crop_x, crop_y, crop_w, crop_h) of aspect w:h inside each frame: centred, around the face, or the largest one that slides to hold it.

    det: face box x, y, w, h and frame size width, height.
    """
    aspect = w / h
    fw, fh = F.col("width"), F.col("height")
    x, y, bw, bh = (F.col(c) for c in ("x", "y", "w", "h"))
    cx, cy = x + _half(bw), y + _half(bh)
    if mode == "face":
        size = F.greatest(bw, bh) * (1 + padding)
        cw, ch = F.least(size * max(aspect, 1.0), fw), F.least(size / min(aspect, 1.0), fh)
        cw, ch = F.when(cw / ch > aspect, ch * aspect).otherwise(cw), F.when(cw / ch > aspect, ch).otherwise(cw / aspect)
        rows = det.withColumns({"crop_w": _whole(cw), "crop_h": _whole(ch)})
        left, top = cx - _half(F.col("crop_w")), cy - _half(F.col("crop_h"))
    else:
        wide = fw / fh > aspect
        rows = det.withColumns({"crop_w": F.when(wide, _whole(fh * aspect)).otherwise(fw), "crop_h": F.when(wide, fh).otherwise(_whole(fw / aspect))})
        left, top = _half(fw - F.col("crop_w")), _half(fh - F.col("crop_h"))
        if mode == "pan":
            slide = lambda at, size, c, b: F.when(c < at + _half(b), c - _half(b)).when(c > at + size - _half(b), c + _half(b) - size).otherwise(at)
            left, top = slide(left, F.col("crop_w"), cx, bw), slide(top, F.col("crop_h"), cy, bh)
    inside = lambda at, room: F.greatest(F.lit(0), F.least(at, room))
    return rows.withColumns({"crop_x": inside(left, fw - F.col("crop_w")).cast("int"), "crop_y": inside(top, fh - F.col("crop_h")).cast("int")})


def fit_resolution(media: DataFrame, w: int, h: int, mode: str = "letterbox") -> DataFrame:
    """Size of each medium in w x h: scaled into it with black margins, or of its own aspect with as many pixels, in steps of 32."""
    fw, fh = F.col("width"), F.col("height")
    if mode == "letterbox":
        scale = F.least(w / fw, h / fh)
        rows = media.withColumns({"new_w": _whole(fw * scale), "new_h": _whole(fh * scale)})
        return rows.withColumns({"pad_x": _half(w - F.col("new_w")), "pad_y": _half(h - F.col("new_h"))})
    tall = _whole(F.sqrt(w * h / (fw / fh)))
    step = lambda x: F.greatest(F.lit(32), (F.bround(x / 32) * 32).cast("int"))
    rows = media.withColumns({"new_w": step(_whole(tall * (fw / fh))), "new_h": step(tall)})
    return rows.withColumns({"pad_x": F.lit(0), "pad_y": F.lit(0)})


def parse_buckets(entries: DataFrame, spec: str) -> DataFrame:
    """Rows (width, height, frames) of a bucket list; if any entry is an image, each video bucket also with one frame."""
    spark = entries.sparkSession
    named = spark.createDataFrame([(spec,)], "spec string").select(F.explode(F.split("spec", ";")).alias("b")).where(F.trim("b") != "")
    part = lambda i: F.get(F.split(F.trim("b"), "x"), F.lit(i)).cast("int")
    given = named.select(part(0).alias("width"), part(1).alias("height"), F.coalesce(part(2), F.lit(1)).alias("frames"))
    image = entries.where(F.lower("path").rlike(r"\.(png|jpg|jpeg)$")).limit(1).select(F.lit(1).alias("_k"))
    still = given.where("frames > 1").withColumns({"frames": F.lit(1), "_k": F.lit(1)}).join(image, "_k").drop("_k")
    return given.unionByName(still).distinct()
