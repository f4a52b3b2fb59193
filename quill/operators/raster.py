"""Grey images as rows (img_id, y, pixels): ink, profiles, crops and rounded corners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def otsu_threshold(rows: DataFrame) -> DataFrame:
    """img_id, threshold: the grey value that parts an image's histogram with the largest variance between the two sides (the first of equals; 0 where all pixels are equal). Histograms have 256 counts, so the scan is a window over them."""
    from pyspark.sql import Window

    counts = rows.select("img_id", F.explode("pixels").alias("v")).groupBy("img_id", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("img_id")
    total, mass = F.sum("n").over(whole), F.sum(F.col("n") * F.col("v")).over(whole)
    w0, m0 = F.sum("n").over(upto), F.sum(F.col("n") * F.col("v")).over(upto)
    side = counts.select("img_id", "v", total.alias("t"), mass.alias("m"), w0.alias("w0"), m0.alias("m0"))
    w1 = F.col("t") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - F.when(w1 > 0, (F.col("m") - F.col("m0")) / w1)
    spread = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    best = F.max(F.struct(spread.alias("s"), (-F.col("v")).alias("v")))
    return side.groupBy("img_id").agg(F.when(best["s"] > 0, -best["v"]).otherwise(0).alias("threshold"))


def row_ink(rows: DataFrame) -> DataFrame:
    """img_id, y, ink: how many pixels of each row are at or below the image's threshold."""
    both = rows.join(otsu_threshold(rows), "img_id")
    return both.select("img_id", "y", F.size(F.filter("pixels", lambda v: v <= F.col("threshold"))).alias("ink"))


def crop(rows: DataFrame, x0: int, y0: int, width: int, height: int, radius: int = 0, white: int = 255) -> DataFrame:
    """The rectangle of each image, with corners beyond `radius` white; images that are too small are left out."""
    sizes = rows.groupBy("img_id").agg(F.max("y").alias("bottom"), F.min(F.size("pixels")).alias("right"))
    fits = rows.join(sizes.filter((F.col("bottom") + 1 >= y0 + height) & (F.col("right") >= x0 + width)).select("img_id"), "img_id")
    cut = fits.filter(F.col("y").between(y0, y0 + height - 1)).select("img_id", (F.col("y") - y0).alias("y"), F.slice("pixels", x0 + 1, width).alias("pixels"))
    if not radius:
        return cut
    dy = F.greatest(radius - F.col("y"), F.col("y") - (height - 1 - radius), F.lit(0))
    dx = lambda x: F.greatest(radius - x, x - (width - 1 - radius), F.lit(0))
    outside = lambda x: (dy > 0) & (dx(x) > 0) & (dx(x) * dx(x) + dy * dy > radius * radius)
    return cut.withColumn("pixels", F.transform("pixels", lambda v, x: F.when(outside(x), F.lit(white)).otherwise(v)))


def erase(rows: DataFrame, boxes: DataFrame, white: int = 255) -> DataFrame:
    """Images with the pixels of their boxes (img_id, x0, y0, x1, y1, ends exclusive) white."""
    mine = rows.select("img_id", "y").join(boxes, "img_id").filter((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    spans = mine.groupBy("img_id", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("spans"))
    hit = lambda x: F.exists(F.coalesce("spans", F.array().cast("array<struct<x0:int,x1:int>>")), lambda s: (x >= s["x0"]) & (x < s["x1"]))
    return rows.join(spans, ["img_id", "y"], "left").select("img_id", "y", F.transform("pixels", lambda v, x: F.when(hit(x), F.lit(white)).otherwise(v)).alias("pixels"))


def masked_ink(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """img_id, y, ink: how many pixels at or below the image's threshold are also in the mask (img_id, y, on: array<boolean>)."""
    both = rows.join(otsu_threshold(rows), "img_id").join(mask, ["img_id", "y"])
    hits = F.zip_with("pixels", "on", lambda v, on: F.coalesce(on, F.lit(False)) & (v <= F.col("threshold")))
    return both.select("img_id", "y", F.size(F.filter(hits, lambda h: F.coalesce(h, F.lit(False)))).alias("ink"))


def size_problem(width: Column, height: Column, least_width: int, least_height: int) -> Column:
    """Null for an image that is large enough, else how large it must be."""
    return F.when((width < least_width) | (height < least_height), F.concat(F.lit(f"at least {least_width} x {least_height} pixels, not "), width, F.lit(" x "), height))
