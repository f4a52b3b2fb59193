"""Page layouts as tables: spans and images from nested page documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page as a layout tool writes it: blocks of lines of spans, and images; boxes are x0, y0, x1, y1 in points.
PAGE = """doc_id bigint, page int, width double, height double,
blocks array<struct<lines: array<struct<bbox: array<double>, dir: array<double>, spans: array<struct<bbox: array<double>, text: string, font: string, flags: int>>>>>>,
images array<struct<xref: int, bbox: array<double>, transform: array<double>, smask: int, width: int, height: int>>"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page documents of JSON lines; a record that is none gives no row."""
    return spark.read.schema(PAGE).json(path).filter("doc_id is not null")


def _box(box: str, prefix: str = "") -> list:
    return [F.get(box, F.lit(i)).alias(f"{prefix}{n}") for i, n in enumerate(("x0", "y0", "x1", "y1"))]


def layout_spans(pages: DataFrame) -> DataFrame:
    """doc_id, page, block, line, span (numbers from 0; lines count through a page), the line's box and direction, and the span's text, font and flags. Pages are exploded once; blocks without lines (images) give no rows."""
    sizes = F.transform("blocks", lambda b: F.coalesce(F.size(b["lines"]), F.lit(0)))
    blocks = pages.select("doc_id", "page", sizes.alias("sizes"), F.posexplode("blocks").alias("block", "b"))
    passed = F.aggregate(F.slice("sizes", F.lit(1), F.col("block")), F.lit(0), lambda a, x: a + x)
    placed = blocks.select("doc_id", "page", "block", passed.alias("passed"), F.posexplode("b.lines").alias("i", "l"))
    spans = placed.select("doc_id", "page", "block", (F.col("passed") + F.col("i")).alias("line"), *_box("l.bbox"), F.get("l.dir", F.lit(0)).alias("dir_x"), F.get("l.dir", F.lit(1)).alias("dir_y"), F.posexplode("l.spans").alias("span", "s"))
    return spans.select("doc_id", "page", "block", "line", "span", "x0", "y0", "x1", "y1", "dir_x", "dir_y", "s.text", "s.font", "s.flags")


def page_images(pages: DataFrame) -> DataFrame:
    """doc_id, page, xref, the image's box in points (ix0 and so on), skew (what its transform turns or mirrors it by, 0 for an upright image), masked, and its size in pixels."""
    rows = pages.select("doc_id", "page", F.explode("images").alias("i"))
    part = lambda k: F.get("i.transform", F.lit(k))
    skew = F.abs(part(1)) + F.abs(part(2)) + F.when((part(0) <= 0) | (part(3) <= 0), 1.0).otherwise(0.0)
    return rows.select("doc_id", "page", F.col("i.xref").alias("xref"), *_box("i.bbox", "i"), skew.alias("skew"), (F.col("i.smask") > 0).alias("masked"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
