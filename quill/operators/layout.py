"""Page layout: lines in regions, paragraphs, list items and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import MARKER, ORDINAL, SENTENCE_END, escape_html, join_lines, strip


def in_region(lines: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Lines whose centre is in the half-open rectangle, which are not blank and not slanted (upright and level text has a direction along an axis)."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1)
    return lines.filter(inside & (F.abs(F.col("dir_x") * F.col("dir_y")) <= 0.01) & (strip(F.col("text")) != ""))


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | F.lower(font).contains("bold")


def is_italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) | F.lower(font).rlike("italic|oblique")


def assign_paragraphs(lines: DataFrame, id_column: str = "doc_id", fraction: float = 0.5) -> DataFrame:
    """Lines with `para` (from 1). A gap over `fraction` of the upper median of line heights always splits; a new block splits unless the text reads as wrapped (no sentence end before, lower case after)."""
    heights = lines.groupBy(id_column).agg(F.sort_array(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"))
    median = heights.select(id_column, F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")).alias("median"))
    own = Window.partitionBy(id_column).orderBy("y0", "y1", "block", "line")
    rows = lines.join(median, id_column).withColumns({"py": F.lag("y1").over(own), "pb": F.lag("block").over(own), "pt": F.lag("text").over(own)})
    big = (F.col("y0") - F.col("py")) > F.col("median") * fraction
    wrap = ~strip(F.col("pt")).rlike(SENTENCE_END) & strip(F.col("text")).rlike(r"\A\p{Ll}")
    splits = F.col("py").isNotNull() & (big | ((F.col("block") != F.col("pb")) & ~wrap))
    return rows.withColumn("para", F.sum(splits.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("median", "py", "pb", "pt")


def paragraphs(lines: DataFrame, id_column: str = "doc_id", fraction: float = 0.5) -> DataFrame:
    """Lines grouped to paragraphs: id, para (from 1), n_lines, text."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "y1", "block", "line", strip(F.col("text")).alias("text"))))
    grouped = assign_paragraphs(lines, id_column, fraction).groupBy(id_column, "para").agg(F.count("*").alias("n_lines"), F.transform(ordered, lambda r: r["text"]).alias("texts"))
    return grouped.select(id_column, "para", "n_lines", join_lines(F.col("texts")).alias("text"))


def assign_items(lines: DataFrame, id_column: str = "doc_id", order: str = "line") -> DataFrame:
    """Lines with `group` (the number of markers so far), `mark` (begins an item) and `ordered` (the list's, by its first marker). Lines before the first marker are dropped."""
    own = Window.partitionBy(id_column).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    text = strip(F.col("text"))
    marks = text.rlike(rf"(?U)\A\s*{MARKER}\s*\z") | text.rlike(rf"(?U)\A\s*{MARKER}\s+")
    rows = lines.withColumn("mark", marks).withColumn("group", F.sum(F.col("mark").cast("int")).over(own)).filter("group > 0")
    return rows.withColumn("ordered", F.first(F.when(F.col("mark"), text.rlike(rf"(?U)\A\s*{ORDINAL}")), True).over(own))


def list_items(lines: DataFrame, id_column: str = "doc_id", order: str = "line") -> DataFrame:
    """Lines grouped to list items: id, item (from 1), ordered, text. A marker starts an item, a marker with nothing after it is no item."""
    text = strip(F.col("text"))
    rows = assign_items(lines, id_column, order)
    content = F.when(text.rlike(rf"(?U)\A\s*{MARKER}\s*\z"), F.lit(None)).when(F.col("mark"), F.regexp_replace(text, rf"(?U)\A\s*{MARKER}\s*", "")).otherwise(text)
    parts = F.array_sort(F.collect_list(F.when(content.isNotNull(), F.struct(F.col(order).alias("o"), content.alias("t")))))
    items = rows.groupBy(id_column, "group").agg(F.first("ordered").alias("ordered"), F.transform(parts, lambda p: p["t"]).alias("texts")).filter(F.size("texts") > 0)
    return items.select(id_column, F.row_number().over(Window.partitionBy(id_column).orderBy("group")).alias("item"), "ordered", join_lines(F.col("texts")).alias("text"))


def lines_in_cells(lines: DataFrame, cells: DataFrame, id_column: str, band: float, outside: bool = False) -> DataFrame:
    """Lines joined to the cells (same id) that hold their centre. Cells are cut into bands of height `band`, so the join is on equal (id, band) and the rest is a filter. A cell of more than eight bands goes to a coarser level, of bands twice as high until eight hold it, and lines look at each level that there is: a cell makes nine rows at most, and there are as many levels as the tallest cell has doublings. outside: whether lines that no cell (of the first level) holds come as well, without a cell; so all of them come, and of regions without cells each once."""
    height = F.greatest(F.col("cy1") - F.col("cy0"), F.lit(0.0))
    level = F.greatest(F.ceil(F.log2(height / (8 * band))), F.lit(0)).cast("int")
    size = lambda level: F.lit(band) * F.pow(F.lit(2.0), level)
    leveled = cells.withColumn("level", F.coalesce(level, F.lit(0)))
    cut = leveled.withColumn("band", F.explode(F.sequence(F.floor(F.col("cy0") / size(F.col("level"))), F.floor(F.col("cy1") / size(F.col("level"))))))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    present = [r["level"] for r in leveled.select("level").distinct().collect()]  # one for each doubling
    looked = lines.withColumn("level", F.explode(F.array(*map(F.lit, present or [0])).cast("array<int>"))).withColumn("band", F.floor(cy / size(F.col("level"))))
    keys = [id_column, "level", "band"]
    if not outside:
        found = looked.join(cut.hint("merge"), keys)  # cells grow with the input, so they are never broadcast
        return found.filter((cx >= F.col("cx0")) & (cx < F.col("cx1")) & (cy >= F.col("cy0")) & (cy < F.col("cy1"))).drop("band", "level")
    looked = looked.withColumns({"cx": cx, "cy": cy})
    boxes = cut.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in cut.columns if c not in keys])
    inside = (F.col("cx") >= F.col("cx0")) & (F.col("cx") < F.col("cx1")) & (F.col("cy") >= F.col("cy0")) & (F.col("cy") < F.col("cy1"))
    for k in keys:
        inside = inside & (F.col(k) == F.col(f"_{k}"))
    found = looked.join(boxes.hint("merge"), inside, "left").filter(F.col(f"_{id_column}").isNotNull() | (F.col("level") == (present or [0])[0]))
    return found.drop("band", "level", "cx", "cy", *[f"_{k}" for k in keys])


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """0 for an empty rectangle."""
    zero = F.lit(0.0)
    return F.greatest(zero, x1 - x0) * F.greatest(zero, y1 - y0)


def best_overlap(clips: DataFrame, images: DataFrame, key: str, least_sum: float = 0.9, least_clip: float = 0.25, tile: float = 64.0) -> DataFrame:
    """For each clip the image of its key that overlaps it most (the first by image_id of equals), if it has least_sum of all overlap and covers least_clip of the clip. Rectangles that are the same meet once: pairs are made of the different ones, images counted, and each clip takes the result of its rectangle. Both sides are cut into square tiles, so rectangles meet by (key, tile); a pair counts in the tile of its overlap's top left corner alone. Pairs grow with the rectangles of a key that overlap, as each of these counts in the sum."""
    clip_box, image_box = [key, "x0", "y0", "x1", "y1"], [key, "ix0", "iy0", "ix1", "iy1"]

    def tiled(rows: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        place = lambda c: F.floor(F.col(c) / tile)
        full = rows.filter((F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0)))
        return full.withColumn("tx", F.explode(F.sequence(place(x0), place(x1)))).withColumn("ty", F.explode(F.sequence(place(y0), place(y1))))

    left, top = F.greatest("x0", "ix0"), F.greatest("y0", "iy0")
    boxes = clips.select(*clip_box).distinct()
    pictures = images.groupBy(*image_box).agg(F.min("image_id").alias("image_id"), F.count("*").alias("copies"))
    met = tiled(boxes, "x0", "y0", "x1", "y1").join(tiled(pictures, "ix0", "iy0", "ix1", "iy1"), [key, "tx", "ty"])
    met = met.filter((F.floor(left / tile) == F.col("tx")) & (F.floor(top / tile) == F.col("ty")))
    met = met.withColumn("overlap", area(left, top, F.least("x1", "ix1"), F.least("y1", "iy1"))).filter("overlap > 0")
    best = met.groupBy(*clip_box).agg(F.sum(F.col("overlap") * F.col("copies")).alias("total"), F.max(F.struct(F.col("overlap").alias("o"), (-F.col("image_id")).alias("i"))).alias("best"))
    good = (F.col("best.o") >= least_sum * F.col("total")) & (F.col("best.o") >= least_clip * area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return clips.join(best.filter(good), clip_box).select("clip_id", (-F.col("best.i")).alias("image_id"), F.col("best.o").alias("overlap"))


def crop_box(x0: Column, y0: Column, x1: Column, y1: Column, image: dict[str, Column], width: Column, height: Column) -> Column:
    """A region in points as a box of an embedded image's pixels: struct (x0, y0, x1, y1), null for an image that is turned, mirrored or masked, or where nothing is left. `image`: its box in points (x0, y0, x1, y1), the off-diagonal of its transform (skew) and whether it has a soft mask (masked). Starts are cut, ends rounded to whole pixels."""
    per_x, per_y = width / (image["x1"] - image["x0"]), height / (image["y1"] - image["y0"])
    left, top = F.floor((F.greatest(x0, image["x0"]) - image["x0"]) * per_x), F.floor((F.greatest(y0, image["y0"]) - image["y0"]) * per_y)
    right, bottom = F.floor((F.least(x1, image["x1"]) - image["x0"]) * per_x + 0.5), F.floor((F.least(y1, image["y1"]) - image["y0"]) * per_y + 0.5)
    fine = (image["skew"] == 0) & ~image["masked"] & (per_x > 0) & (per_y > 0) & (right > left) & (bottom > top)
    return F.when(fine, F.struct(left.cast("int").alias("x0"), top.cast("int").alias("y0"), right.cast("int").alias("x1"), bottom.cast("int").alias("y1")))


def page_counts(layout: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, n_pages of a layout (id, page)."""
    return layout.groupBy(id_column).agg(F.count_distinct("page").alias("n_pages"))


def clamp_zoom(width: Column, height: Column, zoom: Column, max_megapixels: float | None) -> Column:
    """The zoom, or what keeps a raster within the ceiling."""
    if not max_megapixels:
        return zoom
    pixels, most = width * height * zoom * zoom, F.lit(max_megapixels * 1e6)
    return F.when(pixels > most, zoom * F.sqrt(most / pixels)).otherwise(zoom)


def styled_runs(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, run, text, bold, italic, xml: neighbouring spans of one style as one run, and its markup. White space at a styled run's ends stays outside its tags, bold wins over italic, blank runs are plain."""
    own = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.col("bold") != F.lag("bold").over(own)) | (F.col("italic") != F.lag("italic").over(own)), F.lit(True))
    rows = spans.filter("text <> ''").withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "")
    runs = rows.groupBy(*keys, "run").agg(in_order.alias("text"), F.first("bold").alias("bold"), F.first("italic").alias("italic"))
    text, core = F.col("text"), strip(F.col("text"))
    opener = F.when(F.col("bold"), '<emphasis role="strong">').otherwise("<emphasis>")
    lead, trail = F.regexp_extract(text, r"(?U)\A\s*", 0), F.regexp_extract(text, r"(?U)\s*\z", 0)
    styled = F.concat(lead, opener, escape_html(core), F.lit("</emphasis>"), trail)
    return runs.withColumn("xml", F.when((F.col("bold") | F.col("italic")) & (core != ""), styled).otherwise(escape_html(text)))


def styled_paragraphs(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, xml: spans (text, bold, italic) of one paragraph as mixed content, trimmed at both ends."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "xml"))), lambda x: x["xml"]), "")
    return styled_runs(spans, keys, order).groupBy(*keys).agg(F.concat(F.lit("<para>"), strip(whole), F.lit("</para>")).alias("xml"))
