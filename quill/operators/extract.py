"""Regions of page layouts as fragments: paragraphs and lists put together from styled spans, with their markup and a preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import MARKER, escape_html, flag_page_refs, has_text, join_lines, strip
from quill.operators.layout import assign_items, assign_paragraphs, best_overlap, crop_box, lines_in_cells, styled_runs
from quill.operators.lineage import cut, met_by_text
from quill.operators.tables import build_tables


def peel_marker(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Spans without the list marker that the first one of each key begins with; only that span is looked at."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    rows = spans.withColumn("first", first)
    return rows.withColumn("text", F.when(F.col("first"), F.regexp_replace("text", rf"(?U)\A\s*{MARKER}\s*", "")).otherwise(F.col("text"))).drop("first")


def line_tokens(spans: DataFrame, keys: list[str], line: str = "line", order: str = "span") -> DataFrame:
    """keys, place, text, bold, italic: the spans of a paragraph's lines as one run of tokens. Between lines stands a space, in the style that both sides share or else plain; none after white space, and none where a hyphen between lower-case letters goes."""
    own = Window.partitionBy(*keys).orderBy(line, order)
    ahead = lambda c: F.lead(c).over(own)
    rows = spans.filter("text <> ''").withColumns({"n_line": ahead(line), "n_text": ahead("text"), "n_bold": ahead("bold"), "n_italic": ahead("italic")})
    seam = F.coalesce(F.col("n_line") != F.col(line), F.lit(False))
    wraps = seam & F.col("text").rlike(r"[a-z]-\z") & F.col("n_text").rlike(r"\A\p{Ll}")
    text = F.when(wraps, F.substring(F.col("text"), F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    alike = (F.col("bold") == F.col("n_bold")) & (F.col("italic") == F.col("n_italic"))
    token = F.struct(text.alias("text"), "bold", "italic")
    space = F.struct(F.lit(" ").alias("text"), (alike & F.col("bold")).alias("bold"), (alike & F.col("italic")).alias("italic"))
    tokens = F.array_compact(F.array(token, F.when(seam & ~wraps & ~F.col("text").rlike(r"(?U)\s\z"), space)))
    placed = rows.select(*keys, F.col(line).alias("a"), F.col(order).alias("b"), F.posexplode(tokens).alias("c", "t"))
    return placed.select(*keys, F.struct("a", "b", "c").alias("place"), "t.*")


def _html(runs: DataFrame, keys: list[str]) -> Column:
    """A paragraph's preview from its runs: strong and em, page references flagged within a run."""
    core = strip(F.col("text"))
    tag = F.when(F.col("bold"), "strong").otherwise("em")
    lead, trail = F.regexp_extract("text", r"(?U)\A\s*", 0), F.regexp_extract("text", r"(?U)\s*\z", 0)
    flagged = flag_page_refs(escape_html(core))
    styled = F.concat(lead, F.lit("<"), tag, F.lit(">"), flagged, F.lit("</"), tag, F.lit(">"), trail)
    return F.when((F.col("bold") | F.col("italic")) & (core != ""), styled).otherwise(flag_page_refs(escape_html(F.col("text"))))


def _fragments(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, xml, html of tokens (place, text, bold, italic)."""
    runs = styled_runs(tokens, keys, "place")
    in_order = lambda c: strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", c.alias("t")))), lambda x: x["t"]), ""))
    return runs.withColumn("html", _html(runs, keys)).groupBy(*keys).agg(F.concat(F.lit("<para>"), in_order(F.col("xml")), F.lit("</para>")).alias("xml"), in_order(F.col("html")).alias("html"))


def _lines(spans: DataFrame, id_column: str) -> DataFrame:
    """The lines of spans, with their whole text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "")
    return spans.groupBy(id_column, "line", "block", "y0", "y1").agg(text.alias("text")).filter(has_text(F.col("text")))


def extract_paragraphs(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, item, xml, html: the paragraphs of a region's spans (line, block, span, y0, y1, text, bold, italic)."""
    placed = assign_paragraphs(_lines(spans, id_column), id_column).select(id_column, "line", F.col("para").alias("item"))
    return _fragments(line_tokens(spans.join(placed, [id_column, "line"]), [id_column, "item"]), [id_column, "item"])


def extract_lists(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, item, ordered, xml, html: the list items of a region's spans, without their markers, each as a listitem; the first marker says whether the list is ordered."""
    placed = assign_items(_lines(spans, id_column), id_column).select(id_column, "line", F.col("group").alias("item"), "ordered")
    rows = peel_marker(spans.join(placed, [id_column, "line"]), [id_column, "item"], ["line", "span"])
    tokens = line_tokens(rows, [id_column, "item", "ordered"])
    made = _fragments(tokens, [id_column, "item", "ordered"]).filter("xml <> '<para></para>'")
    number = F.row_number().over(Window.partitionBy(id_column).orderBy("item"))
    return made.select(id_column, number.alias("item"), "ordered", F.concat(F.lit("<listitem>"), "xml", F.lit("</listitem>")).alias("xml"), "html")


def extract_tables(spans: DataFrame, regions: DataFrame, cells: DataFrame | None = None, id_column: str = "doc_id", band: float = 64.0, parts: int | None = None) -> DataFrame:
    """id, xml of each of regions (id): its grid's cells (id, row, col, cx0, cy0, cx1, cy1) with the lines of spans whose centre they hold, joined as in a paragraph, and a head where the first row is bold and the second is not. A region without cells is one cell with all its lines. parts: to how many parts spans, regions and cells are dealt by id, where they are; lines then meet cells without a shuffle and are written once, as they lie, with the cells."""
    said = F.trim("text") != ""
    lines = spans.groupBy(id_column, "line", "y0", "y1").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "").alias("text"),
        F.count_if(said).alias("said"), F.count_if(said & F.col("bold")).alias("bold"),
    ).filter(has_text(F.col("text")))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    place, content = [null("row", "long"), null("col", "long")], [null("line", "long"), null("text", "string"), null("said", "long"), null("bold", "long")]
    told = ["line", "text", "said", "bold"]
    if cells is None:
        rows = lines.select(id_column, *place, *told)
    else:  # lines that no cell holds come once, without a cell
        rows = lines_in_cells(lines, cells, id_column, band, outside=True).select(id_column, "row", "col", *told)
        rows = rows.unionByName(cells.select(id_column, "row", "col", *content))
    rows = rows.withColumn("asked", F.lit(False)).unionByName(regions.select(id_column, *place, *content).withColumn("asked", F.lit(True)))
    if parts:  # what follows deals a union anew, unless it is written as it lies
        with met_by_text(rows.sparkSession):
            rows = cut(rows, id_column, parts)
    # Cells and lines come together by union and window, as joins of them may be broadcast through the driver.
    region = Window.partitionBy(id_column)
    rows = rows.withColumns({"known": F.max("asked").over(region), "gridded": F.max(F.col("row").isNotNull()).over(region)}).filter("known and (row is not null or not gridded)")
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "text")))), lambda x: x["text"])
    made = rows.groupBy(id_column, "gridded", F.coalesce("row", F.lit(0)).alias("row"), F.coalesce("col", F.lit(0)).alias("col")).agg(join_lines(texts).alias("text"), F.sum("said").alias("said"), F.sum("bold").alias("bold"))
    of = lambda k: F.sum(F.when(F.col("row") == k, F.col("bold"))).over(region) / F.nullif(F.sum(F.when(F.col("row") == k, F.col("said"))).over(region), F.lit(0))
    filled = F.when(F.col("said").isNotNull(), F.col("row"))
    several = F.min(filled).over(region) < F.max(filled).over(region)
    made = made.withColumn("head", F.col("gridded") & several & (of(0) > 0.5) & (of(1) == 0))
    return build_tables(made.select(id_column, "row", "col", (F.coalesce("head", F.lit(False)) & (F.col("row") == 0)).alias("is_header"), "text"), id_column)


def extract_images(requests: DataFrame, images: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, image_id, box for the image regions of requests (id, kind, x0, y0, x1, y1): the embedded image (id, image_id, ix0, iy0, ix1, iy1, skew, masked, width, height) that lies in most of it, and the region as a box of its pixels. A region over several images, or over none that can be cut, has no row."""
    clips = requests.filter("kind = 'image'").select(id_column, F.col(id_column).alias("clip_id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    best = best_overlap(clips, images, id_column).select(F.col("clip_id").alias(id_column), "image_id")
    met = best.join(images, [id_column, "image_id"]).join(clips, id_column)
    image = {"x0": F.col("ix0"), "y0": F.col("iy0"), "x1": F.col("ix1"), "y1": F.col("iy1"), "skew": F.col("skew"), "masked": F.col("masked")}
    box = crop_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], image, F.col("width"), F.col("height"))
    return met.select(id_column, "image_id", box.alias("box")).filter("box is not null")


def extract_regions(requests: DataFrame, spans: DataFrame, images: DataFrame | None = None, id_column: str = "doc_id", cells: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """id, kind, xml, n_items, needs_reading for requests (id, kind, x0, y0, x1, y1), one for each id: paragraphs, a list or a table (by the grid's cells, see extract_tables) of the spans whose line's centre is in the region; a table region without text whose id is among `images` (id) needs reading and has no fragment. parts: to how many parts requests, spans and cells are dealt by id, where they are."""
    region = requests.select(id_column, "kind", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    level = F.abs(F.col("dir_x") * F.col("dir_y")) <= 0.01
    inside = spans.join(region.hint("merge"), id_column).filter((cx >= F.col("r_x0")) & (cx < F.col("r_x1")) & (cy >= F.col("r_y0")) & (cy < F.col("r_y1")) & level)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("item", "xml"))), lambda x: x["xml"])
    paragraphs = extract_paragraphs(inside.filter("kind = 'paragraph'"), id_column).groupBy(id_column).agg(whole.alias("items"))
    lists = extract_lists(inside.filter("kind = 'list'"), id_column).groupBy(id_column).agg(whole.alias("l_items"), F.first("ordered").alias("ordered"))
    drawn = inside.filter("kind = 'table'").filter(has_text(F.col("text"))).select(id_column, F.lit(True).alias("has_text"))
    tables = extract_tables(inside.filter("kind = 'table'"), requests.filter("kind = 'table'"), cells, id_column, parts=parts).withColumnRenamed("xml", "table")
    rows = region.groupBy(id_column).agg(F.first("kind", True).alias("kind")).filter("kind is not null")
    # What is known of a request comes by merging joins, as others may be broadcast through the driver; parts that lie by id are not dealt again.
    for part in (paragraphs, lists, tables, drawn.distinct()):
        rows = rows.join(part.hint("merge"), id_column, "left")
    if images is not None:
        rows = rows.join(images.select(id_column, F.lit(True).alias("has_image")).distinct().hint("merge"), id_column, "left")
    else:
        rows = rows.withColumn("has_image", F.lit(False))
    rows = rows.withColumn("items", F.coalesce("items", "l_items"))
    tag = F.when(F.col("ordered"), "orderedlist").otherwise("itemizedlist")
    body = F.array_join("items", "\n")
    xml = F.when(F.col("kind") == "list", F.concat(F.lit("<"), tag, F.lit(">\n"), body, F.lit("\n</"), tag, F.lit(">"))).when(F.col("kind") == "table", F.col("table")).otherwise(body)
    needs = (F.col("kind") == "table") & F.col("has_text").isNull() & F.coalesce("has_image", F.lit(False))
    return rows.select(id_column, "kind", F.when(~needs, xml).alias("xml"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), needs.alias("needs_reading"))
