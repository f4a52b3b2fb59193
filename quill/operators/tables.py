"""Tables: widths under spans, headers, and markup from cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import collapse, escape_html


def row_widths(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, row, width. A cell of (row, colspan, rowspan) adds its colspan at its own row and takes it back below the last row it reaches; a row's width is the running sum, so a rowspan costs two numbers whatever its size. Only rows that have cells count."""
    below = F.col("row") + F.greatest("rowspan", F.lit(1))
    steps = F.array(F.struct(F.col("row").cast("long").alias("row"), F.col("colspan").cast("long").alias("step"), F.lit(1).alias("own")), F.struct(below.cast("long").alias("row"), (-F.col("colspan")).cast("long").alias("step"), F.lit(0).alias("own")))
    row_type = cells.schema["row"].dataType
    rows = cells.select(key, F.explode(steps).alias("s")).groupBy(key, F.col("s.row").alias("row")).agg(F.sum("s.step").alias("step"), F.max("s.own").alias("own"))
    upto = Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("width", F.sum("step").over(upto)).filter("own = 1").select(key, F.col("row").cast(row_type).alias("row"), "width")


def table_layout(cells: DataFrame, key: str = "table_id", declared: DataFrame | None = None) -> DataFrame:
    """key, n_rows, widths (in row order) and code: table.ragged for several widths, else table.colgroup_mismatch where declared (key, columns) says another width, else null."""
    rows = row_widths(cells, key).groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct("width").alias("kinds"), F.transform(F.array_sort(F.collect_list(F.struct("row", "width"))), lambda r: r["width"]).alias("widths"))
    columns = F.lit(None).cast("int")
    if declared is not None:
        rows, columns = rows.join(declared, key, "left"), F.col("columns")
    code = F.when(F.col("kinds") > 1, "table.ragged").when((columns > 0) & (columns != F.get("widths", F.lit(0))), "table.colgroup_mismatch")
    return rows.select(key, "n_rows", "widths", code.alias("code"))


def build_tables(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, xml from (row, col, is_header, text): a head only with header rows, each cell's text in a paragraph, null as empty."""
    text = F.concat(F.lit("<para>"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</para>"))
    cell = F.when(F.col("is_header"), F.concat(F.lit("<th>"), text, F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), text, F.lit("</td>")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["xml"]), "")
    rows = cells.select(key, "row", "is_header", F.struct("col", cell.alias("xml")).alias("c")).groupBy(key, "row", "is_header").agg(F.concat(F.lit("<tr>"), joined("c"), F.lit("</tr>")).alias("xml"))
    parts = rows.groupBy(key).agg(joined(F.when(F.col("is_header"), F.struct("row", "xml"))).alias("head"), joined(F.when(~F.col("is_header"), F.struct("row", "xml"))).alias("body"))
    head = F.when(F.col("head") != "", F.concat(F.lit("<thead>"), "head", F.lit("</thead>"))).otherwise("")
    return parts.select(key, F.concat(F.lit('<informaltable frame="box" rules="all">'), head, F.lit("<tbody>"), "body", F.lit("</tbody></informaltable>")).alias("xml"))


def emit_rows(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """key, head, body: arrays of row markup from (row, col, is_header, text, colspan, rowspan), white space collapsed, spans over 1 as attributes. Rows without text go; the first rows that are all header cells are the head if another row follows."""
    said = F.concat(F.lit("<para>"), escape_html(collapse(F.coalesce("text", F.lit("")))), F.lit("</para>"))
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f' {name}="'), name, F.lit('"'))).otherwise("")
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, span("colspan"), span("rowspan"), F.lit(">"), said, F.lit("</"), tag, F.lit(">"))
    rows = cells.withColumn("cell", F.struct("col", cell.alias("xml"))).groupBy(key, "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["xml"]), "").alias("xml"), F.bool_and("is_header").alias("head"), F.max(collapse(F.coalesce("text", F.lit(""))) != "").alias("filled")
    )
    down = Window.partitionBy(key).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.filter("filled").withColumn("head", F.min("head").over(down)).withColumn("bodies", F.count_if(~F.col("head")).over(Window.partitionBy(key)))
    row = F.struct("row", F.concat(F.lit("<tr>"), "xml", F.lit("</tr>")).alias("xml"))
    is_head = F.col("head") & (F.col("bodies") > 0)
    part = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, row))), lambda r: r["xml"])
    return rows.groupBy(key).agg(part(is_head).alias("head"), part(~is_head).alias("body"))


def reliable_header(spans: DataFrame, key: str = "table_id") -> DataFrame:
    """key, has_header: at least two rows, over half of the first row's non-blank spans bold, none of the second's. Bold is the flag alone; a row without spans has no share."""
    share = F.avg(F.when(F.trim("text") != "", (F.col("flags").bitwiseAND(16) != 0).cast("int")))
    rows = spans.groupBy(key, "row").agg(share.alias("bold"))
    at = lambda k: F.max(F.when(F.col("row") == k, F.col("bold")))
    return rows.groupBy(key).agg(F.coalesce((F.count("*") >= 2) & (at(0) > 0.5) & (at(1) == 0), F.lit(False)).alias("has_header"))


def grid_cells(rules: DataFrame, bands: DataFrame, key: str = "img_id", inset: int = 6) -> DataFrame:
    """Cell boxes of each image from its column rules (x) and row bands (top, y0, y1, bottom): rows meet halfway between bands, the outer edges are the table's; boxes keep `inset` from the rules."""
    across = Window.partitionBy(key).orderBy("x")
    cols = rules.withColumns({"next": F.lead("x").over(across), "col": F.row_number().over(across) - 1}).filter("next is not null")
    down = Window.partitionBy(key).orderBy("y0")
    middle = lambda a, b: F.floor((a + b) / 2)
    rows = bands.withColumns({
        "row": F.row_number().over(down) - 1,
        "r0": F.coalesce(middle(F.lag("y1").over(down), F.col("y0")), F.col("top")),
        "r1": F.coalesce(middle(F.col("y1"), F.lead("y0").over(down)), F.col("bottom") + 1),
    })
    left = F.col("x") + inset
    return rows.join(cols, key).select(key, "row", "col", F.col("r0").alias("y0"), F.col("r1").alias("y1"), left.alias("x0"), F.greatest(F.col("next") - inset, left + 1).alias("x1"))
