"""Review of tables read twice: column profiles, flags, repairs and edits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import case_suspect, comma_repair, compared, shape

_DIGITS = r"\A[0-9]+\z"


def body_and_header(cells: DataFrame, key: str = "img_id") -> DataFrame:
    """cells with has_header (two rows or more, and no filled cell of row 0 is all digits, blanks, commas, points or dashes) and body_row, the row below the header (-1 on it)."""
    whole = Window.partitionBy(key)
    numeric = F.max(F.when((F.col("row") == 0) & (F.coalesce("text", F.lit("")) != ""), F.col("text").rlike(r"(?U)\A[\d\s.,-]+\z").cast("int"))).over(whole)
    heads = (F.min("row").over(whole) < F.max("row").over(whole)) & (F.coalesce(numeric, F.lit(0)) == 0)
    rows = cells.filter(F.col(key).isNotNull()).withColumn("has_header", F.coalesce(heads, F.lit(False)))
    return rows.withColumn("body_row", F.col("row") - F.col("has_header").cast("int"))


def _with_profile(body: DataFrame, key: str) -> DataFrame:
    """The body's cells, each with its column's profile, see column_profile(). Windows over (key, col) alone, so that nothing is joined: a join of profiles may be broadcast through the driver."""
    filled = F.coalesce("text", F.lit("")) != ""
    rows = body.withColumns({"filled": filled, "is_int": filled & F.col("text").rlike(_DIGITS), "shape": F.when(filled, shape(F.col("text")))})
    column = Window.partitionBy(key, "col")
    before = column.orderBy("body_row").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col("text").try_cast("decimal(38,0)")
    of_shape = Window.partitionBy(key, "col", "shape")
    rows = rows.withColumn("previous", F.last(F.when(F.col("is_int"), value), True).over(before))
    rows = rows.withColumns({"k": F.count_if("filled").over(of_shape), "first": F.min(F.when(F.col("filled"), F.col("body_row"))).over(of_shape)})
    rows = rows.withColumns({
        "n": F.count_if("filled").over(column), "n_int": F.count_if("is_int").over(column), "ups": F.count_if(F.col("is_int") & (value - F.col("previous") == 1)).over(column),
        "top": F.max(F.when(F.col("filled"), F.struct("k", (-F.col("first")).alias("f"), "shape"))).over(column),
    })
    rows = rows.withColumn("numeric", F.col("n_int") / F.nullif(F.col("n"), F.lit(0)) >= 0.8)
    counting = F.col("numeric") & (F.col("n_int") >= 3) & (F.col("ups") >= (F.col("n_int") - 1) * 0.7)
    patterned = ~F.col("numeric") & (F.col("n") >= 3) & (F.col("top.k") / F.nullif(F.col("n"), F.lit(0)) >= 0.7) & (F.length("top.shape") >= 4)
    return rows.withColumns({"counting": counting, "common": F.col("top.shape"), "patterned": patterned})


def column_profile(body: DataFrame, key: str = "img_id") -> DataFrame:
    """Per (key, col) of the body's filled cells: n, n_int, numeric (0.8 integers), counting (0.7 of the integers' steps are 1), common shape (the most frequent, the first of equals) and patterned (not numeric, 3 cells, 0.7 of one shape of 4 characters)."""
    columns = ["n", "n_int", "numeric", "counting", "common", "patterned"]
    rows = _with_profile(body, key).filter("filled").groupBy(key, "col").agg(*[F.first(c).alias(c) for c in columns])
    return rows.select(key, "col", *columns)


def review(cells: DataFrame, key: str = "img_id", least_confidence: float = 0.9, grid: bool = True) -> DataFrame:
    """The body's cells with `why` (reasons in a fixed order), `fixed` and the repaired `text`. A null text is a missing cell: counted as empty and never flagged."""
    rows = _with_profile(body_and_header(cells, key).filter("body_row >= 0"), key)
    v = F.coalesce("text", F.lit(""))
    is_int, value = v.rlike(_DIGITS), v.try_cast("decimal(38,0)")
    yes = lambda c: F.coalesce(c, F.lit(False))
    numeric, patterned = yes(F.col("numeric")), yes(F.col("patterned"))
    free = ~numeric & ~patterned
    reasons = [
        (F.lit(not grid), F.lit("no grid")),
        (~F.col("agree"), F.lit("readings differ")),
        (F.col("agree") & (F.col("conf") < least_confidence), F.concat(F.lit("low confidence "), F.format_number("conf", 2))),
        (numeric & ~is_int, F.lit("not a number")),
        (yes(F.col("counting")) & is_int & (value != F.col("previous") + 1), F.concat(F.lit("sequence "), F.col("previous").cast("string"), F.lit(" to "), v)),
        (patterned & (shape(v) != F.col("common")), F.lit("off the column's pattern")),
        (free & case_suspect(v), F.lit("letter case")),
    ]
    why = F.array_compact(F.array(*[F.when(yes(when), what) for when, what in reasons]))
    repaired = free & (comma_repair(v) != v) & F.col("text").isNotNull()
    why = F.when(F.col("text").isNotNull(), why).otherwise(F.array().cast("array<string>"))
    return rows.select(key, "body_row", "col", F.when(repaired, comma_repair(v)).otherwise(v).alias("text"), why.alias("why"), repaired.alias("fixed"))


def merge_readings(a: DataFrame, b: DataFrame, key: str = "img_id") -> DataFrame:
    """Two readings of each cell: the first's text, the other as alt, whether they agree in their compared form, and the lower confidence."""
    left = a.select(key, "row", "col", "text", "conf")
    right = b.select(key, "row", "col", F.col("text").alias("alt"), F.col("conf").alias("conf_b"))
    return left.join(right, [key, "row", "col"]).select(key, "row", "col", "text", "alt", (compared(F.col("text")) == compared(F.col("alt"))).alias("agree"), F.least("conf", "conf_b").alias("conf"))


def apply_edits(reviewed: DataFrame, edits: DataFrame, key: str = "img_id", most_chars: int = 2000) -> DataFrame:
    """Edits (key, body_row, col, new_text) put into the body of each table where every flagged cell has one of at most most_chars; other tables keep their text. `accepted` says which."""
    rows = reviewed.join(edits.hint("merge"), [key, "body_row", "col"], "left")  # edits grow with the tables, so they are never broadcast
    fine = F.coalesce(F.length("new_text") <= most_chars, F.lit(False))
    ok = F.bool_and(fine | ((F.size("why") == 0) & F.col("new_text").isNull())).over(Window.partitionBy(key))
    rows = rows.filter(F.col(key).isNotNull()).withColumn("accepted", F.coalesce(ok, F.lit(False)))
    text = F.when(F.col("accepted") & F.col("new_text").isNotNull(), F.trim(F.regexp_replace("new_text", r"(?U)\s+", " "))).otherwise(F.col("text"))
    return rows.select(key, "body_row", "col", text.alias("text"), "accepted")


def snap_headers(headers: DataFrame, known: list[str], cutoff: float = 0.6) -> DataFrame:
    """headers (text) with `snapped`: the known header most like the compared form, from a likeness of `cutoff` on, else the text. Each distinct text is compared once."""
    @F.pandas_udf("string")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next(iter(difflib.get_close_matches(t, known, n=1, cutoff=cutoff)), None) if t is not None else None)

    distinct = headers.select("text").distinct().withColumn("near", best(compared(F.col("text"))))
    return headers.join(distinct, "text", "left").withColumn("snapped", F.coalesce("near", "text")).drop("near")


def review_header(cells: DataFrame, known: list[str], key: str = "img_id", cutoff: float = 0.6) -> DataFrame:
    """key, col, text: the header cells of tables that have a header, each as the known header that it is most like."""
    header = body_and_header(cells, key).filter("body_row < 0")
    return snap_headers(header.select(key, "col", F.coalesce("text", F.lit("")).alias("text")), known, cutoff).select(key, "col", F.col("snapped").alias("text"))
