"""Requests for regions of pages: parsing, checks, results and their state, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import TAG
from quill.operators.state import merge_continuations
from quill.operators.structure import nested
from quill.operators.tags import tag_stream

KINDS = ["paragraph", "list", "table", "image"]
PREVIEW_SCALE = 1.5


def points(pixels: Column, scale: float = PREVIEW_SCALE) -> Column:
    """A preview coordinate in points; null where it is no number."""
    return pixels.cast("string").try_cast("double") / scale


def region_problem(x0: Column, y0: Column, x1: Column, y1: Column, kind: Column, continuing: Column) -> Column:
    """Null for a usable request, else why not: bad numbers, an empty region, an unknown kind, or a kind other than the one being continued."""
    numbers = F.coalesce(x0 + y0 + x1 + y1, F.lit(None).cast("double"))
    return (
        F.when(numbers.isNull(), "bad numbers")
        .when((x1 <= x0) | (y1 <= y0), "empty region")
        .when(~F.coalesce(kind.isin(KINDS), F.lit(False)), "unknown kind")
        .when(continuing.isNotNull() & (kind != continuing), "other kind")
    )


def page_number(thumb: Column, typed: Column, pages: Column) -> Column:
    """The chosen page, the thumbnail's number before the typed one; null if it is none of 1..pages."""
    n = F.coalesce(F.nullif(F.trim(thumb), F.lit("")), typed).try_cast("int")
    return F.when(n.between(1, pages), n)


def valid_token(token: Column) -> Column:
    return F.coalesce(token.rlike(r"\A[0-9a-f]+\z"), F.lit(False))


def erase_rects(raw: Column, most: int = 20, scale: float = PREVIEW_SCALE) -> Column:
    """A JSON array of boxes in points: null if it is malformed, has over `most` boxes or one without four numbers; boxes without area are left out."""
    boxes = F.from_json(raw, "array<array<double>>", {"mode": "PERMISSIVE"})
    whole = boxes.isNotNull() & (F.size(boxes) <= most) & F.forall(boxes, lambda b: b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()))
    area = F.filter(boxes, lambda b: (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1))))
    return F.when(whole, F.transform(area, lambda b: F.transform(b, lambda v: v / scale)))


def is_empty_result(kind: Column, items: Column, cells: Column) -> Column:
    """A paragraph without text, a list without items, a table without text; an image never."""
    filled = lambda a: F.exists(a, lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    return F.when(kind == "paragraph", ~filled(items)).when(kind == "list", F.size(items) == 0).when(kind == "table", ~filled(cells)).otherwise(False)


def judge_fragments(results: DataFrame, id_column: str = "token") -> DataFrame:
    """results (id, empty, xml) with `valid`: null where nothing is to be judged, else whether the fragment is well formed (each close ends the innermost open element, nothing stays open, and < and & stand in tags and references alone)."""
    tags = tag_stream(results, id_column, "xml")
    rows = nested(tags, id_column)
    wrong = F.col("is_close") & ~F.coalesce(F.col("plain_top") == F.col("name"), F.lit(False))
    nests = rows.groupBy(id_column).agg((~F.max(wrong) & (F.count_if("is_close") == F.count_if(~F.col("is_close") & ~F.col("is_self")))).alias("nests"))
    rest = F.regexp_replace(F.coalesce("xml", F.lit("")), TAG, "")
    plain = ~rest.contains("<") & ~rest.rlike(r"&(?!(?:\w+|#\d+|#x[0-9A-Fa-f]+);)")
    found = results.join(nests, id_column, "left")
    return found.withColumn("valid", F.when(~F.col("empty"), F.coalesce("nests", F.lit(True)) & plain)).drop("nests")


def merge_and_judge(base: DataFrame, more: DataFrame, key: str = "token") -> DataFrame:
    """merge_continuations() with `empty` and `valid`: what was put together is judged anew, whatever the pages were judged before; a fragment without text in its items is empty and is not judged."""
    merged = merge_continuations(base, more, key)
    plain = F.regexp_replace(F.array_join("items", ""), TAG, "")
    return judge_fragments(merged.drop("empty", "valid").withColumn("empty", F.regexp_replace(F.coalesce(plain, F.lit("")), r"(?U)\s", "") == ""), key)


def fraction_to_pixels(fraction: Column, size: Column) -> Column:
    """A share of an image's size in whole pixels, inside the image."""
    return F.least(F.greatest(F.round(fraction * size), F.lit(0)), size).cast("int")


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key."""
    own = Window.partitionBy(*keys).orderBy(F.desc(order))
    return events.withColumn("_nth", F.row_number().over(own)).filter("_nth = 1").drop("_nth")


def continuation_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """events (action: arm, append, done) with `continuing`: whether an arm without a done stands at each event. An append outside is `rejected`."""
    own = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    switch = F.last(F.when(F.col("action").isin("arm", "done"), F.col("action")), True).over(own)
    rows = events.withColumn("continuing", F.coalesce(switch == "arm", F.lit(False)))
    return rows.withColumn("rejected", (F.col("action") == "append") & ~F.col("continuing"))


def pending_matches(pending: DataFrame, submitted: DataFrame) -> DataFrame:
    """submitted (token, page) with `accepted`: whether the token's pending hand-off is for that page."""
    wait = pending.select("token", F.col("page").alias("pending_page"))
    return submitted.join(wait, "token", "left").withColumn("accepted", F.coalesce(F.col("page") == F.col("pending_page"), F.lit(False))).drop("pending_page")
