"""The tag stream of markup texts, and what is balanced, foreign or unknown in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import PLAIN_TAG, TAG, count_of


def tag_stream(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each tag: its place, line, name, attributes, kind and the gap before it. Matches and the gaps between them alternate, so running sums of their lengths are exact code-point offsets."""
    text = F.col(text_column)
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(TAG), F.lit(0)).alias("tag"), F.split(text, TAG, -1).alias("gap"))
    rows = docs.filter(text.isNotNull()).select(F.col(id_column), F.posexplode(pieces).alias("seq", "piece"))
    rows = rows.select(id_column, "seq", F.col("piece.tag").alias("tag"), F.col("piece.gap").alias("gap")).filter("tag is not null")
    before = Window.partitionBy(id_column).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.select("*", (passed(F.length("gap") + F.length("tag")) + F.length("gap")).alias("start"), (passed(count_of(F.col("gap"), "\n") + count_of(F.col("tag"), "\n")) + count_of(F.col("gap"), "\n") + 1).alias("line"))
    # A tag without blanks and attributes, as most are, is told by one search for its name; others are matched again for each part.
    rows = rows.withColumn("plain", F.regexp_extract("tag", PLAIN_TAG, 1))
    is_plain, group = F.col("plain") != "", lambda k: F.regexp_extract("tag", TAG, k)
    rows = rows.withColumn("is_close", F.when(is_plain, F.col("tag").startswith("</")).otherwise(group(1) == "/"))
    ends = F.when(is_plain, F.col("tag").endswith("/>")).otherwise(group(4) == "/")
    name, attrs = F.when(is_plain, F.col("plain")).otherwise(group(2)), F.when(is_plain, "").otherwise(group(3))
    return rows.select(id_column, "seq", "start", (F.col("start") + F.length("tag")).alias("end"), "line", F.lower(name).alias("name"), attrs.alias("attrs"), "is_close", (ends & ~F.col("is_close")).alias("is_self"), "gap")


#: The names that the check of closing tags knows where no vocabulary is given.
VOCABULARY = [
    "section", "title", "para", "orderedlist", "itemizedlist", "listitem", "informaltable", "thead", "tbody", "tr", "th", "td", "colgroup", "col",
    "mediaobject", "imageobject", "imagedata", "informalfigure", "fileref", "emphasis", "guilabel", "xref", "indexterm", "note", "warning", "caution",
]


def known_tags(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags whose name is in the vocabulary (name); it is broadcast while Spark's size threshold allows."""
    return tags.join(vocabulary.select(F.lower("name").alias("name")).distinct(), "name", "left_semi")


def unbalanced_tags(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Closing tags without an opener and openers never closed, per name whatever the nesting: a close takes the latest opener of its name.

    With s the running sum of +1 and -1 over one name, a close is stray where s falls below all sums before it and below 0; an opener is never closed where no later sum falls below its own."""
    own = Window.partitionBy(id_column, "name").orderBy("start")
    s = tags.filter("not is_self").withColumn("s", F.sum(F.when(F.col("is_close"), -1).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.coalesce(F.min("s").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.min("s").over(own.rowsBetween(1, Window.unboundedFollowing))
    stray = F.col("is_close") & (F.col("s") < F.least(F.lit(0), low))
    unclosed = ~F.col("is_close") & (later.isNull() | (later >= F.col("s")))
    rows = s.withColumn("code", F.when(stray, "tag.stray_close").when(unclosed, "tag.unclosed")).filter("code is not null")
    fix = F.when(F.col("code") == "tag.stray_close", "delete-stray-close").when(F.col("name").isin("para", "title"), "insert-close").when(F.col("name") == "section", "close-section")
    message = F.when(F.col("code") == "tag.stray_close", F.concat(F.lit("</"), "name", F.lit("> closes nothing"))).otherwise(F.concat(F.lit("<"), "name", F.lit("> stays open")))
    return rows.select(id_column, "line", "start", "end", F.col("name").alias("tag"), "code", message.alias("message"), fix.alias("fix"))


def matched(tags: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Openers with the close that each pairs with, per name whatever the nesting: id, name, start, end, level, p_start, p_end (null for one never closed; its own end for a self-closed tag).

    With `level` the running sum of +1 and -1 over one name after an opener and before a close, an opener's close is the next tag of its level."""
    # Self-closed tags are told apart by the windows and not by a union, which would have tags that are dealt by text dealt again.
    kind = [id_column, "name", "is_self"]
    own = Window.partitionBy(*kind).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    rows = tags.withColumn("s", F.sum(F.when(F.col("is_close"), -1).otherwise(1)).over(own))
    rows = rows.withColumn("level", F.col("s") + F.col("is_close").cast("int"))
    at = Window.partitionBy(*kind, "level").orderBy("start")
    pairs, is_self = F.lead("is_close").over(at), F.col("is_self")
    mate = lambda c: F.when(is_self, F.col("end")).when(pairs, F.lead(c).over(at))
    rows = rows.withColumns({"p_start": mate("start"), "p_end": mate("end")}).filter("is_self or not is_close")
    return rows.select(id_column, "name", "start", "end", F.when(~is_self, F.col("level")).alias("level"), "p_start", "p_end")


def child_spans(tags: DataFrame, name: str, id_column: str = "doc_id") -> DataFrame:
    """id, start, close_start, children: every closed element of a name with the (start, end) of those of the same name directly inside it, in order."""
    rows = matched(tags.filter(F.col("name") == name), id_column).filter("level is not null")
    inner = rows.filter("p_start is not null").select(id_column, F.col("level").alias("at"), F.col("start").alias("o"), F.struct("start", F.col("p_end").alias("end")).alias("child"), F.lit(None).cast("long").alias("outer"))
    outer = rows.select(id_column, (F.col("level") + 1).alias("at"), F.col("start").alias("o"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("child"), F.col("start").alias("outer"))
    # As-of within (document, level): the latest opener one level up is around.
    around = F.last("outer", True).over(Window.partitionBy(id_column, "at").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    cast = lambda df: df.withColumns({"o": F.col("o").cast("long"), "child": F.col("child").cast("struct<start:bigint,end:bigint>"), "outer": F.col("outer").cast("long")})
    met = cast(inner).unionByName(cast(outer)).withColumn("start", around).filter("child is not null and start is not null")
    children = met.groupBy(id_column, "start").agg(F.array_sort(F.collect_list("child")).alias("children"))
    closed = rows.filter("p_start is not null").select(id_column, F.col("start").cast("long").alias("start"), F.col("p_start").alias("close_start"))
    return closed.join(children, [id_column, "start"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<struct<start:bigint,end:bigint>>")))


def outer_spans(tags: DataFrame, names: list[str], id_column: str = "doc_id", named: bool = False) -> DataFrame:
    """The outermost spans of a set of names, whose tags nest into each other: (start, end), and the opener's name if it is asked for, from an opener at depth 0 to the close that returns there. Stray closes and self-closed tags count for nothing, unclosed spans are left out."""
    own = Window.partitionBy(id_column).orderBy("start")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = tags.filter(F.col("name").isin(names) & ~F.col("is_self"))
    rows = rows.withColumn("s", F.sum(F.when(F.col("is_close"), -1).otherwise(1)).over(upto))
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    before = F.coalesce(F.lag("depth").over(own), F.lit(0))
    rows = rows.withColumn("opens", (~F.col("is_close") & (before == 0)).cast("int")).withColumn("closes", F.col("is_close") & (F.col("depth") == 0) & (before > 0))
    rows = rows.withColumn("span", F.sum("opens").over(upto))
    spans = rows.groupBy(id_column, "span").agg(F.min(F.when(F.col("opens") == 1, F.struct("start", "name"))).alias("o"), F.max(F.when(F.col("closes"), F.col("end"))).alias("end"))
    spans = spans.filter("o is not null and end is not null").select(id_column, "o.start", "end", "o.name")
    return spans if named else spans.drop("name")


#: name -> what replaces its opener; closers of all become </emphasis>.
INLINE = {"b": '<emphasis role="strong">', "strong": '<emphasis role="strong">', "i": "<emphasis>", "em": "<emphasis>"}


def translate_inline(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with bold and italic tags as emphasis (attributes and empty tags go) and `n_translated`, how many tags that were."""
    any_name = "|".join(INLINE)
    tag = lambda slash, names, self: rf"(?iU)<\s*{slash}\s*(?:{names})(?![\w.-])[^<>]*?{self}\s*>"
    text = F.col(text_column)
    count = F.regexp_count(text, F.lit(tag("/?", any_name, "/?")))
    out = F.regexp_replace(text, tag("/", any_name, ""), "</emphasis>")
    out = F.regexp_replace(out, tag("", any_name, "/"), "")
    out = F.regexp_replace(out, tag("", "b|strong", ""), '<emphasis role="strong">')
    out = F.regexp_replace(out, tag("", "i|em", ""), "<emphasis>")
    return docs.withColumn("n_translated", count).withColumn(text_column, out)
