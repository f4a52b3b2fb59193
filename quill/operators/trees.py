"""Foreign lists and tables as trees of blocks, written out in document order.

A span's tags, under their names in the target's vocabulary, say by nested() what is open around
them. Items, cells and titles own the text that is nearest inside them; owned text is grouped into
paragraphs or a cell's text. Lists come out in the order of their tags: an item ends where the next
one of its list begins or its list ends, so a list that stands between items falls to the item
before, and an item's own paragraphs are said where it begins, so its lists follow them. Rows are
told apart by the section that they are put into. No step repeats over depths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import attr_text, collapse
from quill.operators.lineage import cut
from quill.operators.structure import LISTS, TABLES, frames, nested, table_cells
from quill.operators.tags import tag_stream, translate_inline

#: What foreign names are in the target's vocabulary, tags that hold nothing, blocks that no item may hold, and the kinds of numbering.
NAMES = {"ul": "itemizedlist", "ol": "orderedlist", "li": "listitem", "row": "tr", "entry": "td", "tfoot": "tbody"}
VOID = ["br", "hr", "img", "col", "colspec", "spanspec"]
NOT_IN_ITEMS = ["table", "informaltable", "figure", "mediaobject", "informalfigure"]
NUMERATIONS = ["arabic", "loweralpha", "upperalpha", "lowerroman", "upperroman"]

_OWNERS = {"in_item": ("listitem", *LISTS), "in_cell": ("td",), "in_title": ("title", "caption")}


def snippets(docs: DataFrame, spans: DataFrame, id_column: str) -> DataFrame:
    """id (of the text, start, end), text: each span's text."""
    text = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return docs.join(spans, id_column).select(F.struct(id_column, "start", "end").alias("id"), text.alias("text"))


def block_tree(texts: DataFrame) -> DataFrame:
    """nested() tags of (id, text) under the target's names, with `given`, the name in the text, and the item, cell and title around the gap before each tag."""
    tags = tag_stream(texts, "id").withColumn("given", F.col("name"))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col("name")), F.col("name"))
    void = F.col("given").isin(VOID)
    return nested(tags.withColumn("name", named).withColumn("is_self", F.col("is_self") | (void & ~F.col("is_close"))), "id", around=_OWNERS)


def as_text(gap: Column) -> Column:
    """Text between tags, with lone angle brackets and ampersands as references; references stay."""
    text = F.regexp_replace(gap, r"&(?!#?\w+;)", "&amp;")
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _joined(order: str, part: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part]), "")


def _item_paragraphs(rows: DataFrame) -> DataFrame:
    """id, owner, paras: the paragraphs of each item. A paragraph ends at paragraph tags and at lists; one without text is none, unless its tag is in the text."""
    mine = rows.filter("in_item_tag = 'listitem'")
    opens, is_para = ~F.col("is_close"), F.col("name").isin("p", "para")
    ends = is_para | (opens & F.col("name").isin(*LISTS, "listitem"))
    markup = F.when((F.col("name") == "emphasis") & ~F.col("is_self"), F.concat(F.lit("<"), F.when(F.col("is_close"), "/").otherwise(""), F.lit("emphasis"), F.when(opens, F.col("attrs")).otherwise(""), F.lit(">")))
    own = Window.partitionBy("id", "in_item").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(ends.cast("int")).over(own), F.lit(0))
    asked = F.coalesce(F.last(F.when(ends, is_para & opens), True).over(own), F.lit(False))
    said = F.concat(as_text(F.col("gap")), F.coalesce(markup, F.when(F.col("given") == "br", " ").otherwise("")))
    pieces = mine.select("id", F.col("in_item").alias("owner"), "start", place.alias("para"), asked.alias("asked"), said.alias("said"))
    paras = pieces.groupBy("id", "owner", "para").agg(F.max("asked").alias("asked"), _joined("start", "said").alias("text"))
    plain = collapse(F.regexp_replace("text", "</?emphasis[^<>]*>", ""))
    even = F.regexp_count("text", F.lit("<emphasis")) == F.regexp_count("text", F.lit("</emphasis"))
    text = F.concat(F.lit("<para>"), F.when(plain == "", "").when(even, collapse(F.col("text"))).otherwise(plain), F.lit("</para>"))
    paras = paras.withColumn("xml", text).filter((plain != "") | F.col("asked"))
    return paras.groupBy("id", "owner").agg(_joined("para", "xml").alias("paras"))


def convert_lists(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, start, end, xml, problem: each outer list span of a text as a DocBook list. Each run of text and inline tags in an item is a paragraph (bold and italic tags as emphasis, other inline tags go), an item without any gets an empty one; an item's lists follow its paragraphs, a list between items falls to the item before it, or to an empty one; an ordered list keeps a known numeration; text between items goes. xml is null, and problem says why, where a list is not closed or has no items, or an item holds a table or a medium."""
    rows = cut(block_tree(translate_inline(snippets(docs, spans, id_column))))
    opens, is_list = ~F.col("is_close"), F.col("name").isin(*LISTS)
    in_list = F.coalesce(F.col("parent_tag").isin(*LISTS), F.lit(False))
    opens_list, closes_list = opens & is_list & ~F.col("is_self"), F.coalesce(F.col("closes_tag").isin(*LISTS), F.lit(False))
    item = opens & (F.col("name") == "listitem") & in_list
    blocks = rows.filter(opens_list | closes_list | item).withColumn("of", F.when(closes_list, F.col("closes")).otherwise(F.when(in_list, F.col("parent"))))
    within = Window.partitionBy("id", "of").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum((item | (opens_list & in_list)).cast("int")).over(within), F.lit(0))
    blocks = blocks.withColumn("held", held)
    paras = _item_paragraphs(rows).withColumnRenamed("owner", "start")
    blocks = blocks.join(paras, ["id", "start"], "left")
    none, end = F.lit("<para></para>"), F.when(F.col("held") > 0, "</listitem>").otherwise("")
    numbered = F.when((F.col("name") == "orderedlist") & attr_text(F.col("attrs"), "numeration").isin(NUMERATIONS), F.concat(F.lit(' numeration="'), attr_text(F.col("attrs"), "numeration"), F.lit('"'))).otherwise("")
    opener = F.concat(F.when(in_list & (F.col("held") == 0), F.concat(F.lit("<listitem>"), none)).otherwise(""), F.lit("<"), "name", F.coalesce(numbered, F.lit("")), F.lit(">"))
    xml = F.when(item, F.concat(end, F.lit("<listitem>"), F.coalesce("paras", none))).when(closes_list, F.concat(end, F.lit("</"), "closes_tag", F.lit(">"))).otherwise(opener)
    made = blocks.withColumn("xml", xml).groupBy("id").agg(_joined("start", "xml").alias("xml"), F.sum(F.when(opens_list, 1).when(closes_list, -1).otherwise(0)).alias("left"), F.max(closes_list & (F.col("held") == 0)).alias("empty"))
    barred = rows.filter(opens & F.col("name").isin(NOT_IN_ITEMS) & (F.col("parent_tag") == "listitem")).groupBy("id").agg(F.min_by("name", "start").alias("barred"))
    found = made.join(barred, "id", "left")
    problem = F.when(F.col("left") != 0, "a list is not closed").when(F.col("empty"), "a list has no items").when(F.col("barred").isNotNull(), F.concat(F.lit("an item holds a <"), "barred", F.lit(">; restructure it by hand")))
    return found.select(F.col(f"id.{id_column}").alias(id_column), "id.start", "id.end", F.when(problem.isNull(), F.col("xml")).alias("xml"), problem.alias("problem"))


def convert_tables(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, start, end, xml, problem: each outer table of a text, with HTML rows and cells or with rows and entries, as one form. Rows of a head are the head, with header cells alone; then come those of bodies, of feet, and of no section. Without a head a first row of header cells alone is it, if others follow. Rows without cells go; a cell's text is one paragraph with its white space collapsed; spans over 1 stay; titles and captions stand before the table as paragraphs. End tags of rows and cells may be missing. xml is null, and problem says why, where tables nest, entries span, or there are no rows."""
    rows = cut(block_tree(snippets(docs, spans, id_column)))
    framed = cut(frames(rows, "id"))
    opens = ~F.col("is_close") & ~F.col("is_self")
    sections = rows.filter(opens & F.col("name").isin("thead", "tbody")).select("id", F.col("start").alias("section"), "given")
    cells = table_cells(framed, "id").join(framed.filter("name in ('td', 'th')").select("id", "start", F.col("near_row").alias("line")), ["id", "start"])
    lines = framed.filter("name = 'tr'").select("id", F.col("start").alias("line"), F.col("parent").alias("section"))
    kind = F.when(F.col("given") == "thead", 0).when(F.col("given") == "tbody", 1).when(F.col("given") == "tfoot", 2).otherwise(3)
    lines = lines.join(sections, ["id", "section"], "left").select("id", "line", kind.alias("kind"))
    said = rows.filter("in_cell is not null").groupBy("id", F.col("in_cell").alias("start")).agg(F.array_sort(F.collect_list(F.struct("seq", "gap"))).alias("g"))
    text = collapse(as_text(F.array_join(F.transform("g", lambda x: x["gap"]), " ")))
    cells = cells.join(lines, ["id", "line"]).join(said.select("id", "start", text.alias("text")), ["id", "start"], "left")
    # Whether there is a head, and else whether the first row can be it.
    whole = Window.partitionBy("id")
    first = F.row_number().over(whole.orderBy("kind", "line"))
    by_row = cells.groupBy("id", "line", "kind").agg(F.bool_and("is_header").alias("all_header"), F.collect_list(F.struct("col", "is_header", "text", "colspan", "rowspan")).alias("cells"))
    by_row = by_row.withColumns({"first": first, "n": F.count("*").over(whole), "least": F.min("kind").over(whole)})
    head = (F.col("kind") == 0) | ((F.col("least") > 0) & (F.col("first") == 1) & (F.col("n") > 1) & F.col("all_header"))
    span = lambda c, name: F.when(c[name] > 1, F.concat(F.lit(f' {name}="'), c[name], F.lit('"'))).otherwise("")
    tag = lambda c: F.when(F.col("head") | c["is_header"], "th").otherwise("td")
    cell = lambda c: F.concat(F.lit("<"), tag(c), span(c, "colspan"), span(c, "rowspan"), F.lit("><para>"), F.coalesce(c["text"], F.lit("")), F.lit("</para></"), tag(c), F.lit(">"))
    by_row = by_row.withColumn("head", head).withColumn("xml", F.concat(F.lit("<tr>"), F.array_join(F.transform(F.array_sort("cells"), cell), ""), F.lit("</tr>")))
    part = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("kind", "line", "xml")))), lambda r: r["xml"]), "")
    made = by_row.groupBy("id").agg(part(F.col("head")).alias("head"), part(~F.col("head")).alias("body"))
    titled = rows.filter(opens & F.col("name").isin("title", "caption") & F.col("parent_tag").isin(*TABLES, "tgroup")).select("id", F.col("start").alias("in_title"))
    titles = rows.join(titled, ["id", "in_title"]).groupBy("id", "in_title").agg(F.array_sort(F.collect_list(F.struct("seq", "gap"))).alias("g"))
    titles = titles.withColumn("text", collapse(as_text(F.array_join(F.transform("g", lambda x: x["gap"]), " ")))).filter("text != ''")
    titles = titles.withColumn("xml", F.concat(F.lit("<para>"), "text", F.lit("</para>"))).groupBy("id").agg(_joined("in_title", "xml").alias("titles"))
    facts = rows.groupBy("id").agg(
        F.count_if(opens & F.col("name").isin(*TABLES)).alias("tables"),
        F.max((F.col("given") == "entry") & F.col("attrs").rlike(r"(?i)\b(?:namest|nameend|spanname|morerows)\s*=")).alias("spanning"),
    )
    found = facts.join(made, "id", "left").join(titles, "id", "left")
    table = F.concat(F.coalesce("titles", F.lit("")), F.lit('<informaltable frame="box" rules="all">'), F.when(F.col("head") != "", F.concat(F.lit("<thead>"), "head", F.lit("</thead>"))).otherwise(""), F.lit("<tbody>"), F.when(F.col("body") != "", F.col("body")).otherwise("<tr></tr>"), F.lit("</tbody></informaltable>"))
    problem = F.when(F.col("tables") > 1, "a table holds another").when(F.col("spanning"), "its entries span columns or rows; convert it by hand").when(F.col("head").isNull(), "the table has no rows")
    return found.select(F.col(f"id.{id_column}").alias(id_column), "id.start", "id.end", F.when(problem.isNull(), table).alias("xml"), problem.alias("problem"))
