"""Rules of tables, lists and paragraphs in texts whose tags need not nest, and of content outside the root section."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quill.functions.text import TAG, attr_int, count_of, has_text
from quill.operators.findings import SPEC, finding
from quill.operators.tables import row_widths

TABLES, LISTS = ("table", "informaltable"), ("itemizedlist", "orderedlist")
#: What may stand directly inside a paragraph, and inside the parts of a table.
INLINE = ["emphasis", "guilabel", "guibutton", "xref", "indexterm"]
SLOTS = {
    "table": ["title", "caption", "colgroup", "thead", "tbody"],
    "informaltable": ["title", "caption", "colgroup", "thead", "tbody"],
    "colgroup": ["col"],
    "thead": ["tr"],
    "tbody": ["tr"],
    "tr": ["td", "th"],
}

#: An opener of these ends whatever is open above the innermost of its containers.
_ENDS = {"listitem": LISTS, "tr": ("thead", "tbody", *TABLES), "td": ("tr", "thead", "tbody", *TABLES), "th": ("tr", "thead", "tbody", *TABLES)}
#: A close of these reaches no further than the innermost of these.
_WITHIN = {"tr": TABLES, "td": ("tr", *TABLES), "th": ("tr", *TABLES)}
#: A close of either takes an opener of the other.
_KIND = {"th": "td"}
#: column -> the element of these names that is nearest around a tag
_NEAR = {"near_table": TABLES, "near_row": ("tr", *TABLES), "near_item": ("listitem", *LISTS), "near_media": ("mediaobject", *LISTS)}


class _Open:
    """The elements open at one place, as (start, name), where each kind of them is, and at every depth the index of the innermost element of some groups of names, -1 for none, so that a tag asks for no search."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = (), told: int = 0):
        self.frames, self.places, self.told = [], {}, told
        self.near, self.says = [(-1,) * len(groups)], [(None,) * (2 * told)]
        self.members = {}
        for g, names in enumerate(groups):
            for name in names:
                self.members.setdefault(_KIND.get(name, name), set()).add(g)

    def clear(self) -> None:
        self.cut(0)

    def latest(self, name: str) -> int:
        """The index of the innermost element of a kind, -1 for none."""
        at = self.places.get(_KIND.get(name, name))
        return at[-1] if at else -1

    def cut(self, size: int) -> None:
        while len(self.frames) > size:
            name = self.frames.pop()[1]
            self.near.pop()
            self.says.pop()
            self.places[_KIND.get(name, name)].pop()

    def open(self, start: int, name: str) -> None:
        kind, k = _KIND.get(name, name), len(self.frames)
        self.places.setdefault(kind, []).append(k)
        self.frames.append((start, name))
        near, says = self.near[-1], self.says[-1]
        if mine := self.members.get(kind):
            near = tuple(k if g in mine else n for g, n in enumerate(near))
            says = tuple(x for n in near[: self.told] for x in (self.frames[n] if n >= 0 else (None, None)))
        self.near.append(near)
        self.says.append(says)


def nested(tags: DataFrame, id_column: str = "doc_id", around: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Tags with what is open around each, under a lenient stack: a close ends the nearest open element of its name and all above it, or is stray.

    `top` (start, name) is the innermost element before the tag takes effect, so it holds the gap before the tag; `parent` the one that an opener is put into, after what it ends by itself (an item, a row or a cell ends the one before it); `closes` the opener that a close ends; near_table and so on the nearest elements of a kind around; `plain_top` the innermost element where openers end nothing. An element that no close names was never closed. around: further columns, each with the nearest element of some names around the gap before a tag. Tags stream by in order, so a task holds the elements open at one place."""
    around = around or {}
    added = ["top", "parent", "closes", *_NEAR, *around]
    none, near = (None, None), len(_NEAR)
    # The groups that columns tell come first, then those that ends and closes ask for.
    groups = (*_NEAR.values(), *around.values(), *_ENDS.values(), *_WITHIN.values())
    ends = {name: near + len(around) + g for g, name in enumerate(_ENDS)}
    within = {name: near + len(around) + len(_ENDS) + g for g, name in enumerate(_WITHIN)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_, plain = object(), _Open(groups, near + len(around)), _Open()
        frames, nearest, says, plains = open_.frames, open_.near, open_.says, plain.frames
        for batch in batches:
            ids, starts, names, closes, selfs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (id_column, "start", "name", "is_close", "is_self"))
            tops, parents, ended, nears, arounds, plain_tops = [], [], [], [], [], []
            for doc, start, name, is_close, is_self in zip(ids, starts, names, closes, selfs):
                if doc != current:
                    current = doc
                    open_.clear()
                    plain.clear()
                tops.append(frames[-1] if frames else none)
                plain_tops.append(plains[-1][1] if plains else None)
                arounds.append(says[-1])
                if not is_close and not is_self and name in ends and (k := nearest[-1][ends[name]]) >= 0:
                    open_.cut(k + 1)
                parents.append(frames[-1] if frames else none)
                nears.append(says[-1])
                closed = none
                if is_close:
                    k = open_.latest(name)
                    if k > (nearest[-1][within[name]] if name in within else -1):
                        closed = frames[k]
                        open_.cut(k)
                    if (k := plain.latest(name)) >= 0:
                        plain.cut(k)
                elif not is_self:
                    open_.open(start, name)
                    plain.open(start, name)
                ended.append(closed)
            told = [x for rows in (tops, parents, ended) for x in zip(*rows)] + list(zip(*nears))[: 2 * near] + list(zip(*arounds))[2 * near :]
            columns = [pa.array(told[i] if told else [], (pa.int64(), pa.string())[i % 2]) for i in range(2 * len(added))]
            names_out = [n for c in added for n in (c, f"{c}_tag")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(plain_tops, pa.string())], [*batch.schema.names, *names_out, "plain_top"])

    # The window puts a text's tags together and in order; tags that are dealt by text already are not dealt again.
    rows = tags.withColumn("start", F.col("start").cast("long"))
    rows = rows.withColumn("nth_tag", F.row_number().over(Window.partitionBy(id_column).orderBy("start")))
    fields = [StructField(n, t) for c in added for n, t in ((c, LongType()), (f"{c}_tag", StringType()))]
    return rows.mapInArrow(walk, StructType([*rows.schema.fields, *fields, StructField("plain_top", StringType())])).drop("nth_tag")


def _says(pattern: str) -> Column:
    """A message with the columns that {} name."""
    parts = re.split(r"\{(\w+)\}", pattern)
    return F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


#: What stays open until it is closed, and has rules on what it holds.
_FRAMES = (*TABLES, *LISTS, "listitem", "tr", "td", "th")


def _rule(when: Column, code: Column | str, message: Column, tag: Column | None = None, fix: Column | str | None = None, start: Column | None = None, end: Column | None = None, line: Column | None = None, **spec: Column) -> Column:
    """A finding where a condition holds, for _told()."""
    text = lambda x: (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")
    place = [(F.col(n) if x is None else x).cast("long").alias(n) for n, x in (("line", line), ("start", start), ("end", end))]
    given = [(spec[c] if c in spec else F.lit(None)).cast("long").alias(c) for c in SPEC]
    return F.when(when, F.struct(*place, text(tag).alias("tag"), text(code).alias("code"), text(message).alias("message"), text(fix).alias("fix"), *given))


def _told(rows: DataFrame, id_column: str, *rules: Column) -> DataFrame:
    """The findings of several rules in one pass over the rows. Rules that say nothing are dropped after the explode, which Spark compiles, as a function over the array is interpreted."""
    return rows.select(id_column, F.explode(F.array(*rules)).alias("f")).filter("f is not null").select(id_column, "f.*")


def frames(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row for each list, item, table, row and cell of nested() tags: its opener's fields, whether a close names it and where that ends, and what tags say of it: items, whether an item is filled, cells and the last of them, rows, and the columns that a colgroup declares. One grouping of what each tag says."""
    name, opens = F.col("name"), ~F.col("is_close")
    whole = opens & ~F.col("is_self")
    in_list, is_item, is_cell = F.col("parent_tag").isin(*LISTS), name == "listitem", name.isin("td", "th")
    opener = F.struct("name", "line", "end", "parent", "parent_tag", "near_table", "near_row", "near_row_tag", "attrs")
    in_row = whole & is_cell & (F.col("near_row_tag") == "tr")
    # Paragraphs and media count for the nearest item unless a list is nearer, lists for the item that they are put into.
    fills = opens & name.isin("para", "mediaobject") & (F.col("near_item_tag") == "listitem") & ~(F.col("is_self") & (name == "para"))
    holds = whole & name.isin(*LISTS) & (F.col("parent_tag") == "listitem")
    fields = {"opener": opener, "close": F.struct("start", "end"), "item": F.lit(1), "fill": F.lit(True), "cell": F.col("start"), "row": F.lit(1), "declared": attr_int(F.col("attrs"), "span")}
    types = {"close": "struct<start:bigint,end:bigint>", "item": "int", "fill": "boolean", "cell": "long", "row": "int", "declared": "int"}

    def says(when: Column, frame: str, what: str) -> Column:
        others = [(fields[k].cast(types[k]) if k == what and k in types else fields[k] if k == what else F.lit(None).cast(types[k]) if k in types else F.when(F.lit(False), opener)).alias(k) for k in fields]
        return F.when(when, F.struct(F.col(frame).cast("long").alias("frame"), *others))

    told = [
        says(whole & name.isin(*_FRAMES), "start", "opener"),
        says(F.col("closes_tag").isin(*_FRAMES), "closes", "close"),
        says(opens & is_item & in_list, "parent", "item"),
        says(fills, "near_item", "fill"),
        says(holds, "parent", "fill"),
        says(in_row, "near_row", "cell"),
        says(whole & (name == "tr") & F.col("near_table").isNotNull(), "near_table", "row"),
        says(opens & (name == "col") & (F.col("parent_tag") == "colgroup"), "near_table", "declared"),
    ]
    parts = rows.select(id_column, F.explode(F.array(*told)).alias("t")).filter("t.frame is not null").select(id_column, "t.*")
    grouped = parts.groupBy(id_column, F.col("frame").alias("start")).agg(
        F.max("opener").alias("o"), F.max("close").alias("close"), F.count("item").alias("items"), F.coalesce(F.max("fill"), F.lit(False)).alias("filled"),
        F.count("cell").alias("cells"), F.max("cell").alias("last_cell"), F.count("row").alias("rows"), F.sum("declared").alias("declared"),
    )
    return grouped.filter("o is not null").select(id_column, "start", "o.*", F.col("close.start").alias("close_start"), F.col("close.end").alias("close_end"), F.col("close").isNotNull().alias("closed"), "items", "filled", "cells", "last_cell", "rows", "declared")


def check_tables(rows: DataFrame, framed: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """Findings on tables from nested(): elements and text in the wrong slot, text in cells, rows and cells that are not opened, closed or closed by the other kind, tables without rows, rows without cells, and uneven widths. framed: frames(rows), if it is at hand."""
    framed = frames(rows, id_column) if framed is None else framed
    name, opens, self_ = F.col("name"), ~F.col("is_close"), F.col("is_self")
    inside, closes = F.col("near_table").isNotNull(), F.col("closes")
    slots = F.create_map(*[x for k, v in SLOTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.try_element_at(slots, F.col("parent_tag"))
    is_cell = name.isin("td", "th")
    outside = inside & opens & is_cell & ~self_ & (F.col("near_row_tag") != "tr")
    misplaced = inside & opens & ~F.coalesce(outside, F.lit(False)) & ~F.array_contains(allowed, name) & ~(self_ & name.isin(*TABLES, "tr", "td", "th", "thead", "tbody", "colgroup"))
    stray = F.col("is_close") & closes.isNull()
    gap = F.col("gap")
    text, in_cell = has_text(gap), F.col("top_tag").isin("td", "th")
    where = {"start": F.col("start") - F.length(gap), "end": F.col("start"), "line": F.col("line") - count_of(gap, "\n")}
    out = _told(
        rows, id_column,
        _rule(outside, "table.cell_outside_row", _says("<{name}> is in no row"), name),
        _rule(misplaced, "table.misplaced_child", _says("<{name}> directly inside <{parent_tag}>"), name),
        _rule(inside & stray & is_cell, "table.cell_stray_close", _says("</{name}> closes no row or cell"), name),
        _rule(inside & is_cell & closes.isNotNull() & (name != F.col("closes_tag")), "table.cell_wrong_close", _says("</{name}> closes a <{closes_tag}> cell"), name),
        _rule(inside & stray & (name == "tr"), "table.row_stray_close", _says("</{name}> closes no row or cell"), name),
        _rule(stray & name.isin(*TABLES), "table.stray_close", _says("</{name}> closes no table"), name),
        _rule(text & in_cell, "table.text_in_cell", _says("text directly inside <{top_tag}>"), F.col("top_tag"), **where),
        _rule(text & F.col("top_tag").isin(*SLOTS), "table.text_in_container", _says("text directly inside <{top_tag}>"), F.col("top_tag"), **where),
    )
    is_table, is_row, open_ = name.isin(*TABLES), (name == "tr") & inside, ~F.col("closed")
    out = out.unionByName(_told(
        framed, id_column,
        _rule(is_table & open_, "table.unclosed", _says("the table has no </{name}>"), name),
        _rule(is_table & (F.col("rows") == 0), "table.no_rows", _says("<{name}> has no rows"), name),
        _rule(is_row & open_, "table.row_unclosed", F.lit("the row has no </tr>"), name),
        _rule(is_row & (F.col("cells") == 0), "table.row_no_cells", _says("row of line {line} has no cells"), F.lit("tr"), start=F.col("near_table")),
    ))
    # A cell left open is a finding where another cell follows in its row, or its row stays open as well.
    its_row = framed.filter(is_row).select(id_column, F.col("start").alias("near_row"), (~F.col("closed")).alias("row_open"), F.col("last_cell").alias("row_last"))
    cut_off = framed.filter(is_cell & open_ & (F.col("near_row_tag") == "tr")).join(its_row, [id_column, "near_row"])
    more = F.col("start") < F.col("row_last")
    out = out.unionByName(_told(cut_off, id_column, _rule(more | F.col("row_open"), F.when(more, "table.cell_unclosed").otherwise("table.row_cell_unclosed"), _says("the cell has no </{name}>"), name)))
    return out.unionByName(check_table_layout(framed, id_column))


def table_cells(framed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The cells of all tables of frames(): id, table (its opener's start), row (from 0), row_line, col, is_header, colspan, rowspan, start."""
    number = F.row_number().over(Window.partitionBy(id_column, "near_table").orderBy("start")) - 1
    lines = framed.filter("name = 'tr' and near_table is not null").select(id_column, F.col("near_table").alias("table"), F.col("start").alias("near_row"), F.col("line").alias("row_line"), number.alias("row"))
    cells = framed.filter(F.col("name").isin("td", "th") & (F.col("near_row_tag") == "tr"))
    col = F.row_number().over(Window.partitionBy(id_column, "near_row").orderBy("start")) - 1
    cells = cells.select(id_column, "near_row", col.alias("col"), (F.col("name") == "th").alias("is_header"), attr_int(F.col("attrs"), "colspan").alias("colspan"), attr_int(F.col("attrs"), "rowspan").alias("rowspan"), "start")
    return lines.join(cells, [id_column, "near_row"]).drop("near_row")


def check_table_layout(framed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Findings on the widths of rows: several, or one other than the colgroup's (the sum of `span` over its cols). Rows without cells have no width."""
    cells = table_cells(framed, id_column).withColumn("table_key", F.struct(id_column, "table"))
    widths = row_widths(cells.select("table_key", "row", "colspan", "rowspan"), "table_key")
    lines = cells.groupBy("table_key", "row").agg(F.max("row_line").alias("row_line"))
    rows = widths.join(lines, ["table_key", "row"]).groupBy("table_key").agg(F.array_sort(F.collect_list(F.struct("row", "row_line", "width"))).alias("w"), F.min("width").alias("low"), F.max("width").alias("high"))
    rows = rows.select(F.col(f"table_key.{id_column}").alias(id_column), F.col("table_key.table").alias("start"), "w", "low", "high")
    judged = framed.filter(F.col("name").isin(*TABLES)).join(rows, [id_column, "start"])
    ragged = F.col("low") != F.col("high")
    detail = F.array_join(F.transform("w", lambda r: F.concat(F.lit("line "), r["row_line"], F.lit(": "), r["width"])), ", ")
    return _told(
        judged, id_column,
        _rule(ragged, "table.ragged", F.concat(F.lit("rows of several widths ("), detail, F.lit(")")), F.col("name")),
        _rule(~ragged & (F.col("declared") != F.col("low")), "table.colgroup_mismatch", _says("<colgroup> declares {declared} columns, the rows have {low}"), F.lit("colgroup")),
    )


def check_lists(rows: DataFrame, framed: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """Findings on lists from nested(): text, elements and sublists directly in a list, tables in items, items outside lists, items and lists that are empty, not closed or not opened, images outside a mediaobject. framed: frames(rows), if it is at hand."""
    framed = frames(rows, id_column) if framed is None else framed
    name, opens, in_list = F.col("name"), ~F.col("is_close"), F.coalesce(F.col("parent_tag").isin(*LISTS), F.lit(False))
    is_list, is_item, whole = name.isin(*LISTS), name == "listitem", opens & ~F.col("is_self")
    stray = F.col("is_close") & F.col("closes").isNull()
    child, gap = _says("<{name}> directly inside <{parent_tag}>"), F.col("gap")
    loose = opens & in_list & ~is_list & ~is_item
    lone_image = opens & (name == "imageobject") & ~in_list & ~F.coalesce(F.col("near_media_tag") == "mediaobject", F.lit(False))
    start = F.col("start")
    out = _told(
        rows, id_column,
        _rule(is_item & F.col("is_self"), "list.item_self_closed", F.lit("<listitem/> has no content"), name),
        _rule(whole & is_list & in_list, "list.sublist", child, name),
        _rule(whole & is_item & ~in_list, "list.item_outside", F.lit("<listitem> is in no list"), name),
        _rule(loose, "list.misplaced_child", child, name, F.when(whole, "loose-block-in-list"), el_start=start, list_start=F.col("parent")),
        _rule(lone_image, "media.outside", _says("<{name}> outside"), name, "wrap-in-mediaobject", el_start=start),
        _rule(stray & is_item, "list.item_stray_close", _says("</{name}> closes no list or item"), name),
        _rule(stray & is_list, "list.stray_close", _says("</{name}> closes no list or item"), name),
        _rule(has_text(gap) & F.col("top_tag").isin(*LISTS), "list.text_in_container", _says("text directly inside <{top_tag}>"), None, "bare-text-in-list",
              start=start - F.length(gap), end=start, line=F.col("line") - count_of(gap, "\n"), text_start=start - F.length(gap), text_end=start),
    )
    # A table in an item goes below the list that the item is in.
    items = framed.filter(is_item).select(id_column, F.col("start").alias("parent"), F.when(F.col("parent_tag").isin(*LISTS), F.col("parent")).alias("item_list"))
    in_items = framed.filter(name.isin(*TABLES) & (F.col("parent_tag") == "listitem")).join(items, [id_column, "parent"])
    out = out.unionByName(_told(in_items, id_column, _rule(F.lit(True), "list.table_in_item", child, name, "table-in-listitem", el_start=start, list_start=F.col("item_list"))))
    open_ = ~F.col("closed")
    return out.unionByName(_told(
        framed, id_column,
        _rule(is_item & open_, "list.item_unclosed", F.lit("the item has no </listitem>"), name),
        _rule(is_list & open_, "list.unclosed", _says("the list has no </{name}>"), name),
        _rule(is_item & ~F.col("filled"), "list.empty_item", F.lit("<listitem> has no content"), name, F.when(F.col("closed"), "empty-listitem"), el_start=start),
        _rule(is_list & (F.col("items") == 0), "list.no_items", _says("<{name}> has no items"), name),
    ))


def check_paragraphs(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Findings for elements directly inside a paragraph that are not inline."""
    bad = rows.filter((F.col("plain_top") == "para") & ~F.col("is_close") & ~F.col("name").isin(INLINE))
    return finding(bad, id_column, F.lit("para.misplaced_child"), _says("<{name}> directly inside <para>"), F.col("name"), F.lit("unwrap-from-para"), el_start=F.col("start"))


def check_outside_root(tags: DataFrame, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first content before the root section and the first after it: text (comments and declarations are none), elements, and further root sections, which are content after the root."""
    own = Window.partitionBy(id_column).orderBy("start")
    mine = (F.col("name") == "section") & ~F.col("is_self")
    move = F.when(mine & F.col("is_close"), -1).when(mine, 1).otherwise(0)
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    rows = tags.select(id_column, *[F.col(c).cast("long").alias(c) for c in ("start", "end", "line")], "name", "is_close", "is_self", "gap").withColumn("s", F.sum(move).over(upto))
    rows = rows.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(upto)))
    rows = rows.withColumns({"was": F.coalesce(F.lag("depth").over(own), F.lit(0)), "opened": F.coalesce(F.max(mine & ~F.col("is_close")).over(before), F.lit(False)), "is_last": F.lead("start").over(own).isNull()})
    closes = mine & F.col("is_close") & (F.col("was") == 1)
    rows = rows.withColumns({"closed": F.coalesce(F.max(closes).over(before), F.lit(False)), "closed_after": F.max(closes).over(upto)})
    says = lambda gap: has_text(F.regexp_replace(gap, r"(?s)<\?.*?\?>|<!--.*?-->", ""))
    element = (F.col("name") != "") & ~F.col("is_close") & ((F.col("name") != "section") | (~F.col("is_self") & F.col("opened")))
    own_place = [F.col(c) for c in ("start", "end", "line")]
    gap_place = [(F.col("start") - F.length("gap")).alias("start"), F.col("start").alias("end"), (F.col("line") - count_of(F.col("gap"), "\n")).alias("line")]
    places = F.explode(F.array(F.when(says(F.col("gap")), F.struct(*gap_place)), F.when(element, F.struct(*own_place)))).alias("p")
    found = rows.filter("was = 0").select(id_column, "closed", places).filter("p is not null").select(id_column, "closed", "p.*")
    # What follows the last tag, or is the whole of a text without tags; it meets its text's last tag by the text's id alone.
    cut_up = docs.filter(F.col(text_column).isNotNull()).select(id_column, F.split(text_column, TAG, -1).alias("gaps"), F.length(text_column).cast("long").alias("end"), (count_of(F.col(text_column), "\n") + 1).alias("line"))
    tail = cut_up.withColumn("gap", F.try_element_at("gaps", F.lit(-1))).filter(says(F.col("gap")))
    at = [(F.col("end") - F.length("gap")).alias("start"), "end", (F.col("line") - count_of(F.col("gap"), "\n")).cast("long").alias("line")]
    bare = tail.filter(F.size("gaps") == 1).select(id_column, F.lit(False).alias("closed"), *at)
    last = rows.filter("is_last and depth = 0").select(id_column, F.col("closed_after").alias("closed"))
    found = found.unionByName(bare).unionByName(tail.filter(F.size("gaps") > 1).join(last, id_column).select(id_column, "closed", *at))
    phase = F.when(F.col("closed"), "after").otherwise("before")
    first = found.withColumn("phase", phase).withColumn("nth", F.row_number().over(Window.partitionBy(id_column, "phase").orderBy("start", "end"))).filter("nth = 1")
    return finding(first, id_column, F.lit("section.outside_root"), _says("content {phase} the root section"), None, F.concat(F.lit("move-inside-root-"), "phase"))
