"""Repairs of findings, as texts put together from slices, and the guard that none may lose a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import TAG, plain_words
from quill.operators.findings import SPEC
from quill.operators.lineage import cut, met_by_text
from quill.operators.skeletons import Shared, in_texts
from quill.operators.tags import matched


def _head(n: Column) -> Column:
    return F.substring(F.col("text"), F.lit(1), n.cast("int"))


def _tail(n: Column) -> Column:
    return F.substring(F.col("text"), n.cast("int") + 1, F.length("text"))


def _cut(start: Column, end: Column) -> Column:
    return F.substring(F.col("text"), start.cast("int") + 1, (end - start).cast("int"))


def _line_before(at: Column) -> Column:
    """What stands on an offset's line before it."""
    return F.substring_index(_head(at), "\n", -1)


def _indent(at: Column) -> Column:
    return F.regexp_extract(_line_before(at), r"\A[ \t]*", 0)


def _whole_lines(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """An element's span with its lines' blanks and line end, and whether nothing but blanks stands before it on its line."""
    before = _line_before(start)
    alone = F.trim(F.replace(before, F.lit("\t"), F.lit(" "))) == ""
    ends_line = _cut(end, end + 1) == "\n"
    return F.when(alone, start - F.length(before)).otherwise(start), F.when(alone & ends_line, end + 1).otherwise(end), alone & ends_line


def _option(label: str, when: Column, cut_from: Column, cut_to: Column, at: Column, inserted: Column) -> Column:
    """A repair is one cut and one insertion outside it or at its place."""
    before = F.concat(_head(at), inserted, _cut(at, cut_from), _tail(cut_to))
    after = F.concat(_head(cut_from), _cut(cut_to, at), inserted, _tail(at))
    text = F.when(at <= cut_from, before).when(at >= cut_to, after)
    return F.when(when, F.struct(F.lit(label).alias("label"), text.alias("new_text")))


def keeps_words(old: Column, new: Column) -> Column:
    """Whether an array of words has all words of another, each as often: in the sorted union of both, with the new ones first, no prefix of equal words has more old ones than new."""
    side = lambda words, k: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(k).alias("k")))
    both = F.array_sort(F.concat(side(new, 0), side(old, 1)))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("left"), F.lit(True).alias("ok"))

    def step(state: Column, x: Column) -> Column:
        left = F.when(state["w"] == x["w"], state["left"]).otherwise(0) + F.when(x["k"] == 0, 1).otherwise(-1)
        return F.struct(x["w"].alias("w"), left.alias("left"), (state["ok"] & (left >= 0)).alias("ok"))

    return F.aggregate(both, start, step)["ok"]


def _loses_no_word(old: Column, new: Column) -> Column:
    """keeps_words(), asked only where words are not all the same, as most repairs add none."""
    return F.when(F.sort_array(old) == F.sort_array(new), True).otherwise(keeps_words(old, new))


def _places(rows: DataFrame, tags: DataFrame, id_column: str, parts: int | None = None) -> DataFrame:
    """Findings with the places that repairs need: the element's end, its list's close, the last item's and section's close before it, the next section and block tag, and the root section."""
    # Texts without a finding to repair are left out before their tags are sorted.
    tags = tags.select(id_column, "start", "end", "name", "is_close", "is_self").join(rows.select(id_column).distinct().hint("shuffle_hash"), id_column, "left_semi")
    # What a finding asks of elements is a row each, so that tags are paired once.
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(id_column).orderBy("start", "end", "code", "fix", "tag", *SPEC)))
    kinds = ("el", "list", "section")
    asked = rows.select(id_column, "_nth", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_start").alias("start")) for k in kinds])).alias("a")).select(id_column, "_nth", "a.*").filter("start is not null")
    told = asked.join(matched(tags, id_column).select(id_column, "start", "p_start", "p_end"), [id_column, "start"])
    told = told.groupBy(id_column, "_nth").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{n}") for k in kinds for n, c in (("close", "p_start"), ("end", "p_end"))])
    rows = rows.join(told, [id_column, "_nth"], "left").drop("_nth")
    rows = cut(rows, id_column, parts) if parts else rows  # so that a task does not hold the sorted tags of both joins
    own = Window.partitionBy(id_column).orderBy("start")
    before, ahead = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    latest = lambda name: F.last(F.when((F.col("name") == name) & F.col("is_close"), F.col("start")), True).over(before)
    following = lambda hit: F.first(F.when(hit, F.struct("start", "name", "is_close", "is_self")), True).over(ahead)
    opens_section = (F.col("name") == "section") & ~F.col("is_close") & ~F.col("is_self")
    around = tags.select(
        id_column, "start", latest("listitem").alias("item_before"), latest("section").alias("section_before"),
        following(opens_section)["start"].alias("next_section"), following(~F.col("name").isin(*BLOCK_INLINE)).alias("block"),
    ).select("*", *[F.col(f"block.{c}").alias(f"block_{c}") for c in ("start", "name", "is_close", "is_self")]).drop("block")
    rows = rows.join(around, [id_column, "start"], "left")
    sections = matched(tags.filter("name = 'section'"), id_column).filter("level is not null")
    first = sections.groupBy(id_column).agg(F.min(F.struct("start", "end", "p_start", "p_end")).alias("r"))
    return rows.join(first.select(id_column, F.col("r.start").alias("root_start"), F.col("r.end").alias("root_open"), F.col("r.p_start").alias("root_close"), F.col("r.p_end").alias("root_end")), id_column, "left")


#: Fixed value: what does not end an unclosed paragraph or title.
BLOCK_INLINE = ["emphasis", "guilabel", "xref", "indexterm", "primary", "secondary"]


def suggest_fixes(docs: DataFrame, findings: DataFrame, tags: DataFrame, id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """A row for each option of a repairable finding: id, code, start, label, new_text. A finding's `fix` names the kind of repair; a kind without options (unwrap-from-para) gives none. Elements that fill their lines are moved with their lines, others as they stand. Options that lose a word of the text are dropped. parts: to how many parts findings and tags are dealt by their text's id, where they are; their places are then told without a shuffle and written once."""
    return _options(_asked(docs, findings, tags, id_column, parts).join(docs.select(id_column, "text"), id_column), id_column)


def suggest_shared(shared: Shared, findings: DataFrame, tags: DataFrame, id_column: str = "doc_id", cut_up: bool = True) -> DataFrame:
    """suggest_fixes() for the findings and tags of skeletons: the places that repairs need are told once for each skeleton, and repairs are made of the texts. cut_up: whether places are written once."""
    rows = _asked(shared.skeletons, findings, tags, id_column, shared.parts if cut_up else None)
    return _options(in_texts(shared, rows, _PLACES, id_column), id_column)


#: What _asked() gives of a finding that is an offset in its text.
_PLACES = ["start", "end", *SPEC, *[f"{k}_{n}" for k in ("el", "list", "section") for n in ("close", "end")], "item_before", "section_before", "next_section", "block_start", "root_start", "root_open", "root_close", "root_end"]


def _asked(docs: DataFrame, findings: DataFrame, tags: DataFrame, id_column: str, parts: int | None) -> DataFrame:
    """Repairable findings with the places that repairs need."""
    rows = findings.filter("fix is not null")
    rows = rows.select(id_column, "start", "end", "tag", "code", "fix", *[F.col(c) if c in findings.columns else F.lit(None).cast("long").alias(c) for c in SPEC])
    if parts:
        with met_by_text(docs.sparkSession):
            return cut(_places(rows, tags, id_column, parts), id_column, parts)
    return _places(rows, tags, id_column)


def _options(rows: DataFrame, id_column: str) -> DataFrame:
    """The options of findings (with their places and text) that lose no word."""
    length, start, end = F.length("text"), F.col("start"), F.col("end")
    is_ = lambda *kinds: F.col("fix").isin(*kinds)
    has = lambda c: F.col(c).isNotNull()
    el_start, el_end = F.col("el_start"), F.coalesce("el_end", length)
    element = _cut(el_start, el_end)
    lines_from, lines_to, lines = _whole_lines(el_start, el_end)
    indent = _indent(el_start)
    nl, two = F.lit("\n"), F.lit("  ")

    def wrapped(name: str, inner: Column) -> Column:
        block = F.concat(indent, F.lit(f"<{name}>\n"), indent, two, inner, nl, indent, F.lit(f"</{name}>\n"))
        return F.when(lines, block).otherwise(F.concat(F.lit(f"<{name}>"), element, F.lit(f"</{name}>")))

    above, item_indent = F.col("item_before"), _indent(F.col("item_before"))
    below = F.concat(nl, _indent(F.col("list_close")), element)
    text = _cut(F.col("text_start"), F.col("text_end"))
    lead, trail = F.length(F.regexp_extract(text, r"(?U)\A\s*", 0)), F.length(F.regexp_extract(text, r"(?U)\s*\z", 0))
    words_from, words_to = F.col("text_start") + lead, F.col("text_end") - trail
    # A run of late content ends before the next section or where its own section closes.
    stop = F.coalesce(F.least(F.col("next_section"), F.coalesce("section_close", length)), F.coalesce("section_close", length))
    run = F.regexp_replace(_cut(el_start, stop), r"\s+\z", "")
    run_from, run_to, run_lines = _whole_lines(el_start, el_start + F.length(run))
    section_indent = _indent(F.col("section_start"))
    new_section = F.concat(section_indent, F.lit("  <section>\n"), section_indent, F.lit("    <title>Untitled section</title>\n"), section_indent, F.lit("    "), run, nl, section_indent, F.lit("  </section>\n"))
    late = is_("content-after-subsection") & has("section_start") & (run != "")
    # A repair of an unclosed tag goes before the blanks in front of the next block.
    before_block = F.length(F.regexp_replace(_head(F.coalesce(F.col("block_start"), length)), r"(?U)\s+\z", ""))
    twice = (F.col("block_name") == F.col("tag")) & ~F.col("block_is_close") & ~F.col("block_is_self") & (F.trim(F.regexp_replace(_cut(end, F.col("block_start")), r"(?U)\s+", "")) == "")
    tag_from, tag_to, _ = _whole_lines(start, end)
    after_opener = end + F.length(F.regexp_extract(_tail(end), r"\A[ \t\n]*", 0))
    close = F.concat(F.lit("</"), "tag", F.lit(">"))
    at_end = F.length(F.regexp_replace("text", r"(?U)\s+\z", ""))
    title = F.length(F.regexp_extract(_tail(F.col("root_open")), r"(?s)\A\s*<title[^>]*>.*?</title>", 0))
    run_before, run_after = (F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "") for c in (_head(F.col("root_start")), _tail(F.col("root_end"))))
    before_close = F.length(F.regexp_replace(_head(F.col("root_close")), r"\s+\z", ""))
    root_indent = _indent(F.col("root_close"))
    loose, table, empty = is_("loose-block-in-list"), is_("table-in-listitem"), is_("empty-listitem")
    blank_from = F.length(F.regexp_replace(_head(F.col("el_close")), r"\s+\z", ""))
    options = [
        _option("Make it an item of its own", loose, lines_from, lines_to, lines_from, wrapped("listitem", element)),
        _option("Move it into the item above", loose & (above > F.col("list_start")), lines_from, lines_to, above, F.when(lines, F.concat(two, element, nl, item_indent)).otherwise(element)),
        _option("Move it below the list", (loose | table) & has("list_end"), lines_from, lines_to, F.col("list_end"), below),
        _option("Delete the tag", is_("delete-stray-close"), tag_from, tag_to, tag_from, F.lit("")),
        _option("Add an empty paragraph", empty & has("el_close"), blank_from, F.col("el_close"), blank_from, F.concat(nl, indent, F.lit("  <para></para>\n"), indent)),
        _option("Delete the empty item", empty, lines_from, lines_to, lines_from, F.lit("")),
        _option("Put it into a mediaobject", is_("wrap-in-mediaobject"), lines_from, lines_to, lines_from, wrapped("mediaobject", F.replace(element, nl, F.lit("\n  ")))),
        _option("Put it into an item", is_("bare-text-in-list") & (words_to > words_from), words_from, words_to, words_from, F.concat(F.lit("<listitem><para>"), _cut(words_from, words_to), F.lit("</para></listitem>"))),
        _option("Move it into the subsection before", late & (F.col("section_before") > F.col("section_start")), run_from, run_to, F.col("section_before"), F.concat(two, run, nl, _indent(F.col("section_before")))),
        _option("Move it above the subsections", late & (F.col("first_sub") < el_start), run_from, run_to, F.col("first_sub"), F.concat(run, nl, _indent(F.col("first_sub")))),
        _option("Put it into a new subsection", late, run_from, run_to, run_from, F.when(run_lines, new_section).otherwise(F.concat(F.lit("<section><title>Untitled section</title>"), run, F.lit("</section>")))),
        _option("Delete the opener that is doubled", is_("insert-close") & twice, tag_from, after_opener, tag_from, F.lit("")),
        _option("Close it before the next block", is_("insert-close"), before_block, before_block, before_block, close),
        _option("Move it into the section", is_("move-inside-root-before") & has("root_start") & (run_before != ""), F.lit(0), F.col("root_start"), F.col("root_open") + title, F.concat(nl, _indent(F.col("root_open")), run_before)),
        _option("Move it into the section", is_("move-inside-root-after") & has("root_close") & (run_after != ""), F.col("root_end"), length, before_close, F.concat(nl, root_indent, two, run_after, nl, root_indent)),
        _option("Close it at the end", is_("close-section"), at_end, at_end, at_end, close),
        _option("Close it before the next section", is_("close-section") & has("next_section"), F.col("next_section"), F.col("next_section"), F.col("next_section"), close),
    ]
    made = rows.select(id_column, "code", "start", "text", F.explode(F.array_compact(F.array(*options))).alias("o"))
    kept = made.filter(_loses_no_word(plain_words(F.col("text")), plain_words(F.col("o.new_text"))))
    return kept.select(id_column, "code", "start", F.col("o.label").alias("label"), F.col("o.new_text").alias("new_text"))


def splice(docs: DataFrame, edits: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with the spans of edits (id, start, end, new) replaced; spans do not overlap. The pieces between the spans and the new parts are joined once."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "new")))
    per_doc = edits.groupBy(id_column).agg(ordered.alias("_edits"))
    text = F.col(text_column)
    piece = lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int"))
    stop = lambda i: F.when(i > 0, F.get("_edits", i - 1)["end"]).otherwise(0)
    parts = F.transform("_edits", lambda e, i: F.concat(piece(stop(i), e["start"]), e["new"]))
    rest = piece(F.element_at("_edits", -1)["end"], F.length(text))
    rows = docs.join(per_doc, id_column, "left")
    return rows.withColumn(text_column, F.when(F.col("_edits").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))).drop("_edits")


def strip_xinfo(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Texts without the xinfo attributes of their tags, but for those of the first section opener. A tag that loses one is written anew, its name in lower case; other tags, and text between tags, stay as they are. The text is cut into tags and the gaps before them, which are put together again."""
    text = F.col(text_column)
    attribute = r"""(?U)\s+xinfo:[A-Za-z0-9_.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""
    tags, gaps = F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.split(text, TAG, -1)
    part = lambda t, k: F.regexp_extract(t, TAG, k)
    # Most tags are told by a plain search, so that few are matched again, and these once for each part.
    is_root = F.transform("_tags", lambda t: F.lower(t).contains("section") & (F.lower(part(t, 2)) == "section") & (part(t, 1) == "") & (part(t, 4) == ""))
    rows = docs.withColumns({"_tags": tags, "_gaps": gaps}).withColumn("_root", F.array_position(is_root, True) - 1)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def clean(t: Column, i: Column) -> Column:
        anew = lambda attrs: F.concat(F.lit("<"), part(t, 1), F.lower(part(t, 2)), attrs, part(t, 4), F.lit(">"))
        changed = lambda given: once(F.regexp_replace(given, attribute, ""), lambda attrs: F.when(attrs != given, anew(attrs)).otherwise(t))
        return F.when(t.contains("xinfo:") & (i != F.coalesce(F.col("_root"), F.lit(-1))), once(part(t, 3), changed)).otherwise(t)

    pieces = F.zip_with("_gaps", F.transform("_tags", clean), lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return rows.withColumn(text_column, F.array_join(pieces, "")).drop("_tags", "_gaps", "_root")
