"""Queries over topics with one known fault each, so that what the checkers and repairs must find follows from how a topic is made.

A topic is a section made of an order's lines; its fault is chosen by the order's key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.operators import repairs as RP
from quill.operators import route as RT
from quill.operators.lineage import cut, parts_for
from quill.operators.skeletons import in_texts


@dataclass
class Fault:
    """inside: after the topic's lines; found: (code, where it is first seen); fixes: (label, old, new) replacements that give the repaired text; translated and routed: what the whole check makes of `inside`, and the codes that it then finds, where these differ."""

    inside: str = ""
    found: list[tuple[str, str]] = field(default_factory=list)
    fixes: list[tuple[str, str, str]] = field(default_factory=list)
    before: str = ""
    after: str = ""
    closed: bool = True
    translated: str | None = None
    routed: list[str] | None = None


_TABLE = "<informaltable><tbody>{}</tbody></informaltable>"
_CELL = "<td><para>{}</para></td>"
_BELOW = "Move it below the list"

FAULTS = [
    Fault(),
    Fault("<itemizedlist><listitem><para>a</para></listitem><para>loose</para></itemizedlist>", [("list.misplaced_child", "<para>loose")], [
        ("Make it an item of its own", "<para>loose</para>", "<listitem><para>loose</para></listitem>"),
        ("Move it into the item above", "</listitem><para>loose</para>", "<para>loose</para></listitem>"),
        (_BELOW, "<para>loose</para></itemizedlist>", "</itemizedlist>\n<para>loose</para>"),
    ]),
    Fault("<orderedlist>stray<listitem><para>a</para></listitem></orderedlist>", [("list.text_in_container", "stray")], [("Put it into an item", "stray", "<listitem><para>stray</para></listitem>")]),
    Fault("<orderedlist><listitem></listitem></orderedlist>", [("list.empty_item", "<listitem>")], [("Add an empty paragraph", "<listitem></listitem>", "<listitem>\n  <para></para>\n</listitem>"), ("Delete the empty item", "<listitem></listitem>", "")]),
    Fault(f"<orderedlist><listitem><para>a</para>{_TABLE.format('<tr>' + _CELL.format('x') + '</tr>')}</listitem></orderedlist>", [("list.table_in_item", "<informaltable>")], [
        (_BELOW, f"{_TABLE.format('<tr>' + _CELL.format('x') + '</tr>')}</listitem></orderedlist>", f"</listitem></orderedlist>\n{_TABLE.format('<tr>' + _CELL.format('x') + '</tr>')}"),
    ]),
    Fault("<orderedlist><listitem><para>a</para><listitem><para>b</para></listitem></orderedlist>", [("list.item_unclosed", "<listitem>"), ("tag.unclosed", "<listitem>")]),
    Fault("<orderedlist><listitem><para>a</para></listitem></listitem></orderedlist>", [("list.item_stray_close", "</listitem></orderedlist>"), ("tag.stray_close", "</listitem></orderedlist>")], [("Delete the tag", "</listitem></listitem>", "</listitem>")]),
    Fault("<orderedlist><listitem><para>a</para></listitem>", [("list.unclosed", "<orderedlist>"), ("tag.unclosed", "<orderedlist>")]),
    Fault("<itemizedlist></itemizedlist>", [("list.no_items", "<itemizedlist>")]),
    Fault("<itemizedlist><listitem><para>a</para></listitem><orderedlist><listitem><para>b</para></listitem></orderedlist></itemizedlist>", [("list.sublist", "<orderedlist>")]),
    Fault("<listitem><para>lost</para></listitem>", [("list.item_outside", "<listitem>")]),
    Fault("<informaltable></informaltable>", [("table.no_rows", "<informaltable>")]),
    Fault(_TABLE.format("<tr></tr>"), [("table.row_no_cells", "<informaltable>")]),
    Fault(_TABLE.format(f"<tr>{_CELL.format(1)}</tr><tr>{_CELL.format(2)}{_CELL.format(3)}</tr>"), [("table.ragged", "<informaltable>")]),
    Fault(f'<informaltable><colgroup><col span="2"/><col/></colgroup><tbody><tr>{_CELL.format(1)}</tr></tbody></informaltable>', [("table.colgroup_mismatch", "<informaltable>")]),
    Fault(_TABLE.format(f"<tr>{_CELL.format(1)}<tr>{_CELL.format(2)}</tr>"), [("table.row_unclosed", "<tr>"), ("tag.unclosed", "<tr>")]),
    Fault(_TABLE.format(f"<tr>{_CELL.format(1)}</td></tr>"), [("table.cell_stray_close", "</td></tr>"), ("tag.stray_close", "</td></tr>")], [("Delete the tag", "</td></td>", "</td>")]),
    Fault(_TABLE.format("<tr><th><para>A</para></td></tr>"), [("table.cell_wrong_close", "</td>"), ("tag.unclosed", "<th>"), ("tag.stray_close", "</td>")], [("Delete the tag", "</td>", "")]),
    Fault(_TABLE.format(_CELL.format("x")), [("table.cell_outside_row", "<td>"), ("table.no_rows", "<informaltable>")]),
    Fault(_TABLE.format("<tr><td>bare</td></tr>"), [("table.text_in_cell", "bare")]),
    Fault(_TABLE.format(f"stray<tr>{_CELL.format(1)}</tr>"), [("table.text_in_container", "stray")]),
    Fault(_TABLE.format(f"<note/><tr>{_CELL.format(1)}</tr>"), [("table.misplaced_child", "<note/>")]),
    Fault(f"<informaltable><tbody><tr>{_CELL.format(1)}</tr></tbody>", [("table.unclosed", "<informaltable>"), ("tag.unclosed", "<informaltable>")]),
    Fault("<para>text <orderedlist><listitem><para>x</para></listitem></orderedlist></para>", [("para.misplaced_child", "<orderedlist>")]),
    Fault('<imageobject><imagedata fileref="f"/></imageobject>', [("media.outside", "<imageobject>"), ("media.outside", "<imagedata")], [
        ("Put it into a mediaobject", '<imageobject><imagedata fileref="f"/></imageobject>', '<mediaobject><imageobject><imagedata fileref="f"/></imageobject></mediaobject>'),
    ]),
    Fault(found=[("section.outside_root", "<para>after")], fixes=[("Move it into the section", "</section><para>after</para>", "\n  <para>after</para>\n</section>")], after="<para>after</para>"),
    Fault(found=[("section.outside_root", "<para>before")], before="<para>before</para>"),
    Fault(found=[("section.outside_root", "<?x?>tail")], fixes=[("Move it into the section", "</section><?x?>tail", "\n  <?x?>tail\n</section>")], after="<?x?>tail"),
    Fault(_TABLE.format(f"<tr><td><para>1</para>{_CELL.format(2)}</tr>"), [("table.cell_unclosed", "<td>"), ("tag.unclosed", "<td>")]),
    Fault("<section><title>S</title><para>s</para></section><para>late</para>", [("section.late_content", "<para>late")], [
        ("Move it into the subsection before", "</section><para>late</para>", "  <para>late</para>\n</section>"),
        ("Move it above the subsections", "<section><title>S</title><para>s</para></section><para>late</para>", "<para>late</para>\n<section><title>S</title><para>s</para></section>"),
        ("Put it into a new subsection", "<para>late</para>", "<section><title>Untitled section</title><para>late</para></section>"),
    ]),
    Fault("<para>open", [("tag.unclosed", "<para>open")], [("Close it before the next block", "<para>open", "<para>open</para>")]),
    Fault("<para><para>twice</para>", [("tag.unclosed", "<para><para>"), ("para.misplaced_child", "<para>twice")], [
        ("Delete the opener that is doubled", "<para><para>", "<para>"),
        ("Close it before the next block", "<para><para>", "<para></para><para>"),
    ]),
    Fault("<section><title>S</title><para>s</para></section>", [("tag.unclosed", "<section><title>Order")], [
        ("Close it before the next section", "<section><title>S", "</section><section><title>S"),
        ("Close it at the end", "<para>s</para></section>", "<para>s</para></section></section>"),
    ], closed=False),
    Fault("<ul><li>one<ol><li>two <b>x</b></li></ol></li></ul>", translated='<itemizedlist><listitem><para>one</para><orderedlist><listitem><para>two <emphasis role="strong">x</emphasis></para></listitem></orderedlist></listitem></itemizedlist>'),
    Fault("<ul><li>one</ul>", translated="<itemizedlist><listitem><para>one</para></listitem></itemizedlist>"),
    Fault("<ul><li>a</li><ol><li>b</li></ol></ul>", translated="<itemizedlist><listitem><para>a</para><orderedlist><listitem><para>b</para></listitem></orderedlist></listitem></itemizedlist>"),
    Fault("<ul></ul>", routed=["dialect.list"]),
    Fault('<informaltable><tgroup cols="1"><tbody><row><entry>x</entry></row></tbody></tgroup></informaltable>', [("table.no_rows", "<informaltable>"), ("table.misplaced_child", "<tgroup"), ("table.misplaced_child", "<row>")],
          translated='<informaltable frame="box" rules="all"><tbody><tr><td><para>x</para></td></tr></tbody></informaltable>', routed=[]),
    Fault('<informaltable><tgroup cols="1"><tbody><row><entry namest="a">x</entry></row></tbody></tgroup></informaltable>', [("table.no_rows", "<informaltable>"), ("table.misplaced_child", "<tgroup"), ("table.misplaced_child", "<row>")],
          routed=["dialect.table", "table.no_rows", "table.misplaced_child", "table.misplaced_child"]),
    Fault("<foo>x<bar>"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(values: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {_quoted(v)}" for k, v in enumerate(values) if v) + " ELSE '' END"


_TOPICS_SQL = f"""body AS (SELECT l_orderkey AS doc_id, l_orderkey % {len(FAULTS)} AS k, string_agg('<para>' || l_linenumber || ' of ' || l_partkey || '</para>', '' ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY l_orderkey),
topics AS (SELECT doc_id, k, {_case([f.before for f in FAULTS])} || '<section><title>Order ' || doc_id || '</title>' || b || {_case([f.inside for f in FAULTS])} || CASE WHEN k IN ({", ".join(str(k) for k, f in enumerate(FAULTS) if not f.closed)}) THEN '' ELSE '</section>' END || {_case([f.after for f in FAULTS])} AS text FROM body)"""


def dealt_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """lineitem dealt by order before texts are made of it, as it is then smallest, and to how many parts: tags take many times the room, so Spark must not join parts by the size of the lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = parts_for(spark, lines.count())
    return lines.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey").repartition(parts, "doc_id"), parts


def topics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(doc_id, text) dealt by doc_id, and to how many parts."""
    lines, parts = dealt_lines(spark, sf_dir)
    lines = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("<para>"), x["l_linenumber"], F.lit(" of "), x["l_partkey"], F.lit("</para>"))), "")
    made = spark.createDataFrame([(k, f.before, f.inside, "</section>" * f.closed, f.after) for k, f in enumerate(FAULTS)], "k long, before string, inside string, close string, after string")
    rows = lines.withColumn("k", F.col("doc_id") % len(FAULTS)).join(F.broadcast(made), "k")  # a row a fault
    return rows.select("doc_id", F.concat("before", F.lit("<section><title>Order "), "doc_id", F.lit("</title>"), body, "inside", "close", "after").alias("text")), parts


def _structure_findings(spark, sf_dir):
    """Every finding of the lenient checkers and of the other ones, by code and place."""
    docs, parts = topics(spark, sf_dir)
    shared, _, found = RT.shared_findings(docs, parts=parts)
    return in_texts(shared, found.select("doc_id", "code", "start").distinct(), ["start"], "doc_id").drop("text")


_FOUND = ", ".join(f"({k}, {_quoted(code)}, {_quoted(mark)})" for k, f in enumerate(FAULTS) for code, mark in f.found)
STRUCTURE_SQL = f"WITH {_TOPICS_SQL}, f(k, code, mark) AS (VALUES {_FOUND}) SELECT doc_id, code, CAST(instr(text, mark) - 1 AS BIGINT) AS start FROM topics JOIN f USING (k)"


def _fix_options(spark, sf_dir):
    """Every option of every finding, with the repaired text."""
    docs, parts = topics(spark, sf_dir)
    shared, tags, found = RT.shared_findings(docs, parts=parts)
    findings = cut(RT.dedup_findings(found, parts=shared.parts), "doc_id", shared.parts)
    return RP.suggest_shared(shared, findings, tags).select("doc_id", "label", "new_text")


_FIXES = ", ".join(f"({k}, {_quoted(label)}, {_quoted(old)}, {_quoted(new)})" for k, f in enumerate(FAULTS) for label, old, new in f.fixes)
#: Content before the root goes behind the title, whose text is the order's.
_BEFORE = ", ".join(str(k) for k, f in enumerate(FAULTS) if f.before)
FIX_SQL = f"""WITH {_TOPICS_SQL}, f(k, label, old, new) AS (VALUES {_FIXES}) SELECT doc_id, label, left(text, instr(text, old) - 1) || new || substr(text, instr(text, old) + length(old)) AS new_text FROM topics JOIN f USING (k)
UNION ALL SELECT doc_id, 'Move it into the section', replace(replace(text, '<para>before</para>', ''), '</title>', '</title>' || chr(10) || '<para>before</para>') FROM topics WHERE k IN ({_BEFORE})"""


def _check_route(spark, sf_dir):
    """The whole check, from raw text to the summary."""
    docs, parts = topics(spark, sf_dir)
    done = RT.check(docs, parts=parts)
    return done.summary.join(done.texts, "doc_id").select("doc_id", "n_problems", "summary", "text")


#: What a code counts as in a summary.
_BUCKET = {
    "unclosed tag": ["tag.unclosed", "table.cell_unclosed", "list.unclosed"],
    "extra closing tag": ["tag.stray_close", "list.item_stray_close", "table.cell_stray_close"],
    "misplaced element": ["list.misplaced_child", "list.text_in_container", "list.table_in_item", "list.sublist", "list.item_outside", "table.cell_wrong_close", "table.cell_outside_row", "table.text_in_cell", "table.text_in_container", "table.misplaced_child", "para.misplaced_child", "media.outside", "section.late_content"],
    "missing piece": ["list.empty_item", "list.no_items", "table.no_rows", "table.row_no_cells"],
    "table layout": ["table.ragged", "table.colgroup_mismatch"],
    "other issue": ["list.item_unclosed", "table.row_unclosed", "table.unclosed", "section.outside_root", "dialect.list", "dialect.table"],
}
_ROUTED = [(k, code) for k, f in enumerate(FAULTS) for code in ([c for c, _ in f.found] if f.routed is None else f.routed)]
_TRANSLATED = [(k, f.inside, f.translated) for k, f in enumerate(FAULTS) if f.translated is not None]
_TEXT = "CASE k " + " ".join(f"WHEN {k} THEN replace(text, {_quoted(old)}, {_quoted(new)})" for k, old, new in _TRANSLATED) + " ELSE text END"
_COUNTED = ", ".join(f"({k}, {next(i for i, v in enumerate(_BUCKET.values()) if code in v)}, {_quoted(next(b for b, v in _BUCKET.items() if code in v))})" for k, code in _ROUTED)
ROUTE_SQL = f"""WITH {_TOPICS_SQL}, f(k, rank, bucket) AS (VALUES {_COUNTED}), n AS (SELECT k, rank, bucket, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT k, sum(n) AS n, string_agg(n || ' ' || bucket || CASE WHEN n <> 1 THEN 's' ELSE '' END, ', ' ORDER BY rank) AS parts FROM n GROUP BY k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_problems, CASE WHEN n IS NULL THEN 'No problems found.' ELSE CAST(n AS BIGINT) || ' problem' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ': ' || parts END AS summary,
    {_TEXT} AS text FROM topics LEFT JOIN s USING (k)"""


QUERIES = {"structure_findings": _structure_findings, "fix_options": _fix_options, "check_route": _check_route}
SQL = {"structure_findings": STRUCTURE_SQL, "fix_options": FIX_SQL, "check_route": ROUTE_SQL}
