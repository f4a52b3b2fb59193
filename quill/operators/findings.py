"""Findings of several checkers: duplicates, order, summaries and the report by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import escape_html

#: summary bucket -> the codes it counts, in the order of the summary. All other codes (unclosed tables, rows, lists and items, several titles, self-closed media and items, content outside the root, failed translations) are other issues.
BUCKETS = {
    "unclosed tag": ["tag.unclosed", "table.cell_unclosed", "table.row_cell_unclosed", "list.unclosed"],
    "extra closing tag": ["tag.stray_close", "table.stray_close", "table.row_stray_close", "table.cell_stray_close", "media.stray_close", "list.stray_close", "list.item_stray_close"],
    "misplaced element": [
        "table.text_in_container", "table.text_in_cell", "table.misplaced_child", "table.cell_wrong_close", "table.cell_outside_row",
        "list.text_in_container", "list.misplaced_child", "list.sublist", "list.table_in_item", "list.item_outside",
        "para.misplaced_child", "section.late_content", "section.title_not_first", "media.outside",
    ],
    "missing piece": ["table.no_rows", "table.row_no_cells", "media.no_imageobject", "media.no_imagedata", "media.no_fileref", "section.no_title", "list.no_items", "list.empty_item"],
    "table layout": ["table.ragged", "table.colgroup_mismatch"],
}
OTHER = "other issue"

#: What a repair needs to know of a finding; each field is null where it says nothing.
SPEC = ["el_start", "list_start", "text_start", "text_end", "section_start", "first_sub"]


def finding(rows: DataFrame, id_column: str, code: Column, message: Column, tag: Column | None = None, fix: Column | None = None, **spec: Column) -> DataFrame:
    """id, line, start, end, tag, code, message, fix and SPEC of rows (line, start, and end if they have one)."""
    null = lambda t: F.lit(None).cast(t)
    given = [spec.get(c, null("long")).cast("long").alias(c) for c in SPEC]
    return rows.select(
        id_column, F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), (F.col("end") if "end" in rows.columns else F.lit(None)).cast("long").alias("end"),
        (null("string") if tag is None else tag).alias("tag"), code.alias("code"), message.alias("message"), (null("string") if fix is None else fix).alias("fix"), *given,
    )


def bucket(code):
    out = F
    for name, codes in BUCKETS.items():
        out = out.when(code.isin(codes), name)
    return out.otherwise(OTHER)


def dedup_findings(findings: DataFrame, id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Of findings that agree in line, message and tag the first by (checker, start); `place` is the order in the report: line, start, and the order before. parts: to how many parts they are dealt by their text's id, once for both."""
    findings = findings.repartition(parts, id_column) if parts else findings
    line, start = F.coalesce("line", F.lit(0)), F.coalesce("start", F.lit(0))
    same = Window.partitionBy(id_column, line, "message", "tag").orderBy("checker", start)
    kept = findings.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(id_column).orderBy(line, start, "checker")))


def summarize(findings: DataFrame, docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A line for each document: how many problems, and how many of each bucket, in the buckets' order."""
    names = [*BUCKETS, OTHER]
    counts = findings.select(id_column, bucket(F.col("code")).alias("bucket")).groupBy(id_column, "bucket").agg(F.count("*").alias("n"))
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(" "), word, F.when(n != 1, "s").otherwise(""))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("bucket"))
    parts = counts.groupBy(id_column).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(rank.alias("rank"), plural(F.col("n"), F.col("bucket")).alias("part")))).alias("parts"))
    said = F.concat(plural(F.col("n"), F.lit("problem")), F.lit(": "), F.array_join(F.transform("parts", lambda p: p["part"]), ", "))
    return docs.select(id_column).join(parts, id_column, "left").select(id_column, F.coalesce("n", F.lit(0)).alias("n_problems"), F.coalesce(said, F.lit("No problems found.")).alias("summary"))


def report_lines(docs: DataFrame, findings: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each line of a text: num, line_text, html and the messages on it in the findings' order; lines beyond the text count as its last, lines below 1 as its first. In html the line is escaped, and what a finding names is marked: its exact span, or else the first tag of its name on the line. Spans that overlap are cut from left to right."""
    lines = docs.select(id_column, F.posexplode(F.split(F.coalesce(text_column, F.lit("")), "\n")).alias("i", "line_text")).withColumn("num", F.col("i") + 1)
    own = Window.partitionBy(id_column).orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce(F.sum(F.length("line_text") + 1).over(own), F.lit(0)))
    most = lines.groupBy(id_column).agg(F.max("num").alias("most"))
    at = [c if c in findings.columns else F.lit(None).cast("string" if c == "tag" else "long").alias(c) for c in ("line", "start", "end", "tag", "message")]
    noted = findings.select(id_column, *at).join(most, id_column).withColumn("num", F.greatest(F.lit(1), F.least(F.coalesce("line", F.lit(1)), "most")))
    order = F.struct(F.coalesce("line", F.lit(0)).alias("l"), F.coalesce("start", F.lit(0)).alias("s"), "message", "start", "end", "tag")
    notes = noted.groupBy(id_column, "num").agg(F.array_sort(F.collect_list(order)).alias("notes"))
    rows = lines.join(notes, [id_column, "num"], "left")
    rows = rows.withColumn("spans", F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform("notes", _span_on_line), lambda s: s.isNotNull()))), F.array().cast("array<struct<from:bigint,to:bigint>>")))
    return rows.select(id_column, "num", "line_text", _marked(F.col("line_text"), F.col("spans")).alias("html"), F.coalesce(F.transform("notes", lambda n: n["message"]), F.array().cast("array<string>")).alias("notes"))


def _span_on_line(note: Column) -> Column:
    line = F.col("line_text")
    exact = F.struct((note["start"] - F.col("base")).cast("long").alias("from"), (note["end"] - F.col("base")).cast("long").alias("to"))
    tag = F.regexp_substr(line, F.concat(F.lit(r"</?\Q"), note["tag"], F.lit(r"\E(?:\s[^<>]*)?/?>")))
    first = F.instr(line, tag) - 1
    named = F.struct(first.cast("long").alias("from"), (first + F.length(tag)).cast("long").alias("to"))
    return F.when(note["start"].isNotNull() & note["end"].isNotNull(), exact).when(tag.isNotNull(), named)


def _marked(line: Column, spans: Column) -> Column:
    part = lambda a, b: F.substring(line, a.cast("int") + 1, (b - a).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("html"))

    def step(state: Column, span: Column) -> Column:
        a, b = F.greatest(span["from"], state["at"]), F.least(span["to"], F.length(line).cast("long"))
        marked = F.concat(state["html"], escape_html(part(state["at"], a)), F.lit('<span class="bad">'), escape_html(part(a, b)), F.lit("</span>"))
        return F.when(b > a, F.struct(b.alias("at"), marked.alias("html"))).otherwise(state)

    done = F.aggregate(spans, start, step)
    return F.concat(done["html"], escape_html(part(done["at"], F.length(line))))
