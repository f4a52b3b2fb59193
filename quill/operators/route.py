"""The whole check of markup texts: cleaned, translated, judged by every checker, with repairs, a summary and a report by line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import line_of
from quill.operators.findings import SPEC, dedup_findings, finding, report_lines, summarize
from quill.operators.lineage import cut, parts_for
from quill.operators.repairs import splice, strip_xinfo, suggest_shared
from quill.operators.sections import check_media, check_sections
from quill.operators.skeletons import Shared, in_texts, share
from quill.operators.structure import TABLES, check_lists, check_outside_root, check_paragraphs, check_tables, frames, nested
from quill.operators.tags import VOCABULARY, known_tags, outer_spans, tag_stream, translate_inline, unbalanced_tags
from quill.operators.trees import convert_lists, convert_tables


@dataclass(frozen=True)
class Checked:
    """texts: as they were judged; findings: without duplicates, by `place`; fixes, summary and lines of them."""

    texts: DataFrame
    findings: DataFrame
    fixes: DataFrame
    summary: DataFrame
    lines: DataFrame


def _converted(texts: DataFrame, made: DataFrame, id_column: str, code: str, says: str) -> tuple[DataFrame, DataFrame]:
    """Texts with what was made of some spans (start, end, xml, problem), and findings, at their places in the new texts, for those that stay as they are."""
    good = made.filter("xml is not null").select(id_column, "start", "end", F.col("xml").alias("new"))
    out = splice(texts, good, id_column)
    # Lines and offsets are those of the translated text, which the spans before one have changed.
    shift = F.when(F.col("xml").isNotNull(), F.length("xml") - (F.col("end") - F.col("start"))).otherwise(0)
    before = Window.partitionBy(id_column).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = made.withColumn("moved", F.coalesce(F.sum(shift).over(before), F.lit(0))).filter("xml is null")
    bad = moved.join(out.select(id_column, "text"), id_column).select(id_column, (F.col("start") + F.col("moved")).alias("start"), (F.col("end") + F.col("moved")).alias("end"), "problem", "text")
    bad = bad.withColumn("line", line_of(F.col("text"), F.col("start").cast("int")))
    return out, finding(bad, id_column, F.lit(code), F.concat(F.lit(f"{says} cannot be translated: "), "problem"))


def translate(docs: DataFrame, id_column: str = "doc_id", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts with bold and italic tags, foreign lists and tables of rows and entries translated, and findings for the lists and tables that cannot be, which stay as they are. A table is foreign if it holds a tgroup. A list's place counts in the text in which lists are translated, a table's in the result."""
    inline = cut(translate_inline(docs), id_column, parts)
    # Only texts that name what can be translated are cut into tags.
    listed = inline.filter(F.col("text").rlike(r"(?iU)<\s*[uo]l"))
    lists = cut(convert_lists(listed, outer_spans(tag_stream(listed, id_column), ["ul", "ol"], id_column), id_column))
    texts, bad_lists = _converted(inline, lists, id_column, "dialect.list", "this list")
    texts = cut(texts, id_column, parts)
    grouped = texts.filter(F.col("text").rlike("(?i)tgroup"))
    tags = cut(tag_stream(grouped, id_column).drop("gap"), id_column, parts)
    groups = tags.filter("name = 'tgroup' and not is_close").select(id_column, F.col("start").alias("at"))
    foreign = outer_spans(tags, list(TABLES), id_column).join(groups, id_column).filter("at > start and at < end").select(id_column, "start", "end").distinct()
    tables = cut(convert_tables(grouped, foreign, id_column))
    out, bad_tables = _converted(texts, tables, id_column, "dialect.table", "this table")
    return out, bad_lists.unionByName(bad_tables)


#: The columns of a tag stream beside the text's id.
PLAIN = ["seq", "start", "end", "line", "name", "attrs", "is_close", "is_self", "gap"]


def nested_once(tags: DataFrame, id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """nested() tags, written once and bucketed by text: all that checkers and repairs read of tags."""
    return cut(nested(tags, id_column), id_column, parts)


def all_findings(texts: DataFrame, tags: DataFrame, id_column: str = "doc_id", vocabulary: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The findings of all checkers, numbered in the order in which duplicates are judged. Closing tags are checked for the names of the vocabulary (name), or of tags.VOCABULARY. Every checker reads the nested tags, which are written once, bucketed by text; tags that come as nested_once() wrote them are not written again. parts: to how many parts texts and tags are dealt by their id."""
    rows = tags if "plain_top" in tags.columns else nested_once(tags, id_column, parts)
    tags = rows.select(id_column, *PLAIN)
    framed = cut(frames(rows, id_column), id_column, parts)
    known = tags.filter(F.col("name").isin(VOCABULARY)) if vocabulary is None else known_tags(tags, vocabulary)
    sections = check_sections(tags, id_column).unionByName(check_outside_root(tags, texts, id_column))
    checks = [unbalanced_tags(known, id_column), check_tables(rows, framed, id_column), check_lists(rows, framed, id_column), check_media(tags, id_column), sections, check_paragraphs(rows, id_column)]
    out = None
    for k, found in enumerate(checks, 1):
        found = found.withColumn("checker", F.lit(k))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


#: The offsets of a finding.
PLACES = ["start", "end", *SPEC]


def shared_findings(docs: DataFrame, id_column: str = "doc_id", vocabulary: DataFrame | None = None, parts: int | None = None) -> tuple[Shared, DataFrame, DataFrame]:
    """Texts (id, text) that are dealt by their id to `parts`, with their skeletons; the nested tags of skeletons; and all_findings() of skeletons. As checkers ask of text between tags only whether there is any and on which lines, these are the findings of every text with the skeleton, at other offsets (skeletons.in_texts)."""
    shared = share(docs, id_column, parts or parts_for(docs.sparkSession, 0))
    tags = nested_once(tag_stream(shared.skeletons, id_column), id_column, shared.parts)
    return shared, tags, all_findings(shared.skeletons, tags, id_column, vocabulary, shared.parts)


def check(docs: DataFrame, id_column: str = "doc_id", vocabulary: DataFrame | None = None, parts: int | None = None) -> Checked:
    """Every stage over (id, text): line ends, xinfo attributes, translation, all checkers, duplicates, repairs, summary, report. Texts are dealt by their id once, to `parts` (the session's shuffle partitions), and stay so."""
    parts = parts or parts_for(docs.sparkSession, 0)
    plain = docs.select(id_column, F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    texts, problems = translate(strip_xinfo(plain), id_column, parts)
    shared, tags, found = shared_findings(texts, id_column, vocabulary, parts)
    texts = shared.texts.select(id_column, "text")
    found = cut(dedup_findings(found, id_column, shared.parts), id_column, shared.parts)
    placed = in_texts(shared, found.drop("place"), PLACES, id_column).drop("text")
    findings = cut(dedup_findings(problems.withColumn("checker", F.lit(0)).unionByName(placed, allowMissingColumns=True), id_column, parts), id_column, parts)
    fixes = suggest_shared(shared, found, tags, id_column, cut_up=False)  # problems have no repairs
    return Checked(texts, findings, fixes, summarize(findings, texts, id_column), report_lines(texts, findings, id_column))
