"""Foreign lists, tables and paragraphs in markup texts, brought to one form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions.text import squash, strip, strip_envelope
from quill.operators.lineage import cut, parts_for
from quill.operators.repairs import splice
from quill.operators.skeletons import form, meet, numbered, parts_of, words_put_in
from quill.operators.tags import outer_spans, tag_stream, translate_inline
from quill.operators.trees import convert_lists, convert_tables


def normalize(docs: DataFrame, id_column: str = "doc_id", parts: int | None = None) -> DataFrame:
    """id, output, changed, diagnostic of (id, text): the text without its envelope, with foreign lists, tables and p elements converted. What was done is counted; a text that is empty, has no tags or needs nothing says so, and comes back as it is. Conversions treat words as a whole, so each form of texts (skeletons.form) is converted once and a text's own words are put in. Texts are written once, forms and the spans of lists and tables in them are written bucketed by the form's id; parts: to how many parts texts are dealt."""
    parts = parts or parts_for(docs.sparkSession, 0)
    source = docs.select(id_column, F.coalesce("text", F.lit("")).alias("source")).withColumn("text", strip_envelope(F.col("source")))
    texts = cut(source.withColumn("form", form(F.col("text"))))
    kinds = cut(texts.select("form").distinct().select(F.monotonically_increasing_id().alias(id_column), F.col("form").alias("source")))
    kept = parts_of(kinds, texts, parts)
    forms = cut(kinds.repartition(kept, id_column).withColumn("text", numbered(F.col("source"))), id_column, kept)
    made = _converted(forms, id_column, kept).select(F.col("source").alias("form"), F.col("text").alias("made"), "did", (squash(F.col("text")) != squash(F.col("given"))).alias("differs"))
    cut_up, whole = words_put_in(F.col("form"), F.col("made"), F.col("text"))
    known = cut(made.select("form", F.when(F.col("differs"), cut_up).alias("cut_up"), "did"))
    rows = meet(texts, known, "form", F.octet_length("form") + F.coalesce(F.size("cut_up"), F.lit(0)) * 64 + 64).withColumn("made", F.when(F.col("cut_up").isNotNull(), whole))
    changed = F.col("made").isNotNull() & (squash(F.col("made")) != squash(F.col("text")))
    says = (
        F.when(strip(F.col("source")) == "", "Nothing to normalize.")
        .when(~F.col("source").rlike(r"<\s*/?\s*[A-Za-z]"), "No tags found.")
        .when(~changed, "Nothing to change.")
        .otherwise(F.concat(F.lit("Normalized "), F.when(F.col("did") != "", F.col("did")).otherwise("inline markup"), F.lit(".")))
    )
    rows = rows.withColumn("says", says)
    done = F.col("says").startswith("Normalized")
    return rows.select(id_column, F.when(done, F.col("made")).otherwise(F.col("source")).alias("output"), done.alias("changed"), F.col("says").alias("diagnostic"))


def _converted(source: DataFrame, id_column: str, parts: int) -> DataFrame:
    """Texts (id, source, text, bucketed by id) with lists, tables, p elements and inline markup converted, the text as `given`, and what was done to it."""
    # Only texts that name a list or a table are cut into tags. Lists inside tables and tables inside lists belong to what is around them.
    tags = tag_stream(source.filter(F.col("text").rlike(r"(?iU)<\s*(?:[uo]l|itemizedlist|orderedlist|table|informaltable)")), id_column)
    named = cut(outer_spans(tags, ["ul", "ol", "itemizedlist", "orderedlist", "table", "informaltable"], id_column, named=True), id_column, parts)
    is_list = F.col("name").isin("ul", "ol", "itemizedlist", "orderedlist")
    lists = convert_lists(source, named.filter(is_list).drop("name"), id_column).withColumn("kind", F.lit("list"))
    tables = convert_tables(source, named.filter(~is_list).drop("name"), id_column).withColumn("kind", F.lit("table"))
    found = lists.unionByName(tables).filter("xml is not null")
    counts = found.groupBy(id_column).agg(F.count_if(F.col("kind") == "list").alias("lists"), F.count_if(F.col("kind") == "table").alias("tables"))
    rows = splice(source.withColumn("given", F.col("text")), found.select(id_column, "start", "end", F.col("xml").alias("new")), id_column).join(counts, id_column, "left")
    p = r"(?iU)<\s*p(?![\w.-])[^<>/]*>"
    rows = rows.withColumn("paragraphs", F.regexp_count("text", F.lit(p)))
    rows = translate_inline(rows.withColumn("text", F.regexp_replace(F.regexp_replace("text", p, "<para>"), r"(?iU)<\s*/\s*p\s*>", "</para>")))
    part = lambda c, name: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}(s)")))
    did = F.concat_ws(" and ", part("lists", "list"), part("tables", "table"), part("paragraphs", "paragraph"))
    return rows.withColumn("did", did)
