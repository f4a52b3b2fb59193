"""Queries over fragments made from orders, whose results follow from how they are made: {n} stands for the order's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.operators import extract as EX
from quill.operators import normalize as NO
from quill.operators.lineage import cut, parts_for
from quill.plans.faults import _quoted, dealt_lines

_OPEN, _CLOSE = '<informaltable frame="box" rules="all">', "</informaltable>"
_LIST = "<itemizedlist><listitem><para>{n}</para></listitem></itemizedlist>"

#: (source, output or None where it stays, diagnostic)
SOURCES = [
    ("", None, "Nothing to normalize."),
    ("just {n}", None, "No tags found."),
    ("<para>{n}</para>", None, "Nothing to change."),
    ("<ul><li>{n}</li></ul>", _LIST, "Normalized 1 list(s)."),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>{n}</td><td colspan='2'>x <b>y</b><br>z</td></tr><tr><td></td><td> </td></tr></table>",
     f'{_OPEN}<thead><tr><th><para>A</para></th><th><para>B</para></th></tr></thead><tbody><tr><td><para>{{n}}</para></td><td colspan="2"><para>x y z</para></td></tr><tr><td><para></para></td><td><para></para></td></tr></tbody>{_CLOSE}', "Normalized 1 table(s)."),
    ('<table><title>T {n}</title><tgroup cols="2"><colspec colname="a"/><thead><row><entry>H</entry></row></thead><tbody><row><entry>{n} &amp; co</entry></row></tbody></tgroup></table>',
     f"<para>T {{n}}</para>{_OPEN}<thead><tr><th><para>H</para></th></tr></thead><tbody><tr><td><para>{{n}} &amp; co</para></td></tr></tbody>{_CLOSE}", "Normalized 1 table(s)."),
    ('<table><tgroup><tbody><row><entry namest="a" nameend="b">{n}</entry></row></tbody></tgroup></table>', None, "Nothing to change."),
    ("```html\n<p>{n}</p><p>b</p>\n```", "<para>{n}</para><para>b</para>", "Normalized 2 paragraph(s)."),
    ("<p>a {n}</p>\n<ol><li>b</li></ol>", "<para>a {n}</para>\n<orderedlist><listitem><para>b</para></listitem></orderedlist>", "Normalized 1 list(s) and 1 paragraph(s)."),
    ("<b>{n}</b>", '<emphasis role="strong">{n}</emphasis>', "Normalized inline markup."),
    ("<table><tr><td><table><tr><td>{n}</td></tr></table></td></tr></table>", None, "Nothing to change."),
    ("<table><tr><td><ul><li>{n}</li></ul></td></tr></table>", f"{_OPEN}<tbody><tr><td><para>{{n}}</para></td></tr></tbody>{_CLOSE}", "Normalized 1 table(s)."),
    ("<table><thead><tr><td>H</td></tr></thead><tfoot><tr><td>F</td></tr></tfoot><tbody><tr><td>{n}</td></tr></tbody></table>", f"{_OPEN}<thead><tr><th><para>H</para></th></tr></thead><tbody><tr><td><para>{{n}}</para></td></tr><tr><td><para>F</para></td></tr></tbody>{_CLOSE}", "Normalized 1 table(s)."),
    ("<ul><li>a</li><ul><li>{n}</li></ul><li>b < c</li></ul>", "<itemizedlist><listitem><para>a</para>" + _LIST + "</listitem><listitem><para>b &lt; c</para></listitem></itemizedlist>", "Normalized 1 list(s)."),
    ("<ol numeration='loweralpha'><ul><li>{n}</li></ul><li>c</ol>", '<orderedlist numeration="loweralpha"><listitem><para></para>' + _LIST + "</listitem><listitem><para>c</para></listitem></orderedlist>", "Normalized 1 list(s)."),
    ("<itemizedlist><listitem>{n}</listitem></itemizedlist>", _LIST, "Normalized 1 list(s)."),
    ("<?xml version='1.0'?><ul><li>{n}<table><tr><td>x</td></tr></table></li></ul>", None, "Nothing to change."),
]


def _numbered(text: str) -> Column:
    return F.replace(text, F.lit("{n}"), F.col("doc_id").cast("string"))


def _orders(spark: SparkSession, sf_dir: str, kinds: int) -> DataFrame:
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("doc_id"), (key % kinds).alias("k"))


def _normalize(spark, sf_dir):
    made = spark.createDataFrame([(k, s) for k, (s, _, _) in enumerate(SOURCES)], "k long, text string")
    orders = _orders(spark, sf_dir, len(SOURCES))
    parts = parts_for(spark, orders.count())
    # Keys are dealt before texts are made of them: a scan of keys alone is a few tasks, whatever comes of it.
    docs = orders.repartition(parts, "doc_id").join(F.broadcast(made), "k").select("doc_id", _numbered("text").alias("text"))  # a row a kind
    return NO.normalize(docs, parts=parts)


_SOURCES_SQL = ", ".join(f"({k}, {_quoted(out if out is not None else s)}, {str(out is not None).lower()}, {_quoted(d)})" for k, (s, out, d) in enumerate(SOURCES))
NORMALIZE_SQL = f"WITH f(k, t, changed, diagnostic) AS (VALUES {_SOURCES_SQL}) SELECT o_orderkey AS doc_id, replace(t, '{{n}}', CAST(o_orderkey AS VARCHAR)) AS output, changed, diagnostic FROM orders JOIN f ON k = o_orderkey % {len(SOURCES)}"

#: kind -> spans (line, block, y0, text, bold, italic), the fragment, how many items, whether it needs reading
REGIONS = [
    ("paragraph", [(0, 0, 0, "Hello {n} exam-", 0, 0), (1, 0, 10, "ple <text>.", 0, 0)], "<para>Hello {n} example &lt;text&gt;.</para>", 1, False),
    ("paragraph", [(0, 0, 0, "Bold", 1, 0), (1, 0, 10, "goes {n}", 1, 0), (1, 0, 10, " on", 0, 1)], '<para><emphasis role="strong">Bold goes {n}</emphasis> <emphasis>on</emphasis></para>', 1, False),
    ("paragraph", [(0, 0, 0, "One {n}.", 0, 0), (1, 0, 40, "Two", 0, 1), (2, 0, 50, "plain", 0, 0)], "<para>One {n}.</para>\n<para><emphasis>Two</emphasis> plain</para>", 2, False),
    ("list", [(0, 0, 0, "intro", 0, 0), (1, 0, 10, "1.) first {n}", 0, 0), (2, 0, 20, "goes on", 0, 0), (3, 0, 30, "2.) ", 0, 0), (3, 0, 30, "second", 1, 0), (4, 0, 40, "3.)", 0, 0)],
     '<orderedlist>\n<listitem><para>first {n} goes on</para></listitem>\n<listitem><para><emphasis role="strong">second</emphasis></para></listitem>\n</orderedlist>', 2, False),
    ("list", [(0, 0, 0, "• a", 0, 0), (1, 0, 10, "1. {n}", 0, 0), (2, 0, 900, "outside", 0, 0)], "<itemizedlist>\n<listitem><para>a</para></listitem>\n<listitem><para>{n}</para></listitem>\n</itemizedlist>", 2, False),
    ("table", [(0, 0, 900, "outside {n}", 0, 0)], None, 0, True),
    ("table", [(0, 0, 0, "cell {n}", 0, 0)], f"{_OPEN}<tbody><tr><td><para>cell {{n}}</para></td></tr></tbody>{_CLOSE}", 0, False),
]


def _extract(spark, sf_dir):
    spans = [(k, line, i, block, float(y), float(y) + 9, text, bool(b), bool(it)) for k, (_, rows, _, _, _) in enumerate(REGIONS) for i, (line, block, y, text, b, it) in enumerate(rows)]
    made = spark.createDataFrame(spans, "k long, line long, span long, block long, y0 double, y1 double, text string, bold boolean, italic boolean")
    kinds = spark.createDataFrame([(k, r[0]) for k, r in enumerate(REGIONS)], "k long, kind string")
    orders = _orders(spark, sf_dir, len(REGIONS))
    placed = orders.join(F.broadcast(made), "k").withColumns({"text": _numbered("text"), "x0": F.lit(10.0), "x1": F.lit(90.0), "dir_x": F.lit(1.0), "dir_y": F.lit(0.0)})  # a row a span
    requests = orders.join(F.broadcast(kinds), "k").select("doc_id", "kind", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(500.0).alias("y1"))
    return EX.extract_regions(requests, placed.drop("k"), images=orders.select("doc_id")).withColumn("n_items", F.col("n_items").cast("long"))


_REGIONS_SQL = ", ".join(f"({k}, {_quoted(kind)}, {'NULL' if xml is None else _quoted(xml)}, {n}, {str(reads).lower()})" for k, (kind, _, xml, n, reads) in enumerate(REGIONS))
EXTRACT_SQL = f"WITH f(k, kind, t, n_items, needs_reading) AS (VALUES {_REGIONS_SQL}) SELECT o_orderkey AS doc_id, kind, replace(t, '{{n}}', CAST(o_orderkey AS VARCHAR)) AS xml, CAST(n_items AS BIGINT) AS n_items, needs_reading FROM orders JOIN f ON k = o_orderkey % {len(REGIONS)}"


def _table_fragments(spark, sf_dir):
    """Each order is a table region: a grid of its lines by three columns, of which the last is empty for every fifth line, with two lines of text in the middle one; every third order's first row is bold."""
    order = Window.partitionBy("doc_id").orderBy("l_linenumber")
    lines, parts = dealt_lines(spark, sf_dir)
    rows = lines.groupBy("doc_id", "l_linenumber").agg(F.min("l_partkey").alias("part")).select("doc_id", (F.row_number().over(order) - 1).alias("row"), "part")
    rows = cut(rows, "doc_id", parts)  # cells, spans and requests are made of it where it lies
    top = F.col("row") * 30.0
    box = lambda col: F.struct("row", F.lit(col).alias("col"), F.lit(100.0 * col).alias("cx0"), top.alias("cy0"), F.lit(100.0 * col + 100).alias("cx1"), (top + 30).alias("cy1"))
    cells = rows.select("doc_id", F.explode(F.array(*map(box, range(3)))).alias("c")).select("doc_id", "c.*")
    said = lambda n, col, y, text: F.struct((F.col("row") * 4 + n).alias("line"), F.lit(0).alias("span"), F.lit(0).alias("block"), (top + y).alias("y0"), (top + y + 8).alias("y1"), F.lit(100.0 * col + 5).alias("x0"), F.lit(100.0 * col + 95).alias("x1"), text.alias("text"))
    part = F.col("part").cast("string")
    texts = F.array(said(0, 0, 2, part), said(1, 1, 2, F.concat(F.lit("a & "), part)), said(2, 1, 14, F.lit("b")), F.when(F.col("part") % 5 != 0, said(3, 2, 2, F.lit("z"))))
    bold = (F.col("doc_id") % 3 == 0) & (F.col("row") == 0)
    spans = rows.select("doc_id", bold.alias("bold"), F.explode(F.array_compact(texts)).alias("s")).select("doc_id", "s.*", "bold", F.lit(False).alias("italic"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))
    requests = rows.groupBy("doc_id").agg(F.lit("table").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(300.0).alias("x1"), (F.max("row") * 30.0 + 30).alias("y1"))
    return EX.extract_regions(requests, spans, cells=cells, parts=parts).select("doc_id", "xml")


TABLES_SQL = f"""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS row, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT *, doc_id % 3 = 0 AND row = 0 AND count(*) OVER (PARTITION BY doc_id) > 1 AS head FROM l),
r AS (SELECT doc_id, row, head, '<tr>' || array_to_string(list_transform([CAST(part AS VARCHAR), 'a &amp; ' || part || ' b', CASE WHEN part % 5 <> 0 THEN 'z' ELSE '' END], lambda x: CASE WHEN head THEN '<th><para>' || x || '</para></th>' ELSE '<td><para>' || x || '</para></td>' END), '') || '</tr>' AS x FROM t)
SELECT doc_id, '{_OPEN}' || coalesce('<thead>' || string_agg(x, '') FILTER (head) || '</thead>', '') || '<tbody>' || coalesce(string_agg(x, '' ORDER BY row) FILTER (NOT head), '') || '</tbody>{_CLOSE}' AS xml FROM r GROUP BY doc_id"""

QUERIES = {"normalize_fragments": _normalize, "extract_regions": _extract, "table_fragments": _table_fragments}
SQL = {"normalize_fragments": NORMALIZE_SQL, "extract_regions": EXTRACT_SQL, "table_fragments": TABLES_SQL}
