"""The queries over the supplied tables, each with the same query in DuckDB's SQL.

Markup queries read `pages`; layout, table and review queries read fixtures that both
sides derive from the supplied tables by the same arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.functions import text as T
from quill.operators import findings as FI
from quill.operators import layout as L
from quill.operators import raster as RA
from quill.operators import readings as R
from quill.operators import repairs as RP
from quill.operators import requests as RQ
from quill.operators import sections as SE
from quill.operators import segmentation as SG
from quill.operators import segments as S
from quill.operators import state as ST
from quill.operators import streams as SM
from quill.operators import tables as TB
from quill.operators import tags as TG
from quill.operators import trees as TR
from quill.operators.lineage import cut, met_by_text, parts_for
from quill.plans import faults, fragments
from quill.plans.faults import dealt_lines
from quill.sources import layout as LY
from quill.sources import markup as MK

QUERIES: dict = faults.QUERIES | fragments.QUERIES
SQL: dict[str, str] = faults.SQL | fragments.SQL


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


# ---------------------------------------------------------------- tags

_TAG = r"<\s*(/?)\s*([A-Za-z][\w.-]*)([^<>]*?)(/?)\s*>"
_TAGS_SQL = rf"""
pieces AS (
    SELECT page_id AS doc_id, regexp_extract_all(h, '{_TAG}', 0) AS m, string_split_regex(h, '{_TAG}') AS g FROM src
), seqs AS (
    SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, g FROM pieces
), flat AS (
    SELECT doc_id, i - 1 AS seq, m[i] AS tag, g[i] AS gap FROM seqs
), tags AS (
    SELECT doc_id, seq, lower(regexp_extract(tag, '{_TAG}', 2)) AS name, regexp_extract(tag, '{_TAG}', 3) AS attrs,
        regexp_extract(tag, '{_TAG}', 1) = '/' AS is_close, regexp_extract(tag, '{_TAG}', 4) = '/' AND regexp_extract(tag, '{_TAG}', 1) <> '/' AS is_self,
        CAST(coalesce(sum(length(gap) + length(tag)) OVER p, 0) + length(gap) AS BIGINT) AS start,
        CAST(coalesce(sum(length(gap) + length(tag)) OVER p, 0) + length(gap) + length(tag) AS BIGINT) AS stop,
        CAST(1 + coalesce(sum(len(string_split(gap || tag, chr(10))) - 1) OVER p, 0) + len(string_split(gap, chr(10))) - 1 AS BIGINT) AS line
    FROM flat WINDOW p AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


@query("tag_stream", f"WITH src AS (SELECT page_id, html AS h FROM pages), {_TAGS_SQL} SELECT doc_id, seq, start, line, name, attrs, is_close, is_self FROM tags")
def tag_stream(spark, sf_dir):
    return TG.tag_stream(_pages(spark, sf_dir)).select("doc_id", "seq", "start", "line", "name", "attrs", "is_close", "is_self")


_INLINE_SQL = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?i)<\s*/\s*(?:b|strong|i|em)(?:[^\w.<>-][^<>]*?)?\s*>', '</emphasis>', 'g'),
    '(?i)<\s*(?:b|strong|i|em)(?:[^\w.<>/-][^<>]*?)?/\s*>', '', 'g'),
    '(?i)<\s*(?:b|strong)(?:[^\w.<>-][^<>]*?)?\s*>', '<emphasis role="strong">', 'g'),
    '(?i)<\s*(?:i|em)(?:[^\w.<>-][^<>]*?)?\s*>', '<emphasis>', 'g') AS h, html FROM pages"""
_UNBALANCED_SQL = f"""
WITH src AS ({_INLINE_SQL}), {_TAGS_SQL}, s1 AS (
    SELECT *, sum(CASE WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id, name ORDER BY start) AS s FROM tags WHERE NOT is_self
), s2 AS (
    SELECT *, coalesce(min(s) OVER (PARTITION BY doc_id, name ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low,
        min(s) OVER (PARTITION BY doc_id, name ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM s1
), found AS (
    SELECT doc_id, line, start, name AS tag, CASE WHEN is_close AND s < least(0, low) THEN 'tag.stray_close' WHEN NOT is_close AND (later IS NULL OR later >= s) THEN 'tag.unclosed' END AS code FROM s2
)"""


def _unbalanced(spark, sf_dir):
    return TG.unbalanced_tags(TG.tag_stream(TG.translate_inline(_pages(spark, sf_dir))))


@query("tag_balance_findings", f"{_UNBALANCED_SQL} SELECT * FROM found WHERE code IS NOT NULL")
def tag_balance(spark, sf_dir):
    return _unbalanced(spark, sf_dir).select("doc_id", "line", "start", "tag", "code")


@query("findings_dedup_order", f"""{_UNBALANCED_SQL}, once AS (
    SELECT doc_id, line, tag, code, min(start) AS start FROM found WHERE code IS NOT NULL GROUP BY ALL
) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, start) AS place FROM once""")  # fmt: skip
def findings_order(spark, sf_dir):
    return FI.dedup_findings(_unbalanced(spark, sf_dir).withColumn("checker", F.lit(1))).select("doc_id", "line", "tag", "code", "start", "place")


@query("findings_summary", f"""{_UNBALANCED_SQL}, n AS (
    SELECT page_id AS doc_id, count(*) FILTER (code = 'tag.unclosed') AS u, count(*) FILTER (code = 'tag.stray_close') AS x FROM pages LEFT JOIN found ON page_id = doc_id GROUP BY 1
) SELECT doc_id, u + x AS n_problems, CASE WHEN u + x = 0 THEN 'No problems found.' ELSE (u + x) || ' problem' || CASE WHEN u + x <> 1 THEN 's' ELSE '' END || ': '
    || concat_ws(', ', CASE WHEN u > 0 THEN u || ' unclosed tag' || CASE WHEN u <> 1 THEN 's' ELSE '' END END, CASE WHEN x > 0 THEN x || ' extra closing tag' || CASE WHEN x <> 1 THEN 's' ELSE '' END END) END AS summary FROM n""")  # fmt: skip
def findings_summary(spark, sf_dir):
    return FI.summarize(_unbalanced(spark, sf_dir), _pages(spark, sf_dir))


def _esc(x: str) -> str:
    return f"""replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), chr(39), '&#39;')"""


@query("report_lines", f"""{_UNBALANCED_SQL}, lines0 AS (SELECT page_id AS doc_id, unnest(range(1, len(string_split(h, chr(10))) + 1)) AS num, string_split(h, chr(10)) AS l FROM src
), lines AS (SELECT doc_id, num, l[num] AS t, coalesce(sum(length(l[num]) + 1) OVER (PARTITION BY doc_id ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lines0
), notes AS (SELECT f.doc_id, f.line AS num, f.start, e.stop, CASE f.code WHEN 'tag.unclosed' THEN '<' || f.tag || '> stays open' ELSE '</' || f.tag || '> closes nothing' END AS m FROM found f JOIN tags e ON e.doc_id = f.doc_id AND e.start = f.start WHERE code IS NOT NULL
), placed AS (SELECT l.doc_id, l.num, t, m, CAST(n.start - base AS BIGINT) AS a, CAST(least(stop - base, length(t)) AS BIGINT) AS b, CAST(coalesce(lag(least(stop - base, length(t))) OVER w, 0) AS BIGINT) AS prev, row_number() OVER w AS i FROM notes n JOIN lines l ON l.doc_id = n.doc_id AND l.num = n.num WINDOW w AS (PARTITION BY l.doc_id, l.num ORDER BY n.start)
), marked AS (SELECT doc_id, num, string_agg({_esc("substr(t, prev + 1, a - prev)")} || '<span class="bad">' || {_esc("substr(t, a + 1, b - a)")} || '</span>', '' ORDER BY i) || {_esc("substr(any_value(t), max(b) + 1)")} AS html, string_agg(m, '; ' ORDER BY i) AS notes FROM placed GROUP BY ALL)
SELECT lines.doc_id, lines.num, coalesce(html, {_esc("t")}) AS html, coalesce(notes, '') AS notes FROM lines LEFT JOIN marked ON lines.doc_id = marked.doc_id AND lines.num = marked.num""")  # fmt: skip
def report_lines(spark, sf_dir):
    texts = TG.translate_inline(_pages(spark, sf_dir))
    rows = FI.report_lines(texts, TG.unbalanced_tags(TG.tag_stream(texts)))
    return rows.select("doc_id", F.col("num").cast("long").alias("num"), "html", F.array_join("notes", "; ").alias("notes"))


@query("inline_translate", f"SELECT page_id AS doc_id, h AS text, CAST(len(regexp_extract_all(html, '(?i)<\\s*/?\\s*(?:b|strong|i|em)(?:[^\\w.<>-][^<>]*?)?\\s*>')) AS BIGINT) AS n_translated FROM ({_INLINE_SQL})")
def inline_translate(spark, sf_dir):
    return TG.translate_inline(_pages(spark, sf_dir)).select("doc_id", "text", F.col("n_translated").cast("long").alias("n_translated"))


@query("vocab_filter", f"WITH src AS (SELECT page_id, html AS h FROM pages), {_TAGS_SQL} SELECT doc_id, name, count(*) AS n FROM tags WHERE name IN ('para', 'title', 'b', 'ul', 'li') GROUP BY ALL")
def vocab_filter(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("para", "title", "B", "ul", "li")], "name string")
    return TG.known_tags(TG.tag_stream(_pages(spark, sf_dir)), names).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query("foreign_list_spans", f"""WITH src AS (SELECT page_id, html AS h FROM pages), {_TAGS_SQL}, s1 AS (
    SELECT *, sum(CASE WHEN is_close THEN -1 ELSE 1 END) OVER w AS s FROM tags WHERE name IN ('ul', 'ol') AND NOT is_self WINDOW w AS (PARTITION BY doc_id ORDER BY start)
), s2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY start)) AS depth FROM s1
), s3 AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM s2
), s4 AS (SELECT *, sum(CASE WHEN NOT is_close AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM s3
), s5 AS (SELECT doc_id, span, min(start) FILTER (NOT is_close AND before = 0) AS start, max(stop) FILTER (is_close AND depth = 0 AND before > 0) AS "end" FROM s4 GROUP BY ALL)
SELECT doc_id, start, "end" FROM s5 WHERE start IS NOT NULL AND "end" IS NOT NULL""")  # fmt: skip
def foreign_list_spans(spark, sf_dir):
    return TG.outer_spans(TG.tag_stream(_pages(spark, sf_dir)), ["ul", "ol"])


@query("attr_extract", f"""WITH src AS (SELECT page_id, html AS h FROM pages), {_TAGS_SQL} SELECT doc_id, seq, nullif(regexp_extract(attrs, '\\bhref\\s*=\\s*"([^"]*)"', 1), '') AS href FROM tags WHERE name = 'a' AND NOT is_close""")
def attr_extract(spark, sf_dir):
    tags = TG.tag_stream(_pages(spark, sf_dir)).filter("name = 'a' and not is_close")
    return tags.select("doc_id", "seq", F.nullif(T.attr_text(F.col("attrs"), "href"), F.lit("")).alias("href"))


@query("page_clean", r"""SELECT page_id AS doc_id, trim(regexp_replace(trim(regexp_replace(html, '(?i)<!doctype[^>]*>', '', 'g'), chr(10) || ' '), '>\s+<', '><', 'g'), chr(10) || ' ') AS text,
    trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")  # fmt: skip
def page_clean(spark, sf_dir):
    plain = T.collapse(F.regexp_replace("text", "<[^>]*>", " "))
    return _pages(spark, sf_dir).select("doc_id", T.squash(T.strip_envelope(F.col("text"))).alias("text"), plain.alias("plain"))


# ---------------------------------------------------------------- texts

@query("line_functions", r"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), t AS (SELECT doc_id, i - 1 AS line, s[i] AS t FROM l)
SELECT doc_id, line, regexp_matches(t, '^\s*(?:[•\-*◦▪‣]|\(?[a-zA-Z0-9]{1,4}(?:\.\)|[.)]))\s+') AS is_marker, regexp_matches(t, '[.!?:;)"'']\s*$') AS sentence_end,
    regexp_replace(regexp_replace(replace(t, ' ', ''), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, regexp_matches(t, '[0-9][A-Z]*[a-z]') AS case_suspect,
    regexp_replace(regexp_replace(t, '([A-Za-z])\. (\S)', '\1, \2', 'g'), '([A-Za-z])\. (\S)', '\1, \2', 'g') AS repaired, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') AS escaped FROM t""")
def line_functions(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    t = F.col("t")
    return rows.select("doc_id", F.col("line").cast("long").alias("line"), t.rlike(rf"(?U)\A\s*{T.MARKER}\s+").alias("is_marker"), t.rlike(T.SENTENCE_END).alias("sentence_end"), T.shape(t).alias("shape"), T.case_suspect(t).alias("case_suspect"), T.comma_repair(t).alias("repaired"), T.escape_html(t).alias("escaped"))


@query("page_ref_flag", r"""SELECT doc_id, regexp_replace(t, '(?i)(\(\s*(?:see\s+)?(?:pages?|pgs?\.?|pp?\.?)\s*\d+(?:\s*[-–—]\s*\d+)?[^)]*\))', '<span class="page-ref-flag">\1</span>', 'g') AS text FROM (
    SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' (see page ' || doc_id || ')' WHEN 1 THEN ' (PP. 3 - 4, below)' ELSE ' (pages are numbered)' END AS t FROM documents)""")
def page_ref_flag(spark, sf_dir):
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit(" (see page "), "doc_id", F.lit(")"))).when(k == 1, " (PP. 3 - 4, below)").otherwise(" (pages are numbered)")
    return _table(spark, sf_dir, "documents").select("doc_id", T.flag_page_refs(F.concat("text", said)).alias("text"))


@query("markdown_label", r"""SELECT conv_id, turn, CASE WHEN t LIKE '# %' THEN trim(substr(string_split(t, chr(10))[1], 3)) ELSE 'Untitled' END AS label FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '# ' || text ELSE text END AS t FROM conversations)""")
def markdown_label(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_line_label(text).alias("label"))


@query("word_multiset_guard", r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL), lost AS (SELECT a.doc_id, sum(greatest(a.n - coalesce(b.n, 0), 0)) AS n FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id + 1 AND a.word = b.word GROUP BY 1)
SELECT d.doc_id AS pair_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lost FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN lost ON lost.doc_id = d.doc_id""")
def word_multiset_guard(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # Few splits of a file hold many texts, so these are dealt before they are cut into words.
    docs = docs.repartition(parts_for(spark, docs.count(), 2_000), "doc_id")
    texts = docs.select(F.col("doc_id").alias("text_id"), T.plain_words(F.col("text")).alias("words"))
    ids = _table(spark, sf_dir, "documents").select("doc_id")
    pairs = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("old"), (F.col("doc_id") + 1).alias("new"))
    return ST.lost_of_lists(texts, pairs)


# ---------------------------------------------------------------- layout

_LAYOUT_SQL = """lines0 AS (SELECT doc_id, unnest(range(0, len(s))) AS line, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
), lay AS (SELECT doc_id, line, line // 7 AS block, s[line + 1] AS text, 14.0 * line + CASE WHEN line % 5 = 4 THEN 6 ELSE 0 END AS y0, 14.0 * line + 13 + line % 3 AS y1,
    20.0 + doc_id % 50 AS x0, 220.0 + doc_id % 50 AS x1, CASE WHEN line % 11 = 10 THEN 0.7 ELSE 1.0 END AS dir_x, CASE WHEN line % 11 = 10 THEN 0.7 ELSE 0.0 END AS dir_y,
    CASE line % 4 WHEN 0 THEN 'Sans-Bold' WHEN 1 THEN 'Serif-Oblique' ELSE 'Serif' END AS font, CASE WHEN line % 6 = 0 THEN 16 WHEN line % 6 = 1 THEN 2 ELSE 0 END AS flags FROM lines0)"""


def _layout(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("line", F.col("i").cast("long"))
    line, slant = F.col("line"), F.col("line") % 11 == 10
    return rows.select(
        "doc_id", "line", F.floor(line / 7).alias("block"), "text",
        (14.0 * line + F.when(line % 5 == 4, 6).otherwise(0)).alias("y0"), (14.0 * line + 13 + line % 3).cast("double").alias("y1"),
        (20.0 + F.col("doc_id") % 50).alias("x0"), (220.0 + F.col("doc_id") % 50).alias("x1"),
        F.when(slant, 0.7).otherwise(1.0).alias("dir_x"), F.when(slant, 0.7).otherwise(0.0).alias("dir_y"),
        F.when(line % 4 == 0, "Sans-Bold").when(line % 4 == 1, "Serif-Oblique").otherwise("Serif").alias("font"),
        F.when(line % 6 == 0, 16).when(line % 6 == 1, 2).otherwise(0).alias("flags"),
    )


@query("region_filter", f"""WITH {_LAYOUT_SQL} SELECT doc_id, line, text, flags // 16 % 2 = 1 OR contains(lower(font), 'bold') AS bold, flags // 2 % 2 = 1 OR contains(lower(font), 'oblique') OR contains(lower(font), 'italic') AS italic
FROM lay WHERE 120.0 + line % 50 >= 130 AND 120.0 + line % 50 < 160 AND abs(dir_x * dir_y) <= 0.01 AND trim(text) <> ''""")  # fmt: skip
def region_filter(spark, sf_dir):
    indent = F.col("line") % 50
    lines = L.in_region(_layout(spark, sf_dir).withColumns({"x0": 20.0 + indent, "x1": 220.0 + indent}), 130, 0, 160, float("inf"))
    return lines.select("doc_id", "line", "text", L.is_bold(F.col("font"), F.col("flags")).alias("bold"), L.is_italic(F.col("font"), F.col("flags")).alias("italic"))


@query("paragraph_islands", f"""WITH {_LAYOUT_SQL}, med AS (SELECT doc_id, list_sort(list(y1 - y0))[count(*) // 2 + 1] AS m FROM lay GROUP BY 1
), p AS (SELECT lay.*, m, lag(y1) OVER w AS py, lag(block) OVER w AS pb, lag(text) OVER w AS pt FROM lay JOIN med USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY y0, y1, block, line)
), q AS (SELECT *, CASE WHEN py IS NOT NULL AND (y0 - py > m * 0.5 OR (block <> pb AND NOT (NOT regexp_matches(trim(pt), '[.!?:;)"'']\\s*$') AND regexp_matches(trim(text), '^\\p{{Ll}}')))) THEN 1 ELSE 0 END AS split FROM p
), r AS (SELECT *, sum(split) OVER (PARTITION BY doc_id ORDER BY y0, y1, block, line) + 1 AS para FROM q)
SELECT doc_id, CAST(para AS BIGINT) AS para, count(*) AS n_lines, coalesce(nullif(ltrim(string_agg(trim(text), ' ' ORDER BY y0, y1, block, line)), ''), '') AS text FROM r GROUP BY doc_id, para""")  # fmt: skip
def paragraph_islands(spark, sf_dir):
    rows = L.paragraphs(_layout(spark, sf_dir))
    return rows.select("doc_id", "para", "n_lines", "text")


@query("dehyphen_join", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), h AS (SELECT doc_id, list_filter(list_transform(range(0, len(s)), lambda i: CASE WHEN i % 4 = 0 THEN trim(s[i + 1]) || '-' ELSE trim(s[i + 1]) END), lambda x: x <> '') AS s FROM l)
SELECT doc_id, CASE WHEN len(s) = 0 THEN '' ELSE list_reduce(s, lambda a, b: CASE WHEN regexp_matches(a, '[a-z]-$') AND regexp_matches(b, '^\p{Ll}') THEN left(a, length(a) - 1) || b ELSE a || ' ' || b END) END AS text FROM h""")
def dehyphen_join(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.trim(t), F.when(i % 4 == 0, "-").otherwise("")))
    return _table(spark, sf_dir, "documents").select("doc_id", T.join_lines(F.filter(lines, lambda t: t != "")).alias("text"))


@query("list_items", f"""WITH {_LAYOUT_SQL}, k AS (SELECT doc_id, line, trim(text) AS t, regexp_matches(trim(text), '^(?:[•\\-*◦▪‣]|\\(?[a-zA-Z0-9]{{1,4}}(?:\\.\\)|[.)]))\\s*$') AS alone,
    regexp_matches(trim(text), '^(?:[•\\-*◦▪‣]|\\(?[a-zA-Z0-9]{{1,4}}(?:\\.\\)|[.)]))\\s+') AS pre FROM lay
), g AS (SELECT *, sum(CASE WHEN alone OR pre THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS grp FROM k
), o AS (SELECT doc_id, min(line) FILTER (alone OR pre) AS first FROM g GROUP BY 1
), f AS (SELECT g.doc_id, grp, regexp_matches(k.t, '^\\(?[a-zA-Z0-9]{{1,4}}(?:\\.\\)|[.)])') AS ordered, string_agg(CASE WHEN NOT g.alone THEN CASE WHEN g.pre THEN regexp_replace(g.t, '^(?:[•\\-*◦▪‣]|\\(?[a-zA-Z0-9]{{1,4}}(?:\\.\\)|[.)]))\\s*', '') ELSE g.t END END, ' ' ORDER BY g.line) AS text
    FROM g JOIN o USING (doc_id) JOIN k ON k.doc_id = o.doc_id AND k.line = o.first WHERE grp > 0 GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS item, ordered, text FROM f WHERE text IS NOT NULL""")  # fmt: skip
def list_items(spark, sf_dir):
    return L.list_items(_layout(spark, sf_dir))


@query("line_in_cell_join", f"""WITH {_LAYOUT_SQL}, tall AS (SELECT doc_id, CAST(ceil(max(y1) / 60) AS BIGINT) AS n FROM lay GROUP BY 1), cells AS (SELECT doc_id, r * 2 + c AS cell, 100.0 * c AS cx0, 100.0 * c + 100 AS cx1, 60.0 * r AS cy0, 60.0 * r + 60 AS cy1 FROM (SELECT doc_id, unnest(range(0, n)) AS r FROM tall), range(0, 2) AS b(c))
SELECT lay.doc_id, cell, count(*) AS n FROM lay JOIN cells ON lay.doc_id = cells.doc_id AND (x0 + x1) / 2 >= cx0 AND (x0 + x1) / 2 < cx1 AND (y0 + y1) / 2 >= cy0 AND (y0 + y1) / 2 < cy1 GROUP BY ALL""")  # fmt: skip
def line_in_cell_join(spark, sf_dir):
    lines = _layout(spark, sf_dir)
    tall = lines.groupBy("doc_id").agg(F.ceil(F.max("y1") / 60).alias("n_rows"))
    cells = tall.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), (2 * F.col("n_rows") - 1).cast("long"))).alias("cell"))
    r, c = F.floor(F.col("cell") / 2), F.col("cell") % 2
    cells = cells.select("doc_id", "cell", (100.0 * c).alias("cx0"), (100.0 * c + 100).alias("cx1"), (60.0 * r).alias("cy0"), (60.0 * r + 60).alias("cy1"))
    return L.lines_in_cells(lines, cells, "doc_id", 60).groupBy("doc_id", "cell").agg(F.count("*").alias("n"))


@query("best_overlap", """WITH clips AS (SELECT c_custkey AS clip_id, c_nationkey AS k, CAST(c_custkey * 7 % 100 AS DOUBLE) AS x0, CAST(c_custkey * 11 % 100 AS DOUBLE) AS y0, c_custkey * 7 % 100 + 40.0 AS x1, c_custkey * 11 % 100 + 30.0 AS y1 FROM customer
), img AS (SELECT s_suppkey AS image_id, s_nationkey AS k, CAST(s_suppkey * 13 % 100 AS DOUBLE) AS ix0, CAST(s_suppkey * 5 % 100 AS DOUBLE) AS iy0, s_suppkey * 13 % 100 + 60.0 AS ix1, s_suppkey * 5 % 100 + 50.0 AS iy1 FROM supplier
), o AS (SELECT clip_id, image_id, greatest(0, least(x1, ix1) - greatest(x0, ix0)) * greatest(0, least(y1, iy1) - greatest(y0, iy0)) AS a, (x1 - x0) * (y1 - y0) AS clip FROM clips JOIN img USING (k)
), r AS (SELECT *, sum(a) OVER (PARTITION BY clip_id) AS total, row_number() OVER (PARTITION BY clip_id ORDER BY a DESC, image_id) AS rn FROM o WHERE a > 0)
SELECT clip_id, image_id, a AS overlap FROM r WHERE rn = 1 AND a >= 0.9 * total AND a >= 0.25 * clip""")
def best_overlap(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    clips = _table(spark, sf_dir, "customer").select(c.alias("clip_id"), F.col("c_nationkey").alias("k"), (c * 7 % 100).cast("double").alias("x0"), (c * 11 % 100).cast("double").alias("y0"), (c * 7 % 100 + 40.0).alias("x1"), (c * 11 % 100 + 30.0).alias("y1"))
    images = _table(spark, sf_dir, "supplier").select(s.alias("image_id"), F.col("s_nationkey").alias("k"), (s * 13 % 100).cast("double").alias("ix0"), (s * 5 % 100).cast("double").alias("iy0"), (s * 13 % 100 + 60.0).alias("ix1"), (s * 5 % 100 + 50.0).alias("iy1"))
    return L.best_overlap(clips, images, "k")


@query("zoom_clamp", "SELECT p_partkey, round(CASE WHEN w * h * 64.0 > 50e6 THEN 8 * sqrt(50e6 / (w * h * 64.0)) ELSE 8 END, 9) AS zoom FROM (SELECT p_partkey, 100.0 + p_size * 40 AS w, 200.0 + p_partkey % 900 AS h FROM part)")
def zoom_clamp(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(L.clamp_zoom(100.0 + F.col("p_size") * 40, 200.0 + F.col("p_partkey") % 900, F.lit(8.0), 50), 9).alias("zoom"))


# ---------------------------------------------------------------- tables

_CELLS_SQL = "cells AS (SELECT l_orderkey AS table_id, l_linenumber AS row, c AS col, 1 + (CAST(l_quantity AS BIGINT) + c) % 3 AS colspan, 1 + (l_linenumber + c) % 2 AS rowspan FROM lineitem, range(0, 3) AS a(c))"


def _cells(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), "l_quantity", F.explode(F.array(*map(F.lit, range(3)))).alias("col"))
    return rows.select("table_id", "row", "col", (1 + (F.col("l_quantity").cast("long") + F.col("col")) % 3).alias("colspan"), (1 + (F.col("row") + F.col("col")) % 2).alias("rowspan"))


_WIDTHS_SQL = f"WITH {_CELLS_SQL}, rws AS (SELECT DISTINCT table_id, row FROM cells), widths AS (SELECT r.table_id, r.row, CAST(sum(colspan) AS BIGINT) AS width FROM rws r JOIN cells c ON c.table_id = r.table_id AND r.row >= c.row AND r.row < c.row + c.rowspan GROUP BY ALL)"


@query("table_row_widths", f"{_WIDTHS_SQL} SELECT * FROM widths")
def table_row_widths(spark, sf_dir):
    return TB.row_widths(_cells(spark, sf_dir))


@query("ragged_tables", f"""{_WIDTHS_SQL} SELECT table_id, count(*) AS n_rows, string_agg(width, ',' ORDER BY row) AS widths, CASE WHEN count(DISTINCT width) > 1 THEN 'table.ragged' WHEN any_value(o_orderkey % 4 + 4) <> min(width) THEN 'table.colgroup_mismatch' END AS code
FROM widths JOIN orders ON o_orderkey = table_id GROUP BY 1""")  # fmt: skip
def ragged_tables(spark, sf_dir):
    declared = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 4 + 4).alias("columns"))
    return TB.table_layout(_cells(spark, sf_dir), declared=declared).withColumn("widths", F.array_join(F.col("widths").cast("array<string>"), ","))


@query("table_emit", """WITH r AS (SELECT n_regionkey AS table_id, string_agg('<tr><td><para>' || n_nationkey || '</para></td><td><para>' || n_name || '</para></td></tr>', '' ORDER BY n_nationkey) AS body FROM nation GROUP BY 1)
SELECT table_id, '<informaltable frame="box" rules="all"><thead><tr><th><para>' || r_name || '</para></th><th><para>A&amp;B</para></th></tr></thead><tbody>' || body || '</tbody></informaltable>' AS xml FROM r JOIN region ON table_id = r_regionkey""")
def table_emit(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    cell = lambda df, t, row, col, head, text: df.select(F.col(t).alias("table_id"), row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(head).alias("is_header"), text.cast("string").alias("text"))
    body = [cell(nation, "n_regionkey", F.col("n_nationkey"), k, False, F.col(c)) for k, c in enumerate(("n_nationkey", "n_name"))]
    head = [cell(region, "r_regionkey", F.lit(-1), k, True, c) for k, c in enumerate((F.col("r_name"), F.lit("A&B")))]
    return TB.build_tables(head[0].unionAll(head[1]).unionAll(body[0]).unionAll(body[1]))


@query("header_bold_rule", """WITH s AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row, CASE WHEN (l_orderkey + l_linenumber * l_linenumber) % 3 = 0 THEN 1.0 ELSE 0.0 END AS b FROM lineitem),
r AS (SELECT table_id, row, avg(b) AS b FROM s GROUP BY ALL) SELECT table_id, coalesce(count(*) >= 2 AND max(b) FILTER (row = 0) > 0.5 AND max(b) FILTER (row = 1) = 0, false) AS has_header FROM r GROUP BY 1""")
def header_bold_rule(spark, sf_dir):
    bold = (F.col("l_orderkey") + F.col("l_linenumber") * F.col("l_linenumber")) % 3 == 0
    spans = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), F.lit("x").alias("text"), F.when(bold, 16).otherwise(2).alias("flags"))
    return TB.reliable_header(spans)


@query("cell_grid", """WITH rules AS (SELECT n_regionkey AS img_id, n_nationkey * 37 AS x FROM nation), bnd AS (SELECT n_regionkey AS img_id, n_nationkey * 20 AS y0, n_nationkey * 20 + 11 AS y1, 0 AS top, 600 AS bottom FROM nation),
c AS (SELECT img_id, x, lead(x) OVER w AS nx, row_number() OVER w - 1 AS col FROM rules WINDOW w AS (PARTITION BY img_id ORDER BY x)),
r AS (SELECT img_id, row_number() OVER w - 1 AS row, coalesce((lag(y1) OVER w + y0) // 2, top) AS y0, coalesce((y1 + lead(y0) OVER w) // 2, bottom + 1) AS y1 FROM bnd WINDOW w AS (PARTITION BY img_id ORDER BY y0))
SELECT img_id, row, col, y0, y1, x + 6 AS x0, greatest(nx - 6, x + 7) AS x1 FROM r JOIN c USING (img_id) WHERE nx IS NOT NULL""")
def cell_grid(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    rules = nation.select(F.col("n_regionkey").alias("img_id"), (k * 37).alias("x"))
    rows = nation.select(F.col("n_regionkey").alias("img_id"), (k * 20).alias("y0"), (k * 20 + 11).alias("y1"), F.lit(0).alias("top"), F.lit(600).alias("bottom"))
    return TB.grid_cells(rules, rows)


# ---------------------------------------------------------------- profiles and readings

@query("profile_runs", "WITH p AS (SELECT event_type AS key, event_id AS pos, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events WHERE value > 3) SELECT key, min(pos) AS start, max(pos) AS \"end\" FROM p GROUP BY key, i")
def profile_runs(spark, sf_dir):
    return S.runs(_table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("pos"), (F.col("value") > 3).alias("on")))


@query("profile_bands", """WITH p AS (SELECT event_id % 4 AS key, event_id // 4 AS pos, value FROM events), r AS (SELECT key, pos, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM p WHERE value > 10
), u AS (SELECT key, min(pos) AS s, max(pos) AS e FROM r GROUP BY key, i), n AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY key ORDER BY s) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM u
), b AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s) AS b FROM n) SELECT key, min(s) AS start, max(e) AS "end" FROM b GROUP BY key, b HAVING max(e) - min(s) + 1 >= 6""")
def profile_bands(spark, sf_dir):
    e = F.col("event_id")
    return S.bands(_table(spark, sf_dir, "events").select((e % 4).alias("key"), F.floor(e / 4).alias("pos"), (F.col("value") > 10).alias("on")))


_READ_SQL = """cells AS (SELECT p_partkey // 20 AS img_id, p_partkey % 20 AS row, c AS col, CASE WHEN p_partkey % 20 = 0 THEN 'HEAD ' || c WHEN c = 0 THEN CASE WHEN p_partkey % 37 = 0 THEN '7x' ELSE CAST(p_partkey % 20 AS VARCHAR) END
    WHEN c = 1 THEN CASE WHEN p_partkey % 13 = 0 THEN 'BAD' ELSE '4' || (10 + p_partkey % 90) || '-' || (1000 + p_partkey * 7 % 9000) || 'Y1' END ELSE 'BOLT. M' || p_size || CASE WHEN p_partkey % 5 = 0 THEN 'm' ELSE '' END END AS text,
    p_partkey % 17 <> 0 AS agree, CASE WHEN p_partkey % 11 = 0 THEN 0.5 ELSE 0.95 END AS conf FROM part, range(0, 3) AS a(c))"""


def _readings(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("col"))
    number = F.when(p % 37 == 0, "7x").otherwise((p % 20).cast("string"))
    code = F.when(p % 13 == 0, "BAD").otherwise(F.concat(F.lit("4"), 10 + p % 90, F.lit("-"), 1000 + p * 7 % 9000, F.lit("Y1")))
    words = F.concat(F.lit("BOLT. M"), "p_size", F.when(p % 5 == 0, "m").otherwise(""))
    text = F.when(p % 20 == 0, F.concat(F.lit("HEAD "), "col")).when(F.col("col") == 0, number).when(F.col("col") == 1, code).otherwise(words)
    return rows.select(F.floor(p / 20).alias("img_id"), (p % 20).alias("row"), "col", text.alias("text"), (p % 17 != 0).alias("agree"), F.when(p % 11 == 0, 0.5).otherwise(0.95).alias("conf"))


_PROFILE_SQL = f"""{_READ_SQL}, heads AS (SELECT img_id, count(DISTINCT row) >= 2 AND NOT coalesce(bool_or(CASE WHEN row = 0 AND text <> '' THEN regexp_matches(text, '^[\\d\\s.,-]+$') END), false) AS h FROM cells GROUP BY 1
), body AS (SELECT cells.*, row - CASE WHEN h THEN 1 ELSE 0 END AS body_row, regexp_replace(regexp_replace(replace(text, ' ', ''), '\\d', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, regexp_matches(text, '^[0-9]+$') AS is_int FROM cells JOIN heads USING (img_id) WHERE row - CASE WHEN h THEN 1 ELSE 0 END >= 0
), steps AS (SELECT img_id, col, count(*) FILTER (d = 1) AS ups FROM (SELECT img_id, col, CAST(text AS BIGINT) - lag(CAST(text AS BIGINT)) OVER (PARTITION BY img_id, col ORDER BY body_row) AS d FROM body WHERE is_int) GROUP BY ALL
), sh AS (SELECT img_id, col, shape, count(*) AS k, min(body_row) AS f FROM body WHERE text <> '' GROUP BY ALL
), top AS (SELECT img_id, col, shape AS common, k FROM sh QUALIFY row_number() OVER (PARTITION BY img_id, col ORDER BY k DESC, f) = 1
), prof AS (SELECT b.img_id, b.col, count(*) AS n, count(*) FILTER (is_int) AS n_int, any_value(ups) AS ups, any_value(common) AS common, any_value(top.k) AS k FROM body b LEFT JOIN steps s ON s.img_id = b.img_id AND s.col = b.col JOIN top ON top.img_id = b.img_id AND top.col = b.col WHERE text <> '' GROUP BY ALL
), profile AS (SELECT img_id, col, n, n_int, n_int / n >= 0.8 AS numeric, n_int / n >= 0.8 AND n_int >= 3 AND coalesce(ups, 0) >= (n_int - 1) * 0.7 AS counting, common, NOT n_int / n >= 0.8 AND n >= 3 AND k / n >= 0.7 AND length(common) >= 4 AS patterned FROM prof)"""


@query("ocr_column_profile", f"WITH {_PROFILE_SQL} SELECT * FROM profile")
def ocr_column_profile(spark, sf_dir):
    return R.column_profile(R.body_and_header(_readings(spark, sf_dir)).filter("body_row >= 0"))


@query("ocr_flags", f"""WITH {_PROFILE_SQL}, v AS (SELECT b.img_id, body_row, b.col, text, agree, conf, is_int, shape, numeric, counting, patterned, common, last_value(CASE WHEN is_int THEN CAST(text AS BIGINT) END IGNORE NULLS) OVER (PARTITION BY b.img_id, b.col ORDER BY body_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM body b JOIN profile p ON p.img_id = b.img_id AND p.col = b.col)
SELECT img_id, body_row, col, CASE WHEN NOT numeric AND NOT patterned THEN regexp_replace(text, '([A-Za-z])\\. (\\S)', '\\1, \\2', 'g') ELSE text END AS text,
    concat_ws('; ', CASE WHEN NOT agree THEN 'readings differ' WHEN conf < 0.9 THEN 'low confidence ' || format('{{:.2f}}', conf) END, CASE WHEN numeric AND NOT is_int THEN 'not a number' END, CASE WHEN counting AND is_int AND CAST(CASE WHEN is_int THEN text END AS BIGINT) <> prev + 1 THEN 'sequence ' || prev || ' to ' || text END,
        CASE WHEN patterned AND shape <> common THEN 'off the column''s pattern' END, CASE WHEN NOT numeric AND NOT patterned AND regexp_matches(text, '[0-9][A-Z]*[a-z]') THEN 'letter case' END) AS why FROM v""")  # fmt: skip
def ocr_flags(spark, sf_dir):
    return R.review(_readings(spark, sf_dir)).select("img_id", "body_row", "col", "text", F.array_join("why", "; ").alias("why"))


# ---------------------------------------------------------------- state

@query("limiter_decisions", """WITH RECURSIVE e AS (SELECT user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events), f AS (
    SELECT user_id, event_type, i, t, true AS ok, [t] AS live FROM e WHERE i = 1 UNION ALL
    SELECT e.user_id, e.event_type, e.i, e.t, len(list_filter(f.live, lambda x: x > e.t - 86400)) < 2, CASE WHEN len(list_filter(f.live, lambda x: x > e.t - 86400)) < 2 THEN list_append(list_filter(f.live, lambda x: x > e.t - 86400), e.t) ELSE list_filter(f.live, lambda x: x > e.t - 86400) END
    FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
SELECT user_id, event_type, CAST(round(t * 1e6) AS BIGINT) AS at_us, ok AS allowed FROM f""")
def limiter_decisions(spark, sf_dir):
    requests = _table(spark, sf_dir, "events").select("user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    rows = ST.limit_requests(requests, ["user_id", "event_type"], 2, 86400)
    return rows.select("user_id", "event_type", F.round(F.col("at") * 1e6).cast("long").alias("at_us"), "allowed")


_ACTION_SQL = "CASE event_id % 7 WHEN 0 THEN 'upload' WHEN 1 THEN 'arm' WHEN 2 THEN 'append' WHEN 3 THEN 'wait' WHEN 4 THEN 'submit' WHEN 5 THEN 'append' ELSE CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'submit' END END"


@query("upload_decisions", f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, {_ACTION_SQL} AS action, event_id % 3 AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, i, action = 'upload' AS ok, CASE WHEN action = 'upload' THEN t END AS used, false AS armed, CAST(NULL AS BIGINT) AS waits FROM e WHERE i = 1 UNION ALL
    SELECT e.event_id, e.user_id, e.i,
        CASE WHEN action = 'upload' THEN true WHEN f.used IS NULL OR e.t - f.used > 86400 THEN false WHEN action = 'append' THEN f.armed WHEN action = 'submit' THEN coalesce(f.waits = page, false) ELSE true END,
        CASE WHEN action = 'upload' OR e.t - f.used <= 86400 THEN e.t END,
        CASE WHEN action = 'upload' OR f.used IS NULL OR e.t - f.used > 86400 THEN false WHEN action IN ('arm', 'done') THEN action = 'arm' ELSE f.armed END,
        CASE WHEN action = 'upload' OR f.used IS NULL OR e.t - f.used > 86400 THEN NULL WHEN action = 'wait' THEN page WHEN action = 'submit' AND f.waits = page THEN NULL ELSE f.waits END
    FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, ok AS accepted FROM f""")
def upload_decisions(spark, sf_dir):
    k = F.col("event_id") % 7
    action = F.when(k == 0, "upload").when(k == 1, "arm").when(k.isin(2, 5), "append").when(k == 3, "wait").when((k == 4) | (F.col("event_id") % 2 == 1), "submit").otherwise("done")
    events = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("token"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 3).alias("page"))
    return ST.upload_decisions(events, idle_seconds=86400).select("event_id", "accepted")


@query("idle_sessions", """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS start, max(t) AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def idle_sessions(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return ST.idle_sessions(events, "user_id", "t", 6 * 3600 * 1_000_000)


@query("continuation_merge", """WITH a AS (SELECT conv_id AS token, min(role) FILTER (turn = 0) AS kind, list(text) FILTER (turn = 0) AS items, min(CASE WHEN conv_id % 3 = 0 THEN 'other' ELSE 'user' END) FILTER (turn = 1) AS k2, list(text ORDER BY turn) FILTER (turn > 0) AS more, min(role) FILTER (turn = 0) = 'user' AND conv_id % 3 <> 0 AND count(*) FILTER (turn > 0) > 0 AS merged FROM conversations GROUP BY conv_id)
SELECT token, kind, array_to_string(CASE WHEN merged THEN list_concat(items, more) ELSE items END, chr(10)) AS xml, coalesce(merged, false) AS merged FROM a WHERE items IS NOT NULL""")
def continuation_merge(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "token")
    base = turns.filter("turn = 0").groupBy("token").agg(F.min("role").alias("kind"), F.collect_list("text").alias("items")).withColumn("xml", F.lit(""))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    more = turns.filter("turn > 0").groupBy("token").agg(F.when(F.col("token") % 3 == 0, "other").otherwise("user").alias("kind"), texts.alias("items"))
    return ST.merge_continuations(base, more).select("token", "kind", "xml", "merged")


# ---------------------------------------------------------------- derived topics

_BODY_SQL = """body AS (SELECT l_orderkey AS doc_id, l_orderkey % 8 AS k, string_agg('<para>' || l_linenumber || ' of ' || l_partkey || '</para>', '' ORDER BY l_linenumber, l_partkey) AS b FROM lineitem GROUP BY l_orderkey),
topics AS (SELECT doc_id, k, '<section>' || CASE WHEN k = 1 THEN '' ELSE '<title>Order ' || doc_id || '</title>' END || CASE k WHEN 2 THEN '<title>again</title>' WHEN 3 THEN '<para><para>in</para></para>' WHEN 4 THEN '<imageobject></imageobject>' WHEN 5 THEN '<mediaobject></mediaobject>' WHEN 7 THEN '<itemizedlist><para>loose</para></itemizedlist>' ELSE '' END || b || CASE WHEN k = 6 THEN '' ELSE '</section>' END AS text FROM body)"""


def _topics(spark, sf_dir) -> tuple[DataFrame, int]:
    """(doc_id, text) dealt by doc_id, and to how many parts."""
    dealt, parts = dealt_lines(spark, sf_dir)
    lines = dealt.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("<para>"), x["l_linenumber"], F.lit(" of "), x["l_partkey"], F.lit("</para>"))), "")
    k = F.col("doc_id") % 8
    title = F.when(k == 1, "").otherwise(F.concat(F.lit("<title>Order "), "doc_id", F.lit("</title>")))
    faults = {2: "<title>again</title>", 3: "<para><para>in</para></para>", 4: "<imageobject></imageobject>", 5: "<mediaobject></mediaobject>", 7: "<itemizedlist><para>loose</para></itemizedlist>"}
    fault = F.coalesce(*[F.when(k == n, x) for n, x in faults.items()], F.lit(""))
    return lines.select("doc_id", F.concat(F.lit("<section>"), title, fault, body, F.when(k == 6, "").otherwise("</section>")).alias("text")), parts


@query("topic_findings", f"""WITH {_BODY_SQL}, c AS (SELECT doc_id, CASE k WHEN 1 THEN 'section.no_title' WHEN 2 THEN 'section.titles' WHEN 3 THEN 'para.misplaced_child' WHEN 4 THEN 'media.outside' WHEN 5 THEN 'media.no_imageobject' WHEN 6 THEN 'tag.unclosed' WHEN 7 THEN 'list.misplaced_child' END AS code,
    CASE WHEN k IN (1, 2, 6) THEN 0 ELSE instr(text, CASE k WHEN 3 THEN '<para>in' WHEN 4 THEN '<imageobject' WHEN 5 THEN '<mediaobject' WHEN 7 THEN '<para>loose' END) - 1 END AS start FROM topics) SELECT * FROM c WHERE code IS NOT NULL""")  # fmt: skip
def topic_findings(spark, sf_dir):
    docs, parts = _topics(spark, sf_dir)
    tags = cut(TG.tag_stream(docs), "doc_id", parts)
    columns = ["doc_id", "code", "start"]
    found = TG.unbalanced_tags(tags).select(*columns)
    for check in (SE.check_media, SE.check_sections, SE.check_placement):
        found = found.unionByName(check(tags).select(*columns))
    with met_by_text(spark):
        loose = cut(SE.check_loose_text(tags).select(*columns))
    return found.unionByName(loose)


@query("fix_candidates", f"WITH {_BODY_SQL} SELECT doc_id, 'Close it at the end' AS label, text || '</section>' AS new_text FROM topics WHERE k = 6")
def fix_candidates(spark, sf_dir):
    docs, parts = _topics(spark, sf_dir)
    docs = cut(docs, "doc_id", parts)
    tags = cut(TG.tag_stream(docs), "doc_id", parts)
    found = cut(TG.unbalanced_tags(tags), "doc_id", parts)
    return RP.suggest_fixes(docs, found, tags, parts=parts).select("doc_id", "label", "new_text")


@query("strip_xinfo", f"WITH {_BODY_SQL} SELECT doc_id, replace(replace(text, '<section>', '<section xinfo:id=\"1\">'), '<para>', '<para role=\"x\">say xinfo:b=\"2\" here ') AS text FROM topics")
def strip_xinfo(spark, sf_dir):
    change = {"<section>": '<section xinfo:id="1">', "<title>": "<TITLE xinfo:n='2'>", "<para>": '<Para xinfo:a = "1" role="x">say xinfo:b="2" here '}
    text = F.col("text")
    for old, new in change.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return RP.strip_xinfo(_topics(spark, sf_dir)[0].withColumn("text", text))


@query("page_list_items", r"""WITH u AS (SELECT page_id AS doc_id, instr(html, '<ul') - 1 AS start, regexp_extract(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS t FROM pages WHERE contains(html, '<ul'))
SELECT doc_id, start, '<itemizedlist>' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '</?a(?:\s[^<>]*)?>', '', 'g'), '>\s+<', '><', 'g'), '<li>\s*', '<listitem><para>', 'g'), '\s*</li>\s*', '</para></listitem>', 'g') || '</itemizedlist>' AS xml FROM u""")
def page_list_items(spark, sf_dir):
    docs = _pages(spark, sf_dir)
    return TR.convert_lists(docs, TG.outer_spans(TG.tag_stream(docs), ["ul", "ol"])).select("doc_id", "start", "xml")


@query("region_requests", """WITH r AS (SELECT c_custkey AS id, c_custkey % 90 AS x0, c_custkey % 70 AS x1, CASE c_custkey % 5 WHEN 0 THEN 'shape' WHEN 1 THEN 'list' ELSE 'table' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'table' END AS cont FROM customer)
SELECT id, x0 / 1.5 AS px0, CASE WHEN x1 <= x0 THEN 'empty region' WHEN kind = 'shape' THEN 'unknown kind' WHEN cont IS NOT NULL AND kind <> cont THEN 'other kind' END AS problem,
    CASE WHEN id % 4 = 0 THEN NULL WHEN x1 > x0 THEN 2 ELSE 1 END AS n_boxes, CASE WHEN x1 + 1 <= 40 THEN x1 + 1 END AS page FROM r""")
def region_requests(spark, sf_dir):
    c = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(c.alias("id"), (c % 90).cast("string").alias("x0"), (c % 70).cast("string").alias("x1"), F.when(c % 5 == 0, "shape").when(c % 5 == 1, "list").otherwise("table").alias("kind"), F.when(c % 3 == 0, "table").alias("cont"))
    x0, x1 = RQ.points(F.col("x0")), RQ.points(F.col("x1"))
    raw = F.concat(F.lit("[[0, 0, 3, 3], ["), "x0", F.lit(", 0, "), "x1", F.when(F.col("id") % 4 == 0, "]]").otherwise(", 9]]"))
    return rows.select("id", x0.alias("px0"), RQ.region_problem(x0, F.lit(0.0), x1, F.lit(1.0), F.col("kind"), F.col("cont")).alias("problem"), F.when(RQ.erase_rects(raw).isNotNull(), F.size(RQ.erase_rects(raw))).alias("n_boxes"), RQ.page_number(F.lit(""), (F.col("x1").cast("int") + 1).cast("string"), F.lit(40)).alias("page"))



@query("continuation_state", """WITH e AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'arm' WHEN 4 THEN 'done' ELSE 'append' END AS action FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN action <> 'append' THEN action END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'arm', false) AS continuing FROM e)
SELECT event_id, continuing, action = 'append' AND NOT continuing AS rejected FROM s""")
def continuation_state(spark, sf_dir):
    k = F.col("event_id") % 5
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", F.when(k == 0, "arm").when(k == 4, "done").otherwise("append").alias("action"))
    return RQ.continuation_state(events, "user_id", "event_id").select("event_id", "continuing", "rejected")


@query("last_region", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_region(spark, sf_dir):
    return RQ.latest(_table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("ocr_review_apply", f"""WITH {_PROFILE_SQL}, b AS (SELECT img_id, body_row, col, text FROM body WHERE col = 1) SELECT img_id, body_row, col, CASE WHEN img_id % 2 = 0 THEN 'edited ' || body_row ELSE text END AS text, img_id % 2 = 0 AS accepted FROM b""")
def ocr_review_apply(spark, sf_dir):
    reviewed = R.review(_readings(spark, sf_dir)).filter("col = 1").withColumn("why", F.array(F.lit("check")))
    edits = reviewed.select("img_id", "body_row", "col", F.when(F.col("img_id") % 2 == 0, F.concat(F.lit(" edited  "), "body_row")).otherwise(F.repeat(F.lit("x"), 2001)).alias("new_text"))
    return R.apply_edits(reviewed, edits)


@query("readings_merge", f"WITH {_READ_SQL} SELECT img_id, row, col, text || CASE WHEN row % 3 = 0 THEN '!' ELSE ' ' END AS alt, row % 3 <> 0 AS agree, least(conf, 0.93) AS conf FROM cells")
def readings_merge(spark, sf_dir):
    a = _readings(spark, sf_dir)
    b = a.select("img_id", "row", "col", F.concat("text", F.when(F.col("row") % 3 == 0, "!").otherwise(" ")).alias("text"), F.lit(0.93).alias("conf"))
    return R.merge_readings(a, b).select("img_id", "row", "col", "alt", "agree", "conf")


@query("header_snap")
def header_snap(spark, sf_dir):
    texts = _table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.lit(" NQ.")).alias("text"))
    return R.snap_headers(texts, ["ITEM NO.", "PART NO.", "QTY", "STANDARD NO."])


@query("raster_ink", """WITH p AS (SELECT n_nationkey AS img_id, y, CASE WHEN (y // 4 + n_nationkey) % 3 = 0 AND x % 2 = 0 THEN 20 + x ELSE 230 - y END AS v FROM nation, range(0, 24) AS a(y), range(0, 32) AS b(x))
SELECT img_id, y, count(*) FILTER (v < 100) AS ink FROM p GROUP BY ALL""")
def raster_ink(spark, sf_dir):
    y = F.col("y")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("img_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("y"))
    dark = (F.floor(y / 4) + F.col("img_id")) % 3 == 0
    pixels = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: F.when(dark & (x % 2 == 0), 20 + x).otherwise(230 - y))
    return RA.row_ink(rows.withColumn("pixels", pixels)).select("img_id", F.col("y").cast("long").alias("y"), F.col("ink").cast("long").alias("ink"))


@query("watermark_ops", "SELECT n_nationkey AS doc_id, n_nationkey % 3 <> 0 AS possible, CASE n_nationkey % 3 WHEN 0 THEN 'BT (COPY) Tj (COPY) Tj ET' WHEN 1 THEN 'BT  (' || n_name || ') Tj ET' ELSE 'BT  ET BT (COPYCAT) Tj ET' END AS data FROM nation")
def watermark_ops(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    data = F.when(k == 0, "BT (COPY) Tj (COPY) Tj ET").when(k == 1, F.concat(F.lit("BT (COPY) Tj ("), "n_name", F.lit(") Tj ET"))).otherwise("BT [(CO) -20 <50 59>] TJ ET BT (COPYCAT) Tj ET")
    streams = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("xref"), data.cast("binary").alias("data"))
    return SM.remove_line(streams, "COPY").select("doc_id", "possible", F.col("data").cast("string").alias("data"))


@query("styled_paragraphs")
def styled_paragraphs(spark, sf_dir):
    """No SQL: an ordered string_agg of every word takes too long on whole tables; tests hold it against brute force."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # Few splits of a file hold many texts, so these are dealt before they are cut into words, which then stay where they are.
    docs = docs.repartition(parts_for(spark, docs.count(), 2_000), "doc_id")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    spans = words.select("doc_id", "i", F.concat("w", F.lit(" ")).alias("text"), (F.col("i") % 5).isin(1, 2).alias("bold"), (F.col("i") % 7 == 3).alias("italic"))
    return L.styled_paragraphs(spans, ["doc_id"], "i")


@query("download_names", r"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'cropped' ELSE regexp_replace(p_name, '[\\/:*?"<>|]', '', 'g') END AS name FROM part""")
def download_names(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 7 == 0, "/?.png").otherwise(F.concat(F.lit("a/"), "p_name", F.lit(".png")))
    return _table(spark, sf_dir, "part").select("p_partkey", T.download_name(F.regexp_replace(raw, r"\Aa/", "")).alias("name"))

# ---------------------------------------------------------------- more of requests, sources and streams

@query("watermark_runs", """WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 8 AS k, p_name AS n FROM part)
SELECT doc_id, k IN (0, 1, 2, 3, 5) AS possible, CASE k WHEN 0 THEN 'q BT  0 -14 Td  ET (' || n || ') Tj' WHEN 1 THEN 'BT (' || n || ') Tj  ET' WHEN 2 THEN 'BT ET BT   /F1 9 Tf  ET' WHEN 3 THEN 'BT (' || n || ') Tj ET'
    WHEN 4 THEN 'BT (COPY) Tj ET BT (COPY) Tj ET' WHEN 5 THEN 'BT <5> Tj  ET' WHEN 6 THEN 'BT (CO) Tj ET BT (PY) Tj ET' ELSE 'BT (COPYCAT) Tj ET' END AS data FROM p""")
def watermark_runs(spark, sf_dir):
    """Operators between the shows stay; a page whose layout has no such line needs nothing removed (k = 3, whose stream does not draw it)."""
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    data = (
        F.when(k == 0, F.concat(F.lit("q BT (CO) Tj 0 -14 Td (PY) Tj ET ("), name, F.lit(") Tj")))
        .when(k == 1, F.concat(F.lit("BT ("), name, F.lit(") Tj [(C) 3 (O) -20 <50 59>] TJ ET")))
        .when(k == 2, "BT ET BT (C) Tj (OP) Tj /F1 9 Tf (Y) Tj ET")
        .when(k == 3, F.concat(F.lit("BT ("), name, F.lit(") Tj ET")))
        .when(k == 4, "BT (COPY) Tj ET BT (COPY) Tj ET")
        .when(k == 5, "BT <5> Tj <43 4F5059> Tj ET")
        .when(k == 6, "BT (CO) Tj ET BT (PY) Tj ET")
        .otherwise("BT (COPYCAT) Tj ET")
    )
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("xref"), data.cast("binary").alias("data"))
    lines = parts.select("doc_id", "page", F.when(F.col("doc_id") % 8 == 3, "other").otherwise("COPY").alias("text"))
    return SM.remove_line(parts, "COPY", lines).select("doc_id", "possible", F.col("data").cast("string").alias("data"))


@query("exact_lines", f"WITH {_LAYOUT_SQL} SELECT doc_id, line FROM lay WHERE text IN (SELECT min(text) FROM lay WHERE length(text) > 3) AND abs(dir_x - 1.0) <= 0.01")
def exact_lines(spark, sf_dir):
    lines = _layout(spark, sf_dir)
    text = lines.filter(F.length("text") > 3).agg(F.min("text")).first()[0]
    return SM.exact_lines(lines, text, dir_x=1.0).select("doc_id", "line")


@query("judge_fragments", """SELECT conv_id AS token, turn, CASE WHEN turn % 5 <> 4 THEN turn % 5 IN (0, 3) END AS valid FROM conversations""")
def judge_fragments(spark, sf_dir):
    k = F.col("turn") % 5
    xml = F.when(k == 0, "<para>a <b>c</b> &amp; <br/></para>").when(k == 1, "<b></i>").when(k == 2, "<para>a & b</para>").otherwise("<a></a><a>x</a>")
    rows = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), (k == 4).alias("empty"), xml.alias("xml"))
    return RQ.judge_fragments(rows, "id").select(F.col("id.conv_id").alias("token"), F.col("id.turn").alias("turn"), "valid")


@query("empty_results", """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(text) = '' WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS empty FROM conversations""")
def empty_results(spark, sf_dir):
    k = F.col("turn") % 4
    kind = F.when(k == 0, "paragraph").when(k == 1, "list").when(k == 2, "table").otherwise("image")
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", RQ.is_empty_result(kind, F.array("text"), F.array(F.lit(" "), F.lit(None).cast("string"))).alias("empty"))


@query("pending_matches", "SELECT o_orderkey AS token, o_orderkey % 3 AS page, o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 AS accepted FROM orders")
def pending_matches(spark, sf_dir):
    token = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders")
    pending = orders.filter(token % 2 == 0).select(token.alias("token"), F.lit(1).cast("long").alias("page"))
    return RQ.pending_matches(pending, orders.select(token.alias("token"), (token % 3).alias("page")))


@query("legal_pages", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE ' ' || text END AS text FROM documents""")
def legal_pages(spark, sf_dir):
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Terms <!-- draft\n-->\n"), "text")).otherwise(F.concat(F.lit("<!-- a --> <!-- # b\n -->"), "text"))
    return MK.legal_page(_table(spark, sf_dir, "documents").select("doc_id", marked.alias("text")))


@query("matched_tags", f"""WITH src AS (SELECT page_id, html AS h FROM pages), {_TAGS_SQL}, s1 AS (SELECT *, sum(CASE WHEN is_close THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id, name ORDER BY start) AS s FROM tags WHERE NOT is_self)
SELECT o.doc_id, o.name, o.start, (SELECT min(c.start) FROM s1 c WHERE c.doc_id = o.doc_id AND c.name = o.name AND c.start > o.start AND c.s < o.s) AS p_start FROM s1 o WHERE NOT o.is_close UNION ALL SELECT doc_id, name, start, stop FROM tags WHERE is_self""")
def matched_tags(spark, sf_dir):
    return TG.matched(TG.tag_stream(_pages(spark, sf_dir))).select("doc_id", "name", "start", "p_start")


@query("crop_boxes", """SELECT p_partkey, CAST(floor((greatest(x0, 20) - 20) * 4) AS INT) AS px0, CAST(floor((least(x0 + 30, 100) - 20) * 4 + 0.5) AS INT) AS px1 FROM (SELECT p_partkey, p_partkey % 140 + 0.3 AS x0 FROM part) WHERE p_partkey % 5 <> 0 AND floor((least(x0 + 30, 100) - 20) * 4 + 0.5) > floor((greatest(x0, 20) - 20) * 4)""")
def crop_boxes(spark, sf_dir):
    x0, zero = F.col("p_partkey") % 140 + 0.3, F.lit(0.0)
    image = {"x0": F.lit(20.0), "y0": zero, "x1": F.lit(100.0), "y1": F.lit(50.0), "skew": F.when(F.col("p_partkey") % 5 == 0, 1.0).otherwise(0.0), "masked": F.lit(False)}
    box = L.crop_box(x0, zero, x0 + 30, F.lit(50.0), image, F.lit(320), F.lit(100))
    return _table(spark, sf_dir, "part").select("p_partkey", box.alias("box")).filter("box is not null").select("p_partkey", F.col("box.x0").alias("px0"), F.col("box.x1").alias("px1"))


@query("table_rows", """WITH c AS (SELECT l_orderkey AS table_id, l_linenumber AS row, c AS col, l_linenumber = 1 AS head, CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN '' ELSE l_partkey || '&' || c END AS t, 1 + (l_orderkey + c) % 2 AS colspan FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), range(0, 2) AS a(c)),
r AS (SELECT table_id, row, head, string_agg(CASE WHEN head THEN '<th' ELSE '<td' END || CASE WHEN colspan > 1 THEN ' colspan="2"' ELSE '' END || '><para>' || replace(t, '&', '&amp;') || CASE WHEN head THEN '</para></th>' ELSE '</para></td>' END, '' ORDER BY col) AS x FROM c GROUP BY ALL HAVING max(t) <> ''),
s AS (SELECT *, head AND count(*) FILTER (NOT head) OVER (PARTITION BY table_id) > 0 AS is_head FROM r)
SELECT table_id, coalesce(string_agg('<tr>' || x || '</tr>', '' ORDER BY row) FILTER (is_head), '') AS head, coalesce(string_agg('<tr>' || x || '</tr>', '' ORDER BY row) FILTER (NOT is_head), '') AS body FROM s GROUP BY 1""")
def table_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row")).agg(F.min("l_partkey").alias("part")).withColumn("col", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when((F.col("table_id") + F.col("row")) % 4 == 0, "").otherwise(F.concat("part", F.lit("&"), "col"))
    cells = rows.select("table_id", "row", "col", (F.col("row") == 1).alias("is_header"), text.alias("text"), (1 + (F.col("table_id") + F.col("col")) % 2).alias("colspan"), F.lit(1).alias("rowspan"))
    return TB.emit_rows(cells).select("table_id", F.array_join("head", "").alias("head"), F.array_join("body", "").alias("body"))


@query("layout_scan", f"WITH {_LAYOUT_SQL} SELECT doc_id, line, block, x0, y0, dir_x, font, flags, text FROM lay")
def layout_scan(spark, sf_dir):
    """Spans of nested pages, one a line here; the pages are written and read as JSON documents would be."""
    line = F.struct(F.array("x0", "y0", "x1", "y1").alias("bbox"), F.array("dir_x", "dir_y").alias("dir"), F.array(F.struct(F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "font", "flags")).alias("spans"))
    blocks = _layout(spark, sf_dir).groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("l")))).alias("lines"))
    block = F.struct("block", F.struct(F.transform("lines", lambda x: x["l"]).alias("lines")).alias("b"))
    pages = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")).select("doc_id", F.lit(1).alias("page"), F.transform("blocks", lambda x: x["b"]).alias("blocks"))
    rows = pages.select(F.from_json(F.to_json(F.struct("*")), LY.PAGE).alias("p")).select("p.*")
    return LY.layout_spans(rows).select("doc_id", F.col("line").cast("long").alias("line"), F.col("block").cast("long").alias("block"), "x0", "y0", "dir_x", "font", "flags", "text")


@query("redacted_lines", f"WITH {_LAYOUT_SQL} SELECT doc_id, line, contains(text, 'an') AS redacted, CASE WHEN contains(text, 'an') THEN left(text, instr(text, 'an') - 1) || '  ' || substr(text, instr(text, 'an') + 2) ELSE text END AS text FROM lay")
def redacted_lines(spark, sf_dir):
    return SM.redact_lines(_layout(spark, sf_dir), "an").select("doc_id", "line", "redacted", "text")


@query("redaction_boxes", """WITH c AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part), w AS (SELECT *, substr(p_name, i, 1) AS c, 3.0 + ord(substr(p_name, i, 1)) % 5 AS w FROM c),
x AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM w)
SELECT p_partkey AS doc_id, min(x0) AS x0, max(x0 + w) AS x1, min(10.0 - i % 2) AS y0, max(18.0 + i % 3) AS y1, count(*) AS n FROM x WHERE instr(p_name, 'ol') > 0 AND i BETWEEN instr(p_name, 'ol') AND instr(p_name, 'ol') + 1 GROUP BY p_partkey""")
def redaction_boxes(spark, sf_dir):
    """Names as lines of characters, two to a span, each as wide as its letter says."""
    letters = _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", "")).alias("i", "c")).filter("c <> ''")
    width = F.lit(3.0) + F.ascii("c") % 5
    before = F.coalesce(F.sum(width).over(Window.partitionBy("p_partkey").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n = F.col("i") + 1
    chars = letters.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("line"), F.floor(F.col("i") / 2).alias("span"), (F.col("i") % 2).alias("pos"), "c", before.alias("x0"), (F.lit(10.0) - n % 2).alias("y0"), (before + width).alias("x1"), (F.lit(18.0) + n % 3).alias("y1"))
    return SM.redaction_boxes(chars, "ol").select("doc_id", "rect.x0", "rect.x1", "rect.y0", "rect.y1", F.size("boxes").cast("long").alias("n"))


@query("masked_ink", """WITH p AS (SELECT n_nationkey AS img_id, y, x, CASE WHEN (y // 4 + n_nationkey) % 3 = 0 AND x % 2 = 0 THEN 20 + x ELSE 230 - y END AS v FROM nation, range(0, 24) AS a(y), range(0, 32) AS b(x))
SELECT img_id, y, count(*) FILTER (v < 100 AND x < y) AS ink FROM p GROUP BY ALL""")
def masked_ink(spark, sf_dir):
    y = F.col("y")
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("img_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("y"))
    dark = (F.floor(y / 4) + F.col("img_id")) % 3 == 0
    place = F.sequence(F.lit(0), F.lit(31))
    pixels = rows.withColumn("pixels", F.transform(place, lambda x: F.when(dark & (x % 2 == 0), 20 + x).otherwise(230 - y)))
    mask = rows.withColumn("on", F.transform(place, lambda x: x < y))
    return RA.masked_ink(pixels, mask).select("img_id", y.cast("long").alias("y"), F.col("ink").cast("long").alias("ink"))


def _table_images(spark, sf_dir) -> tuple[DataFrame, int]:
    """A small picture of a table for each customer, with or without rules; the text of its cells differs in place, width and height. Customers are dealt before pictures are made of them; also how many parts these need."""

    @F.arrow_udf("array<int>")
    def drawn(keys: pa.Array, lines: pa.Array) -> pa.Array:
        k, y, x = keys.to_numpy()[:, None], lines.to_numpy()[:, None], np.arange(72)[None]
        between = lambda v, low, high: (v >= low) & (v <= high)
        upright = (k % 4 != 0) & between(y, 2, 41) & ((x == 3) | (x == 68) | (x == 25 + k % 5) | ((k % 2 == 0) & (x == 26 + k % 5)))
        flat = (k % 4 != 0) & ((y == 2) | (y == 41)) & between(x, 3, 68)
        first = between(y, 7, 14) & (((k % 3 != 1) & between(x, 8, 12 + k % 9)) | ((k % 6 != 2) & between(x, 34, 36 + k % 20)))
        second = (k % 7 != 0) & between(y, 20, 27 + k % 6) & (((k % 5 != 3) & between(x, 9, 11 + k % 7)) | between(x, 40, 40 + k % 11))
        speck = (x == 50) & (y == 17) | (y == 33 + k % 5) & (x % 3 == 0)
        pixels = np.where(upright | flat | first | second | speck, 20 + k % 50, 255).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(pixels) + 1) * 72, pa.int32()), pa.array(pixels.ravel()))

    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img_id"))
    parts = parts_for(spark, customers.count() * 44)
    rows = customers.repartition(parts).select("img_id", F.explode(F.sequence(F.lit(0), F.lit(43))).alias("y"))
    return rows.withColumn("pixels", drawn("img_id", "y")), parts


@query("segmented_cells", """WITH p AS (SELECT c_custkey AS k, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM customer, range(44) AS a(y), range(72) AS b(x)
    WHERE (c_custkey % 4 <> 0 AND y BETWEEN 2 AND 41 AND (x IN (3, 68) OR x = 25 + c_custkey % 5 OR (c_custkey % 2 = 0 AND x = 26 + c_custkey % 5)))
    OR (c_custkey % 4 <> 0 AND y IN (2, 41) AND x BETWEEN 3 AND 68)
    OR (y BETWEEN 7 AND 14 AND ((c_custkey % 3 <> 1 AND x BETWEEN 8 AND 12 + c_custkey % 9) OR (c_custkey % 6 <> 2 AND x BETWEEN 34 AND 36 + c_custkey % 20)))
    OR (c_custkey % 7 <> 0 AND y BETWEEN 20 AND 27 + c_custkey % 6 AND ((c_custkey % 5 <> 3 AND x BETWEEN 9 AND 11 + c_custkey % 7) OR x BETWEEN 40 AND 40 + c_custkey % 11))
    OR (x = 50 AND y = 17) OR (y = 33 + c_custkey % 5 AND x % 3 = 0)),
h AS (SELECT k, y, x FROM (SELECT *, count(*) OVER (PARTITION BY k, y, i) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY k, y ORDER BY x) AS i FROM p)) WHERE n >= 20),
v AS (SELECT k, y, x FROM (SELECT *, count(*) OVER (PARTITION BY k, x, i) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY k, x ORDER BY y) AS i FROM p)) WHERE n >= 15),
profile AS (SELECT 'v' AS kind, k, x AS pos, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'h', k, y, count(*) FROM h GROUP BY ALL),
full_ AS (SELECT *, pos - row_number() OVER (PARTITION BY kind, k ORDER BY pos) AS i FROM (SELECT *, max(n) OVER (PARTITION BY kind, k) AS most FROM profile) WHERE n > 0.5 * most),
peaks AS (SELECT kind, k, (min(pos) + max(pos)) // 2 AS peak FROM full_ GROUP BY kind, k, i),
frame AS (SELECT c_custkey AS k, count(*) FILTER (kind = 'v') >= 2 AS grid, CASE WHEN count(*) FILTER (kind = 'h') >= 2 THEN min(peak) FILTER (kind = 'h') ELSE 0 END AS top, CASE WHEN count(*) FILTER (kind = 'h') >= 2 THEN max(peak) FILTER (kind = 'h') ELSE 43 END AS bottom
    FROM customer LEFT JOIN peaks ON k = c_custkey GROUP BY 1),
cols AS (SELECT k, peak AS x FROM peaks JOIN frame USING (k) WHERE kind = 'v' AND grid UNION ALL SELECT k, unnest([0, 71]) FROM frame WHERE NOT grid),
spans AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS col, x + 2 AS x0, greatest(after - 2, x + 3) AS x1 FROM (SELECT *, lead(x) OVER (PARTITION BY k ORDER BY x) AS after FROM cols) WHERE after IS NOT NULL),
wide AS (SELECT DISTINCT k, y + dy AS y, x + dx AS x FROM (SELECT * FROM h UNION SELECT * FROM v), unnest([-1, 0, 1]) AS a(dy), unnest([-1, 0, 1]) AS b(dx)),
clean AS (SELECT * FROM p ANTI JOIN wide USING (k, y, x)),
square AS (SELECT k, y, x FROM clean SEMI JOIN (SELECT k, y, x - 1 AS x FROM clean) USING (k, y, x) SEMI JOIN (SELECT k, y - 1 AS y, x FROM clean) USING (k, y, x) SEMI JOIN (SELECT k, y - 1 AS y, x - 1 AS x FROM clean) USING (k, y, x)),
inner_ AS (SELECT k, min(x) + 3 AS lo, max(x) - 3 AS hi FROM cols GROUP BY k),
ink AS (SELECT DISTINCT k, y + dy AS y, x + dx AS x FROM square, unnest([0, 1]) AS a(dy), unnest([0, 1]) AS b(dx)),
inside AS (SELECT ink.* FROM ink JOIN frame USING (k) JOIN inner_ USING (k) WHERE y BETWEEN top AND bottom AND x BETWEEN lo AND hi),
lines AS (SELECT k, y, y - row_number() OVER (PARTITION BY k ORDER BY y) AS i FROM (SELECT k, y FROM inside GROUP BY k, y HAVING count(*) >= 3)),
run AS (SELECT k, min(y) AS a, max(y) AS b FROM lines GROUP BY k, i),
joined AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a) AS band FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY k ORDER BY a) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM run)),
band AS (SELECT k, min(a) AS a, max(b) AS b FROM joined GROUP BY k, band HAVING max(b) - min(a) >= 5),
rows_ AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY a) - 1 AS row, coalesce((lag(b) OVER (PARTITION BY k ORDER BY a) + a) // 2, top) AS y0, coalesce((b + lead(a) OVER (PARTITION BY k ORDER BY a)) // 2, bottom + 1) AS y1 FROM band JOIN frame USING (k)),
cells AS (SELECT k, row, col, y0, y1, x0, x1, grid FROM rows_ JOIN spans USING (k) JOIN frame USING (k)),
inked AS (SELECT k, row, col, count(*) AS n FROM cells JOIN inside USING (k) WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL)
SELECT k AS img_id, row, col, y0, y1, x0, x1, coalesce(n, 0) < 20 AS empty, grid FROM cells LEFT JOIN inked USING (k, row, col)""")
def segmented_cells(spark, sf_dir):
    images, parts = _table_images(spark, sf_dir)
    return SG.segment_tables(images, parts=parts)


# The same queries under the names by which they first read whole texts.
for _name in ("page_ref_flag", "region_filter", "line_in_cell_join", "styled_paragraphs"):
    QUERIES[f"{_name}_whole"] = QUERIES[_name]
    if _name in SQL:
        SQL[f"{_name}_whole"] = SQL[_name]
