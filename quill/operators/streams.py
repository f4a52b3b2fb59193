"""Text drawn in page content streams: which operators draw a given line, and streams without it.

Streams are read as Latin-1 text, one character a byte, so offsets are the bytes' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.functions.text import pdf_string_bytes
from quill.operators.repairs import splice

# Text blocks, the operators that show strings, and strings, as the page format writes them.
BLOCK = r"(?s)\bBT\b.*?\bET\b"
STRING = r"(?s)\([^()\\]*+(?:\\.[^()\\]*+)*+\)|<[0-9A-Fa-f\s]*>"
SHOW = r"(?s)(?:\[[^\]]*\]|\([^()\\]*+(?:\\.[^()\\]*+)*+\)|<[0-9A-Fa-f\s]*>)\s*(?:TJ|Tj)"

_STREAM = ["doc_id", "page", "xref"]
#: Stands for an operand that has no bytes; no Latin-1 text holds it.
_UNREADABLE = "\ufffd"


def distinct_streams(records: DataFrame) -> DataFrame:
    """The streams (doc_id, page, ordinal, xref, data) of each page, each xref once, where it is first named; records without data go."""
    own = Window.partitionBy(*_STREAM).orderBy("ordinal")
    return records.filter("data is not null").withColumn("nth", F.row_number().over(own)).filter("nth = 1").drop("nth")


def _pieces(text: Column, pattern: str) -> Column:
    """The matches of a pattern with the gap before each, in order."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap"))


def _placed(rows: DataFrame, text: Column, pattern: str, keys: list[str], base: Column, name: str) -> DataFrame:
    """A row for each match: keys, `name` (its number), start and end counted from `base`, and match. Running sums over matches and gaps are exact offsets."""
    found = rows.select(*keys, base.alias("base"), F.posexplode(_pieces(text, pattern)).alias(name, "piece")).select(*keys, "base", name, "piece.match", "piece.gap").filter("match is not null")
    upto = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum(F.length("gap") + F.length("match")).over(upto)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).drop("base", "gap")


def shown_strings(streams: DataFrame) -> DataFrame:
    """doc_id, page, xref, block, i, start, end, shown: the show operators of each text block and the Latin-1 text that they draw."""
    text = streams.filter("data is not null").select(*_STREAM, F.decode("data", "ISO-8859-1").alias("text"))
    blocks = _placed(text, F.col("text"), BLOCK, _STREAM, F.lit(0).cast("long"), "block")
    shows = _placed(blocks, F.col("match"), SHOW, [*_STREAM, "block"], F.col("start"), "i")
    strings = F.regexp_extract_all("match", F.lit(STRING), F.lit(0))
    one = lambda s: F.coalesce(F.decode(pdf_string_bytes(s), "ISO-8859-1"), F.lit(_UNREADABLE))
    return shows.select(*_STREAM, "block", "i", "start", "end", F.array_join(F.transform(strings, one), "").alias("shown"))


def line_runs(shows: DataFrame, text: str) -> DataFrame:
    """doc_id, page, xref, block, first, last: runs of neighbouring show operators of a block that together draw the text; for each first the nearest last. A run begins where the block's joined text goes on with the text, and ends where an operator ends at that length further."""
    key = [*_STREAM, "block"]
    own = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = shows.withColumn("to", F.sum(F.length("shown")).over(own)).withColumn("from", F.col("to") - F.length("shown"))
    joined = shows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "shown"))), lambda s: s["shown"]), "").alias("whole"))
    n = len(text)
    begins = placed.join(joined, key).filter(F.substring(F.col("whole"), (F.col("from") + 1).cast("int"), F.lit(n)) == text).select(*key, F.col("i").alias("first"), (F.col("from") + n).alias("to"))
    ends = placed.select(*key, F.col("i").alias("last"), "to")
    return begins.join(ends, [*key, "to"]).filter("last >= first").groupBy(*key, "first").agg(F.min("last").alias("last"))


def remove_line(streams: DataFrame, text: str, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, xref, data) with `possible` and `data` without the show operators that draw `text`; what stands between them stays. A page can do without the line where exactly one run in its streams draws it, or, if its layout lines (doc_id, page, text) are given, where no line is the text (then nothing is removed) and not where several are; other pages stay as they are."""
    if not text:
        return streams.select(*_STREAM, F.lit(True).alias("possible"), "data")
    shows = shown_strings(streams)
    runs = line_runs(shows, text)
    pages = streams.select("doc_id", "page").distinct()
    pages = pages.join(runs.groupBy("doc_id", "page").agg(F.count("*").alias("n_runs")), ["doc_id", "page"], "left")
    one_run = F.coalesce(F.col("n_runs") == 1, F.lit(False))
    if lines is None:
        pages = pages.select("doc_id", "page", one_run.alias("possible"), one_run.alias("cuts"))
    else:
        drawn = exact_lines(lines, text).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))
        n = F.coalesce("n_lines", F.lit(0))
        pages = pages.join(drawn, ["doc_id", "page"], "left").select("doc_id", "page", ((n == 0) | ((n == 1) & one_run)).alias("possible"), ((n == 1) & one_run).alias("cuts"))
    cut = shows.join(runs.join(pages.filter("cuts"), ["doc_id", "page"], "left_semi"), [*_STREAM, "block"]).filter("i between first and last")
    edits = cut.select(F.struct(*_STREAM).alias("stream"), "start", "end", F.lit("").alias("new"))
    rows = streams.join(pages.drop("cuts"), ["doc_id", "page"]).withColumns({"stream": F.struct(*_STREAM), "text": F.decode("data", "ISO-8859-1")})
    return splice(rows, edits, "stream").select(*_STREAM, "possible", F.encode("text", "ISO-8859-1").alias("data"))


def exact_lines(lines: DataFrame, text: str, dir_x: float | None = None, dir_y: float | None = None, tolerance: float = 0.01) -> DataFrame:
    """Lines of a page layout that are the text exactly, along a direction if one is given."""
    rows = lines.filter(F.col("text") == text)
    for column, value in (("dir_x", dir_x), ("dir_y", dir_y)):
        if value is not None:
            rows = rows.filter(F.abs(F.col(column) - value) <= tolerance)
    return rows


def redact_lines(lines: DataFrame, text: str, fill: str = " ") -> DataFrame:
    """Lines with the first place of the text in each filled, and `redacted`, whether there was one; other places stay."""
    line = F.col("text")
    at = F.instr(line, text)
    hidden = F.concat(F.substring(line, F.lit(1), at - 1), F.lit(fill * len(text)), F.substring(line, at + len(text), F.length(line)))
    found = F.coalesce((at > 0) & F.lit(bool(text)), F.lit(False))
    return lines.withColumns({"redacted": found, "text": F.when(found, hidden).otherwise(line)})


def redaction_boxes(chars: DataFrame, text: str) -> DataFrame:
    """doc_id, page, line, boxes, rect for the lines that hold the text, of characters (doc_id, page, line, span, pos, c, x0, y0, x1, y1): the boxes of the characters of its first place, in order, and the rectangle around them. A line's characters are put in order by span and pos; what is looked for may run over spans. An empty text is nowhere."""
    box = F.struct("span", "pos", "c", F.struct("x0", "y0", "x1", "y1").alias("box"))
    lines = chars.groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(box)).alias("chars"))
    whole = F.array_join(F.transform("chars", lambda c: c["c"]), "")
    found = lines.withColumn("at", F.instr(whole, text)).filter((F.col("at") > 0) & F.lit(bool(text)))
    boxes = F.transform(F.slice("chars", F.col("at"), F.lit(max(1, len(text)))), lambda c: c["box"])
    side = lambda name: F.transform("boxes", lambda b: b[name])
    rect = F.struct(F.array_min(side("x0")).alias("x0"), F.array_min(side("y0")).alias("y0"), F.array_max(side("x1")).alias("x1"), F.array_max(side("y1")).alias("y1"))
    return found.withColumn("boxes", boxes).select("doc_id", "page", "line", "boxes", rect.alias("rect"))
