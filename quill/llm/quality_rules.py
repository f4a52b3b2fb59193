"""Operator 8: quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets base counts (words, symbols, lines with a word and repeated ones,
repeated 8-word windows). For every (lang, source) pair a KLL sketch of each measure is built by
partial aggregation; the sketches of a language's sources are merged for pairs with
too few documents, and all sketches for languages with too few. A document fails a
measure beyond a fence of its pair, q75 + factor * max(q75 - q25, spread), or q25 -
factor * max(...) below for the mean word length, where the spread is a least width
that keeps a pair of nearly equal documents from failing each other. The thresholds,
a row a pair, are joined to the measures; texts are read once and never shuffled.

Null text: no words, so the base rule fails it. Null lang or source is a value like any
other. Ties at a fence are kept. An empty table gives no rows; repeated rows are judged
alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import materialize, table

#: measure -> (least width of the quartile range, fails above the fence, fails below it)
MEASURES = {
    "symbol_share": (0.01, True, False),
    "dup_line_share": (0.1, True, False),
    "repeat_share": (0.05, True, False),
    "mean_word_chars": (0.6, True, True),
}


def _blank(text: Column) -> Column:
    """ASCII white space as plain spaces."""
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def base_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(_blank(text), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, " \t\n\x0b\x0c\r", "")) > 0)
    step = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    step = step.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
    )
    # A window's hash is taken of its words' hashes, each made once.
    fields = [f"w{i}" for i in range(window)]
    shifted = F.arrays_zip(*[F.slice("w", F.lit(i + 1), F.size("w") - window + 1) for i in range(window)]).cast(f"array<struct<{', '.join(f'{f}: bigint' for f in fields)}>>")
    step = step.withColumn("hashes", F.when(F.size("w") > window, F.transform(shifted, lambda x: F.xxhash64(*[x[f] for f in fields])))).drop("w")
    # Texts whose windows all differ end here; for others, equal hashes are neighbours once sorted.
    repeated = F.size("hashes") != F.size(F.array_distinct("hashes"))
    step = step.withColumn("pairs", F.when(repeated, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda i: F.get("pairs", i)["h"]
    twice = F.filter("pairs", lambda p, i: F.coalesce((p["h"] == at(i - 1)) | (p["h"] == at(i + 1)), p["h"] == at(i - 1), p["h"] == at(i + 1), F.lit(False)))
    step = step.withColumn("starts", F.array_sort(F.transform(twice, lambda p: p["i"])))
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("starts", zero, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(window), i - s["last"])).alias("n")))["n"]
    return step.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _measured(counts: DataFrame) -> DataFrame:
    words, chars, lines = (F.greatest(n, F.lit(1)) for n in ("n_words", "word_chars", "n_lines"))
    return counts.withColumns({
        "symbol_share": F.col("n_symbols") / chars, "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words, "mean_word_chars": F.col("word_chars") / words,
    })


def adaptive_thresholds(measured: DataFrame, factor: float = 3.0, least_docs: int = 50, k: int = 200) -> DataFrame:
    """Per (lang, source): low_<measure> and high_<measure>, from the sketches of the pair, of its language, or of all documents, whichever is the first with least_docs documents."""
    pairs = measured.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, k).alias(m) for m in MEASURES])
    langs = pairs.groupBy("lang").agg(F.sum("n").alias("n_lang"), *[F.kll_merge_agg_double(m, k).alias(f"lang_{m}") for m in MEASURES])
    whole = pairs.agg(*[F.kll_merge_agg_double(m, k).alias(f"all_{m}") for m in MEASURES])
    joined = pairs.alias("p").join(langs.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang"))).join(F.broadcast(whole))  # one row
    out = [F.col("p.lang").alias("lang"), F.col("source")]
    for m, (spread, above, below) in MEASURES.items():
        sketch = F.when(F.col("n") >= least_docs, F.col(m)).when(F.col("n_lang") >= least_docs, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
        quartile = lambda q, s=sketch: F.kll_sketch_get_quantile_double(s, F.lit(q))
        width = F.greatest(quartile(0.75) - quartile(0.25), F.lit(spread)) * factor
        out.append((quartile(0.25) - width if below else F.lit(float("-inf"))).alias(f"low_{m}"))
        out.append((quartile(0.75) + width if above else F.lit(float("inf"))).alias(f"high_{m}"))
    return joined.select(*out)


def quality_rules(docs: DataFrame, factor: float = 3.0, least_docs: int = 50) -> DataFrame:
    """The base counts of each document with base_failed and kept."""
    measured = _measured(materialize(base_counts(docs), "quality-counts"))
    judged = measured.filter("n_words >= 20")
    limits = adaptive_thresholds(judged, factor, least_docs)
    same = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    rows = measured.alias("d").join(limits.alias("t"), same, "left")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
