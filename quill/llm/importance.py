"""Operator 4: a quality classifier by importance resampling.

Two generative models of hashed word n-grams (single tokens and pairs of neighbours, in
one table of buckets) are counted: the raw model over every document, the target model
over labelled good ones (quality 1, not toxic). A document's log weight is the mean over
its n-grams of log p_target - log p_raw, divided by `temperature`: sums over whole texts
would put hundreds between documents of one kind, and no draw could then change their
order. k documents are sampled without replacement, in proportion to their weights, as the
k largest of log weight + Gumbel noise; noise is a hash of the row, so a run can be repeated.

The target model is fitted on a bounded sample of labelled rows, about `sample_rows`
chosen by a hash of doc_id; a third of the sample is left out of the fit. k is given, or a
given share of the documents that are not toxic, or else the number of those whose log
weight reaches the level that best parts good from bad rows of the left-out third (keeping
good ones counts `keep_good` times); which ones these k are is for the draw. The driver holds the table of
buckets and that third of the sample. The k-th largest key is found by histograms over
all keys, a few thousand counts at a time; ties with it are all kept.

A few toxic words barely move a sum over all n-grams, so a second ratio looks for them
alone: hashed n-grams that far more of the sample's toxic texts than of its other texts
hold (log ratio of the two shares, less `deviations` standard errors, above `least_ratio`).
A document's toxicity is the sum of these log ratios over the n-grams it holds; above the
cut that at most `toxic_loss` of the left-out texts that are not toxic pass, a document
is in no draw.

Null or empty text: no n-grams, log weight 0, toxicity 0. Null doc_id: sampled like
others, never labelled. Several labels of one document: the worst holds. Without labels
of both kinds all documents are kept that are not toxic; without toxic and other labels
none is toxic. Repeated rows are decided alike. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import intermediates, materialize, row_key, slices, table

_TOKENS = re.compile(r"\w+|[^\w\s]+")


def ngram_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a whole text's tokens and neighbouring pairs."""
    tokens = _TOKENS.findall(text or "")
    if not tokens:
        return np.zeros(0, np.uint64)
    one = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), "<u8")
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    two ^= two >> np.uint64(32)
    return np.concatenate([one, two])


def ngram_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def labelled_sample(labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, good, toxic, held for about sample_rows labelled documents; good is null for what is neither (quality 1, but toxic)."""
    worst = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).filter("quality is not null")
    worst = materialize(worst, "labels")
    share = sample_rows / max(1, worst.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < share * (1 << 20)
    good = F.when(F.col("quality") == 0, False).when(F.col("toxic") == 0, True)
    return worst.filter(drawn).select("doc_id", good.alias("good"), (F.col("toxic") > 0).alias("toxic"), (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).alias("held"))


def fit_ratio(docs: DataFrame, sample: DataFrame, buckets: int, smooth: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of every bucket. The target is smoothed towards the raw model, so unseen n-grams say little."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.filter("good and not held").select("doc_id", F.lit(True).alias("target"))), "doc_id", "left")  # bounded by the sample
    rows = rows.select("text", "target")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in slices(batches, 256):
            found = [ngram_buckets(ngram_hashes(t), buckets) for t in batch.column(0).to_pylist()]
            totals[0] += np.bincount(np.concatenate(found), minlength=buckets)
            chosen = [f for f, t in zip(found, batch.column(1).to_pylist()) if t]
            if chosen:
                totals[1] += np.bincount(np.concatenate(chosen), minlength=buckets)
        at = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "raw": totals[0][at], "target": totals[1][at]})

    counts = np.zeros((2, buckets))
    sums = rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = sums.toPandas()  # a row a bucket at most
    counts[0, found["bucket"]], counts[1, found["bucket"]] = found["raw"], found["target"]
    raw = (counts[0] + smooth) / (counts[0].sum() + smooth * buckets)
    return np.log((counts[1] + smooth * buckets * raw) / (counts[1].sum() + smooth * buckets)) - np.log(raw)


def toxic_ngrams(texts: DataFrame, deviations: float = 2.0, least_ratio: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log ratios of the n-grams that tell toxic texts from others, of (text, toxic). Only n-grams that would pass if no other text held them are looked for in the others."""
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not n_toxic or not n_other:
        return none

    def counted(rows: DataFrame, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        shared = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1024):
                found = np.concatenate([np.unique(ngram_hashes(t)) for t in batch.column(0).to_pylist()])
                found, n = np.unique(found, return_counts=True)
                if shared is not None:
                    mine = np.isin(found, shared.value, assume_unique=True)
                    found, n = found[mine], n[mine]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["hash", "n"])

        sums = rows.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        if only is None:
            sums = sums.filter(_excess(F.col("n"), n_toxic, F.lit(0), n_other, deviations) > least_ratio)
        got = sums.toPandas()  # n-grams of the bounded sample's toxic texts
        return got["hash"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)

    hashes, toxic = counted(texts.filter("toxic"), None)
    order = np.argsort(hashes)
    hashes, toxic, other = hashes[order], toxic[order], np.zeros(len(hashes), np.int64)
    if not len(hashes):
        return none
    met, n = counted(texts.filter("not toxic"), hashes)
    other[np.searchsorted(hashes, met)] = n
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    sure = ratio - deviations * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)) > least_ratio
    return hashes[sure], ratio[sure]


def _excess(toxic: Column, n_toxic: int, other: Column, n_other: int, deviations: float) -> Column:
    ratio = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((other + 0.5) / (n_other + 1))
    return ratio - deviations * F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))


def toxicity(hashes: np.ndarray, known: np.ndarray, ratio: np.ndarray) -> float:
    """The sum of the ratios of the known n-grams that are among a text's."""
    if not len(known):
        return 0.0
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return float(ratio[np.unique(at[known[at] == hashes])].sum())


def log_weights(docs: DataFrame, ratio: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], temperature: float) -> DataFrame:
    """doc_id, row_key, log_weight (a mean over n-grams, by temperature), toxicity of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((ratio, *toxic))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, excess = shared.value
        for batch in slices(batches, 256):
            found = [ngram_hashes(t) for t in batch.column(2).to_pylist()]
            means = [float(table[ngram_buckets(h, len(table))].mean()) / temperature if len(h) else 0.0 for h in found]
            evidence = [toxicity(h, known, excess) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(means, pa.float64()), pa.array(evidence, pa.float64())], ["doc_id", "row_key", "log_weight", "toxicity"])

    return docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text").mapInArrow(score, "doc_id long, row_key long, log_weight double, toxicity double")


def best_cut(good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """The lowest score from which the shares of good rows kept (times keep_good) and bad rows rejected are together largest."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    rejected = np.searchsorted(bad, cuts) / len(bad)
    k = int(np.argmax(keep_good * kept + rejected))
    below = bad[bad < cuts[k]]
    return float((cuts[k] + below[-1]) / 2) if len(below) else float(cuts[k])


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 4096) -> float:
    """The k-th largest value of a column without nulls, exactly. Each step counts at most `few` equal ranges and goes on in the one that holds it."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    if k >= n:
        return low
    while low < high and n > few:
        width = (high - low) / few
        if low + width == low:
            break
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(few - 1)).alias("place")
        counts = rows.filter(F.col(column).between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("place")).collect()
        for r in counts:
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    if low == high:
        return low
    # Few values are left, or they lie too close for ranges; the latter are counted value by value.
    left = rows.filter(F.col(column).between(low, high)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc(column)).collect()
    for r in left:
        if k <= r["n"]:
            return r[0]
        k -= r["n"]
    return low


def gumbel_noise(seed: int | Column) -> Column:
    """Standard Gumbel noise by a hash of the row (doc_id, row_key)."""
    u = (F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.lit(1 << 52)) + 0.5) / (1 << 52)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, sample_rows: int = 30_000, buckets: int = 1 << 17, keep_good: float = 3.0, toxic_loss: float = 0.001, seed: int = 0, temperature: float = 0.02, share: float | None = None) -> DataFrame:
    """doc_id, row_key, log_weight, toxicity, sample_key and kept for each row of (doc_id, text). k, or share of the rows that are not toxic: how many to draw; by default as many as reach the level that parts good from bad."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with intermediates(docs.sparkSession, "weights"):
        return _drawn(docs, labels, k, share, sample_rows, buckets, keep_good, toxic_loss, seed, temperature)


def _drawn(docs: DataFrame, labels: DataFrame, k: int | None, share: float | None, sample_rows: int, buckets: int, keep_good: float, toxic_loss: float, seed: int, temperature: float) -> DataFrame:
    sample = materialize(labelled_sample(labels, sample_rows), "labelled")
    texts = materialize(docs.join(F.broadcast(sample.filter("not held").select("doc_id", "toxic")), "doc_id").select("text", "toxic"), "labelled-texts")  # bounded by the sample
    scored = log_weights(docs, fit_ratio(docs, sample, buckets), toxic_ngrams(texts), temperature)
    scored = materialize(scored.withColumn("sample_key", F.col("log_weight") + gumbel_noise(seed)), "weights")
    held = scored.join(F.broadcast(sample.filter("held")), "doc_id").select("good", "toxic", "log_weight", "toxicity").toPandas()  # bounded by the sample
    clean = held["toxicity"][~held["toxic"].astype(bool)].to_numpy()
    most = float(np.quantile(clean, 1 - toxic_loss, method="higher")) if len(clean) else 0.0
    pool = F.col("toxicity") <= most
    if k is None and share is not None:
        k = round(share * scored.filter(pool).count())
    elif k is None:
        judged = held[held["good"].notna()]
        good = judged["good"].astype(bool)
        cut = best_cut(judged["log_weight"][good].to_numpy(), judged["log_weight"][~good].to_numpy(), keep_good)
        k = scored.filter(pool & (F.col("log_weight") >= cut)).count()
    least = kth_largest(scored.filter(pool), "sample_key", k) if k else None
    kept = F.lit(False) if least is None else pool & (F.col("sample_key") >= least)
    return scored.select("doc_id", "row_key", "log_weight", "toxicity", "sample_key", kept.alias("kept"))


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_weight", "toxicity", "sample_key", "kept")
