"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of distinct 5-word shingles under one hash. Items are put
into size classes (powers of two). An item of q shingles that a document contains to at
least the threshold t misses at most floor((1 - t) q) of them, so of the item's smallest
floor((1 - t) q) + 1 hashes, its bottom-m MinHash signature, at least one is in the
document: m is set by the size class, and the search misses nothing, however long the
document is (a signature of the document, as plain MinHash takes it, would lose short
items in long documents). The search joins the shingles of all documents with the
signatures alone; a pair of document and item with a hit, in a document with the words
that the item's class needs, is a candidate. Only documents with a candidate are read
again, and only candidate pairs are counted against the whole items, exactly.

Signatures and item shingles are rows of fixed width; a table is broadcast while its
counted rows, at `row_bytes` each in memory, are within `broadcast_bytes`, and joined by
a shuffle beyond that. DataFrame functions only.

Words are runs without ASCII white space, A-Z in lower case; a text of fewer than five
words is one shingle. Null or empty text: an empty set, which contains and is contained
in nothing. Null ids are kept as such. Repeated rows give one row an item; items of one id
with several texts are several items. Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import materialize, row_key, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A text's words; null has none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + "\t\n\x0b\x0c\r", _LOWER + "     ")
    return F.array_remove(F.split(plain, " "), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def word_runs(hashes: Column, size: int = 5) -> Column:
    """A struct of each `size` hashes in a row; fewer are one run with nulls, none give none. `hashes` must be a plain column, as it is used several times."""
    n = F.size(hashes)
    fields = ", ".join(f"w{i}: bigint" for i in range(size))
    whole = F.arrays_zip(*[F.slice(hashes, F.lit(i + 1), n - size + 1) for i in range(size)]).cast(f"array<struct<{fields}>>")
    short = F.array(F.struct(*[F.get(hashes, F.lit(i)).alias(f"w{i}") for i in range(size)]))
    return F.when(n >= size, whole).when(n > 0, short).otherwise(F.array().cast(f"array<struct<{fields}>>"))


def exploded_shingles(docs: DataFrame, *columns: str) -> DataFrame:
    """columns and hash of (columns, hashes): a row for each shingle; its hash is taken of the exploded run, in generated code."""
    runs = docs.select(*columns, F.explode(word_runs(F.col("hashes"))).alias("run"))
    return runs.withColumn("hash", F.xxhash64(*[F.col(f"run.w{i}") for i in range(5)])).drop("run")


def _item_shingles(items: DataFrame) -> DataFrame:
    rows = items.select(F.col("item_id"), word_hashes(words(F.col("text"))).alias("hashes")).select("item_id", word_runs(F.col("hashes")).alias("runs"))
    rows = rows.select("item_id", F.array_distinct(F.transform("runs", lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(5)]))).alias("hashes")).filter(F.size("hashes") > 0)
    return rows.select("item_id", F.xxhash64("hashes").alias("item_key"), F.size("hashes").alias("q"), "hashes").dropDuplicates(["item_id", "item_key"])


def item_signatures(whole: DataFrame, percent: int) -> DataFrame:
    """item_id, item_key, least_words, hash: the bottom-m signature of each item of _item_shingles. Every item of a size class has the signature length that the class's largest size needs."""
    smallest = F.pow(F.lit(2.0), F.length(F.bin("q")) - 1)
    m = F.least(F.col("q"), F.floor((100 - percent) * (2 * smallest - 1) / 100).cast("int") + 1)
    least_words = F.ceil(percent * smallest / 100).cast("long")
    return whole.select("item_id", "item_key", least_words.alias("least_words"), F.explode(F.slice(F.array_sort("hashes"), F.lit(1), m)).alias("hash"))


def _bounded(rows: DataFrame, broadcast_bytes: int, row_bytes: int = 96) -> DataFrame:
    """A written table, marked for broadcasting if its rows are few enough."""
    return F.broadcast(rows) if row_bytes * rows.count() <= broadcast_bytes else rows


def candidate_pairs(docs: DataFrame, signatures: DataFrame) -> DataFrame:
    """doc_id, row_key, item_id, item_key for each document of (doc_id, text) and item whose signature it hits."""
    split = docs.select("doc_id", row_key().alias("row_key"), word_hashes(words(F.col("text"))).alias("hashes"))
    shingles = exploded_shingles(split.withColumn("n_words", F.size("hashes")), "doc_id", "row_key", "n_words")
    hits = shingles.join(signatures, "hash").filter(F.col("n_words") >= F.col("least_words"))
    return hits.select("doc_id", "row_key", "item_id", "item_key").distinct()


def shared_shingles(docs: DataFrame, candidates: DataFrame, members: DataFrame, broadcast_bytes: int) -> DataFrame:
    """doc_id, row_key, item_id, item_key, q, n_shared for the candidate pairs, by exact counts of members (item_id, item_key, q, hash)."""
    names = {"item_id": "c_item", "item_key": "c_key", "doc_id": "c_doc", "row_key": "c_row"}
    wanted = candidates.select(*[F.col(c).alias(n) for c, n in names.items()])
    met = materialize(wanted.select("c_doc", "c_row").distinct(), "candidate-documents")
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (row_key() == F.col("c_row"))
    found = docs.join(_bounded(met, broadcast_bytes), same, "left_semi").select("doc_id", row_key().alias("row_key"), word_hashes(words(F.col("text"))).alias("hashes"))
    shingles = exploded_shingles(found, "doc_id", "row_key")
    pair = (F.col("row_key") == F.col("c_row")) & (F.col("item_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_doc")) & F.col("item_id").eqNullSafe(F.col("c_item"))
    hits = shingles.join(members, "hash").join(_bounded(wanted, broadcast_bytes), pair, "left_semi").distinct()  # repeated rows hit once
    return hits.groupBy("doc_id", "row_key", "item_id", "item_key", "q").agg(F.count("*").alias("n_shared"))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id) for each item of (item_id, text) of whose distinct shingles a document of (doc_id, text) has at least `percent`: with n_item, n_shared, containment and the document's row_key."""
    docs = docs.select("doc_id", "text")
    whole = materialize(_item_shingles(items), "items")
    signatures = materialize(item_signatures(whole, percent), "item-signatures")
    members = materialize(whole.select("item_id", "item_key", "q", F.explode("hashes").alias("hash")), "item-shingles")
    candidates = materialize(candidate_pairs(docs, _bounded(signatures, broadcast_bytes)), "candidates")
    pairs = shared_shingles(docs, candidates, _bounded(members, broadcast_bytes), broadcast_bytes)
    found = pairs.filter(100 * F.col("n_shared") >= percent * F.col("q"))
    return found.select("doc_id", "item_id", F.col("q").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"), "row_key")


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


OP10_SQL = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), shingles AS (
    SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
    SELECT id, count(*) AS q FROM shingles WHERE side = 'i' GROUP BY id
), shared AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM shingles d JOIN shingles i ON d.s = i.s WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, q AS n_item, n_shared, n_shared / q AS containment FROM shared JOIN sizes ON id = item_id WHERE 100 * n_shared >= 80 * q
"""
