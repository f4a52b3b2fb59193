"""Operator 6: near-duplicates by a signature-coordinate inverted join.

A document is its set of distinct 5-word shingles (64-bit hashes of A-Z lower-cased
words; fewer words: the whole sequence as one shingle). Documents of one set are one
class and travel as one row. A class has a MinHash signature of K coordinates and is
posted under its coordinate-value pairs. Two classes that agree in at least `matches`
coordinates share one of the K - matches + 1 rarest pairs of either, so a class is
posted only under that prefix of its pairs by ascending frequency; pairs that one class
alone has are skipped, and a class with more of these than the prefix is long posts
nothing. For pairs that meet in a list the collisions are counted over both whole
signatures (128 bytes a class); only pairs with `matches` or more are retained, and only
these are joined to the full sets and confirmed on them.

Lists can be long (a large group of near copies), so not all pairs of a list are made:
in each round the most central class that a list has left (whose pairs are the most
frequent, as those of the original of a group are) meets the others, links are confirmed
and components merged (each round merges what the rounds before it made), and a list is
finished when its classes are one component. For the
lists left after `rounds` rounds, the exact prefix filter on whole shingle sets gives the
pairs across components that can still be links, and all of them are compared, so the
components are those of all links.

A link of similarity 0.85 is missed if fewer than 17 of 32 coordinates agree: about 1 in
100,000. Null or empty text: an empty set, linked with nothing. Null doc_id: linked with
nothing, component_id null, kept. Repeated rows are one class; both carry the same id.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.llm.common import intermediates, materialize, row_key, slices, table

K, MATCHES = 32, 17
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(6).integers(1, 2**32, K, dtype=np.uint32) | np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | bytes | None, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    data = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not data:
        return np.zeros(0, np.uint64)
    words = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, data)), "<u8")
    n, k = len(words), min(len(words), size)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _PRIME + words[i : n - k + 1 + i]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """K minima over 32-bit hash functions of the shingles."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 2**32 - 1, np.uint32)
    for at in range(0, len(high), 4096):
        x = high[None, at : at + 4096] * _MULTIPLIERS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out = np.minimum(out, x.min(axis=1))
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, digest (of the set; null for an empty one), signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, sig = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n_shingles", "digest", "signature"])

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(work, "doc_id long, row_key long, n_shingles long, digest binary, signature binary")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _coordinates(signatures: pd.Series) -> pd.Series:
    """Each coordinate-value pair as one number."""
    place = np.arange(K, dtype=np.int64) << 32
    return signatures.map(lambda b: np.frombuffer(b, "<u4").astype(np.int64) | place)


def _full_sets(docs: DataFrame, nodes: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """node, shingles for the classes in nodes (node, doc_id; a written table), from their first documents' texts. Nodes go to the texts while their counted rows, at 64 bytes each, are within broadcast_bytes; beyond that both are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingle_set(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            # Another text under the same doc_id is another class and not asked for.
            keep = [i for i, (a, b) in enumerate(zip(node, batch.column(0).to_pylist())) if a == b]
            yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["node", "shingles"])

    small = 64 * nodes.count() <= broadcast_bytes
    rows = docs.join(F.broadcast(nodes) if small else nodes, "doc_id").select("node", "text")
    return rows.mapInArrow(work, "node binary, shingles binary")


@F.pandas_udf(T.IntegerType())
def _collisions(sig_a: pd.Series, sig_b: pd.Series) -> pd.Series:
    """How many coordinates of two signatures are equal."""
    a, b = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), K) for s in (sig_a, sig_b))
    return pd.Series((a == b).sum(axis=1).astype(np.int32))


def _linked(percent: int):
    @F.pandas_udf("boolean")
    def linked(set_a: pd.Series, set_b: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(set_a, set_b):
            a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    return linked


def retained(pairs: DataFrame, signatures: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures (node, signature) agree in at least `matches` coordinates."""
    side = lambda x: signatures.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_collisions("sig_a", "sig_b") >= matches).select("a", "b")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of full (node, shingles) are at least `percent` similar."""
    side = lambda x: full.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_linked(percent)("set_a", "set_b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label for the nodes of edges (a, b): the smallest node of its component. Labels spread over edges and jump along labels until none changes."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = materialize(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) after new links (a, b): only components that a link joins are merged, nodes met for the first time are added."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    known = ends if labels is None else ends.join(labels, "node", "left_anti")
    known = known.select("node", F.col("node").alias("label"))
    labels = materialize(known if labels is None else labels.union(known), "labels")
    side = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(side("a"), "a").join(side("b"), "b").filter("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("further"))
    return materialize(labels.join(moved, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _numbers(shingles: pd.Series) -> pd.Series:
    return shingles.map(lambda b: np.frombuffer(b, "<i8"))


def _rest(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) across components that can still be links among nodes (node, n, label), by the exact prefix filter on whole sets.

    Shingles that only one component has are in no overlap across components. Of the others, by ascending frequency, two linked sets share one among the first n - ceil(percent n / 100) + 1 of either, and what stands behind the first one they share bounds their overlap."""
    rows = nodes.join(full.select("node", "shingles"), "node").select("node", "n", F.xxhash64("label").alias("label"), F.explode(_numbers("shingles")).alias("shingle"))
    across = rows.groupBy("shingle").agg(F.count("*").alias("often"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("shingle", "often")
    ordered = rows.join(across, "shingle").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("ordered"))
    alone = F.col("n") - F.size("ordered")
    take = (F.floor(F.col("n") * (100 - percent) / 100) + 1 - alone).cast("int")
    posts = ordered.filter(take > 0).select("node", "n", "label", alone.alias("alone"), F.posexplode(F.slice("ordered", F.lit(1), take)).alias("i", "s"))
    posts = materialize(posts.select("node", "n", "label", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("s.shingle").alias("shingle")), "prefixes")
    x, y = (posts.select(*[F.col(c).alias(f"{c}_{side}") for c in posts.columns]) for side in "xy")
    apart = (F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y"))
    enough = (100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y"))
    met = x.join(y, (F.col("shingle_x") == F.col("shingle_y")) & apart & _similar_size(F.col("n_x"), F.col("n_y"), percent) & enough)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, matches: int = MATCHES, rounds: int = 3) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept, digest (the class) and row_key."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with intermediates(docs.sparkSession, "shingle-sets", "components"):
        base = materialize(_sets(docs), "shingle-sets")
        # Written first, so that both sides of the join are dealt for it alone and a large group of copies can be split.
        ids = materialize(_class_components(docs, base, percent, matches, rounds), "components")
    found = base.select("doc_id", "row_key", "n_shingles", "digest").join(ids, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "digest", "row_key")


def _class_components(docs: DataFrame, base: DataFrame, percent: int, matches: int, rounds: int) -> DataFrame:
    """digest, component_id of every class: the smallest doc_id that its links reach."""
    named = base.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    first = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "classes")
    classes = named.join(first, ["digest", "doc_id"]).select(F.col("digest").alias("node"), F.col("n_shingles").alias("n"), "doc_id", "signature").dropDuplicates(["node"])
    classes = materialize(classes, "signatures")
    # Posting: the rarest pairs of each class.
    posted = classes.select("node", F.explode(_coordinates("signature")).alias("pair"))
    often = posted.groupBy("pair").agg(F.count("*").alias("often")).filter("often > 1")
    shared = posted.join(often, "pair").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "pair"))).alias("pairs"), F.sum("often").alias("central"))
    take = F.size("pairs") - (matches - 1)  # the prefix is K - matches + 1 long, the K - size rarest pairs stand alone
    prefix = shared.filter(take > 0).select("node", "central", F.explode(F.slice("pairs", F.lit(1), take)).alias("p"))
    sizes = classes.select("node", "n", "doc_id")
    posts = materialize(prefix.select("node", "central", F.col("p.pair").alias("pair")).join(sizes, "node"), "posts")
    # Only posted classes are compared; their number is known before their texts are asked for.
    nodes = materialize(posts.select("doc_id", "node").distinct(), "posted-classes")
    full = materialize(_full_sets(docs, nodes), "full-sets")
    signatures = materialize(classes.join(nodes.select("node"), "node", "left_semi").select("node", "signature"), "posted-signatures")

    labels = None
    lists = posts.select("pair", "node", "central", "n", F.col("node").alias("label"), F.lit(True).alias("fresh"))
    for k in range(rounds + 1):
        # A list is open while it has several components and a class that has not met all others.
        hub = F.max(F.struct("fresh", "central", "node", "n", "label")).alias("hub")
        state = lists.groupBy("pair").agg(F.min("label").alias("low"), F.max("label").alias("high"), hub)
        state = materialize(state.filter("low != high and hub.fresh").drop("low", "high"), "lists")
        if state.isEmpty():
            break
        last = k == rounds
        if last:
            pairs = _rest(lists.join(state.select("pair"), "pair").select("node", "n", "label").distinct(), full, percent)
        else:
            met = lists.join(state, "pair").filter((F.col("label") != F.col("hub.label")) & _similar_size(F.col("n"), F.col("hub.n"), percent))
            pairs = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        near = materialize(retained(pairs, signatures, matches), "retained")
        labels = merged(labels, materialize(confirmed(near, full, percent), "links"))
        if last:
            break
        used = state.select("pair", F.col("hub.node").alias("node"), F.lit(True).alias("used"))
        lists = lists.drop("label").join(labels, "node", "left").join(used, ["pair", "node"], "left")
        lists = materialize(lists.select("pair", "node", "central", "n", F.coalesce("label", "node").alias("label"), (F.col("fresh") & F.col("used").isNull()).alias("fresh")), "posts")
    if labels is None:
        return first.select("digest", F.col("doc_id").alias("component_id"))
    smallest = labels.join(first.select(F.col("digest").alias("node"), "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    grouped = labels.join(smallest, "label").select(F.col("node").alias("digest"), "component_id")
    return first.join(grouped, "digest", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest", "row_key")


OP6_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
