"""Operator 12: hard negatives by a Voronoi-partitioned distributed kNN join.

Largest inner products become nearest neighbours by one more component: a row x gets
sqrt(M - |x|^2), M being the largest |x|^2 of all rows, and an anchor q gets 0, so that
|q' - x'|^2 = |q|^2 + M - 2 qx. Rows go to the nearest of some pivots, drawn from the rows.

1. Anchors meet the rows of their own cell. The k-th best score there bounds the distance
   at which a partner can be.
2. By the triangle inequality, a row at distance r from its cell's pivot can only serve an
   anchor at distance d from that pivot if r lies within d less and d plus that bound, and
   not so near that it scores above the wanted scores. The least and greatest of these over
   a group of anchors are the bounds of group and cell, and a row is replicated to the
   groups whose bounds hold its distance.
3. In blocks of a group of anchors and a part of its candidates, exact inner products are
   taken batch by batch, keeping the best k for each anchor; the blocks' lists are merged.

This join runs twice: for the positives, and for the negatives in the window of scores that
each positive opens. Scores are exact: in floating point while M < 2^53, else in integers.
Where bounds do not tell rows apart, every group gets every row; groups are made only as
anchors fill them (`group_anchors`, at least `least_groups`), and a task holds one group of
anchors and a batch of rows.

Rows with a null vec_id, label or vector, with a null or non-finite component, or with
components so large that a score could exceed a long (floor(256 x) of 2^31 or more, or a
sum of squares of 2^62 or more) take no part. Shorter vectors are padded with zeros. Rows
with the anchor's vec_id are not its partners; one vec_id is listed once for each score it
reaches. Repeated anchors are one; rows of an anchor's vec_id with other vectors or labels
are anchors of their own. Scores below zero have no window, so no negatives. An empty
table, and one without anchors, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm.common import intermediates, materialize, slices, table

LOW, HIGH = -(2**63), 2**63 - 1
_FOUND = "anchor_id long, anchor_key long, window int, score long, vec_id long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of int, all of one length), norm (its square) of the rows that take part, of (vec_id, label, embedding)."""
    x = F.transform("embedding", lambda c: c.cast("double") * 256)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(F.forall("x", lambda c: F.coalesce((c >= -(2.0**31)) & (c < 2.0**31), F.lit(False))))
    rows = rows.filter(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.floor(c).cast("double") * F.floor(c).cast("double")) < 2.0**62)
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c).cast("int")).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(longest) - F.size("v")))
    rows = rows.select("vec_id", "label", padded.alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long")))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each point to each pivot."""
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


class Partition:
    """The Voronoi partition of rows (vec_id, label, v, norm): pivots (at most n, in the augmented space), the largest norm, and `rows` with their cell, its pivot's distance and a running number that deals them evenly."""

    def __init__(self, rows: DataFrame, pivots: int = 64):
        spark = rows.sparkSession
        self.most = rows.agg(F.max("norm")).first()[0] or 0
        drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(12)), "vec_id", "label", "v").limit(pivots).select("v", "norm").collect()
        self.pivots = np.unique([[*r["v"], np.sqrt(self.most - r["norm"])] for r in drawn], axis=0) if drawn else np.zeros((0, 1))
        self.shared = shared = spark.sparkContext.broadcast((self.pivots, float(self.most)))  # a bounded number of rows

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, most = shared.value
            count = TaskContext.get().partitionId() * 7919
            for batch in slices(batches, 4096):
                norm = batch.column(3).to_numpy()
                points = np.column_stack([_matrix(batch.column(2), float), np.sqrt(most - norm)])
                far = _distances(points, pivots)
                cell = far.argmin(axis=1)
                salt = np.arange(count, count + len(cell))
                count += len(cell)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(cell)), cell]), pa.array(salt)], [*batch.schema.names, "cell", "far", "salt"])

        self.rows = materialize(rows.select("vec_id", "label", "v", "norm").mapInArrow(place, "vec_id long, label long, v array<int>, norm long, cell int, far double, salt long"), "cells")
        self.sizes = dict(self.rows.groupBy("cell").count().collect())  # a row a cell
        self.total = sum(self.sizes.values())
        self.slack = 1e-6 * (1 + float(self.most)) ** 0.5  # distances are rounded


def local_joins(blocks: DataFrame, same: bool, k: int, exact: bool) -> DataFrame:
    """The best k partners of each window of each anchor of a block (block, row, vec_id, label, v, key, lows, highs): anchors come first, then rows, batch by batch. A partner has the anchor's label, or another one, and another vec_id."""
    kind = np.float64 if exact else np.int64

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in slices(batches, 1024):
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])) + 1
            for low, high in zip([0, *change], [*change, batch.num_rows]):
                part = batch.slice(low, high - low)
                if ids[low] != block:
                    if held is not None:
                        yield from held.best()
                    held, block = _Anchors(same, k, kind), ids[low]
                held.meet(part) if rows[low] else held.add(part)
        if held is not None:
            yield from held.best()

    return blocks.mapInArrow(join, _FOUND)


class _Anchors:
    """A block's anchors with their best k so far, one list for each window."""

    def __init__(self, same: bool, k: int, kind: type):
        self.same, self.k, self.kind, self.parts, self.ready = same, k, kind, [], False

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _open(self) -> None:
        whole = pa.Table.from_batches(self.parts).combine_chunks()
        column = lambda n: whole.column(n).chunk(0)
        self.vectors = _matrix(column("v"), self.kind)
        self.ids, self.labels, self.keys = (column(n).to_numpy() for n in ("vec_id", "label", "key"))
        # Windows of all anchors in one list, with the anchor's place.
        self.count = np.diff(column("lows").offsets.to_numpy())
        self.of = np.repeat(np.arange(len(self.ids)), self.count)
        self.number = np.arange(len(self.of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.lows, self.highs = (column(n).flatten().to_numpy() for n in ("lows", "highs"))
        self.score = np.full((len(self.of), self.k), LOW, np.int64)
        self.who = np.full((len(self.of), self.k), HIGH, np.int64)
        self.parts, self.ready = [], True

    def meet(self, batch: pa.RecordBatch) -> None:
        if not self.ready:
            if not self.parts:
                return
            self._open()
        vectors, ids, labels = _matrix(batch.column(4), self.kind), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        step = 1024
        for at in range(0, len(self.of), step):
            windows = slice(at, at + step)
            low, high = self.of[windows][0], self.of[windows][-1] + 1
            scores = np.rint(self.vectors[low:high] @ vectors.T).astype(np.int64) if self.kind is np.float64 else self.vectors[low:high] @ vectors.T
            allowed = ((self.labels[low:high, None] == labels[None, :]) == self.same) & (self.ids[low:high, None] != ids[None, :])
            near = self.of[windows] - low
            scores, allowed = scores[near], allowed[near]
            allowed &= (scores >= np.maximum(self.lows[windows], self.score[windows, -1])[:, None]) & (scores <= self.highs[windows][:, None])
            self._take(at, scores, allowed, ids)

    def _take(self, at: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] > self.k and allowed.sum() > 8 * self.k * len(scores):
            # A batch with many: only what reaches a window's k-th best different row can stay. Repeated rows of one vec_id count once.
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True
            kth = np.partition(np.where(allowed & once, scores, LOW), scores.shape[1] - self.k, axis=1)[:, -self.k]
            allowed &= scores >= kth[:, None]
        window, row = np.nonzero(allowed)
        if not len(window):
            return
        touched = np.unique(window)
        old = np.repeat(touched, self.k)
        place = np.concatenate([old, window]) + at
        score = np.concatenate([self.score[touched + at].ravel(), scores[window, row]])
        who = np.concatenate([self.who[touched + at].ravel(), ids[row]])
        order = np.lexsort((who, ~score, place))
        place, score, who = place[order], score[order], who[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (score[1:] != score[:-1]) | (who[1:] != who[:-1])
        place, score, who = place[new], score[new], who[new]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        rank = np.arange(len(place)) - np.repeat(begin, np.diff(begin, append=len(place)))
        keep = rank < self.k
        self.score[touched + at], self.who[touched + at] = LOW, HIGH
        self.score[place[keep], rank[keep]], self.who[place[keep], rank[keep]] = score[keep], who[keep]

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.ready:
            for at in range(0, len(self.of), 8192):
                score, who = self.score[at : at + 8192], self.who[at : at + 8192]
                window, rank = np.nonzero(who != HIGH)
                of = self.of[at + window]
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[of]), pa.array(self.keys[of]), pa.array(self.number[at + window], pa.int32()), pa.array(score[window, rank]), pa.array(who[window, rank])], [f.split()[0] for f in _FOUND.split(", ")])


def _blocks(anchors: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Anchors and rows of numbered blocks, a block a partition, anchors first."""
    none = F.lit(None).cast("array<long>")
    a = anchors.select("block", F.lit(False).alias("row"), "vec_id", "label", "v", "key", "lows", "highs")
    r = rows.select("block", F.lit(True).alias("row"), "vec_id", "label", "v", F.lit(0).cast("long").alias("key"), none.alias("lows"), none.alias("highs"))
    return a.unionByName(r).repartitionById(n, F.col("block")).sortWithinPartitions("block", "row")


def _split(sizes: dict[int, int], most: float) -> dict[int, tuple[int, int]]:
    """For each key the first of its numbers and how many it has: one for each `most` of its size."""
    out, at = {}, 0
    for key in sorted(sizes):
        n = max(1, int(np.ceil(sizes[key] / most)))
        out[key] = at, n
        at += n
    return out


def _numbered(of: dict[int, tuple[int, int]], cell: Column, i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v[i])]), cell)


def windowed_join(anchors: DataFrame, space: Partition, same: bool, k: int, least_groups: int = 4, group_anchors: int = 100_000) -> DataFrame:
    """anchor_id, anchor_key, window, score, vec_id, rank: for each window (lows, highs: arrays of scores, both ends included) of each anchor (vec_id, label, v, norm, cell, key), its best k partners among the rows of the partition."""
    spark, shared, most, slack = anchors.sparkSession, space.shared, space.most, space.slack
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = dict(anchors.groupBy("cell").count().collect())  # a row a cell
    if not sizes:
        return spark.createDataFrame([], _FOUND + ", rank int")
    # 1. The own cell, cut into parts of like size.
    home = _split({c: space.sizes.get(c, 0) for c in sizes}, max(1, space.total / parallel))
    part = F.pmod(F.col("salt"), _numbered(home, F.col("cell"), 1)).cast("int")
    near = space.rows.filter(F.col("cell").isin(*sizes)).withColumn("block", _numbered(home, F.col("cell"), 0) + part)
    at = anchors.withColumn("block", F.explode(F.sequence(_numbered(home, F.col("cell"), 0), _numbered(home, F.col("cell"), 0) + _numbered(home, F.col("cell"), 1) - 1)))
    exact = most < 2**53
    found = local_joins(_blocks(at, near, sum(n for _, n in home.values())), same, k, exact)
    best = found.groupBy("anchor_id", "anchor_key", "window").agg(F.slice(F.sort_array(F.collect_set(F.struct("score", "vec_id")), False), 1, k).alias("best"))
    floor = best.filter(F.size("best") == k).groupBy("anchor_id", "anchor_key").agg(F.map_from_entries(F.collect_list(F.struct("window", F.element_at("best", -1)["score"]))).alias("floors"))
    # 2. Groups of anchors of neighbouring cells, and the bounds of each group and cell.
    groups = _split(sizes, max(1.0, min(group_anchors, -(-sum(sizes.values()) // least_groups))))
    group = _numbered(groups, F.col("cell"), 0) + F.pmod(F.xxhash64("vec_id", F.lit(2)), _numbered(groups, F.col("cell"), 1)).cast("int")
    merged = _grouped(groups, sizes, least_groups, group_anchors)
    group = _numbered({g: (m, 1) for g, m in merged.items()}, group, 0)
    known = anchors.join(floor, (anchors["vec_id"] == floor["anchor_id"]) & (anchors["key"] == floor["anchor_key"]), "left")
    low = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("floors", i), F.lit(LOW))))
    known = materialize(known.select("vec_id", "label", "v", "norm", "key", "lows", "highs", group.alias("group"), F.array_min(low).alias("least"), F.array_max("highs").alias("greatest")), "anchors")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, top = shared.value
        for batch in slices(batches, 4096):
            norm, least, greatest = (batch.column(i).to_numpy() for i in (2, 3, 4))
            away = _distances(np.column_stack([_matrix(batch.column(1), float), np.zeros(batch.num_rows)]), pivots)
            reach = lambda s: np.sqrt(np.maximum(norm + top - 2.0 * s, 0))
            outer = np.where(least == LOW, np.inf, reach(least))[:, None] + slack
            inner = np.where(greatest == HIGH, 0, reach(greatest))[:, None] - slack
            low, high = np.maximum(away - outer, inner - away), away + outer
            of = batch.column(0).to_numpy()
            for g in np.unique(of):
                mine = of == g
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pivots), g), pa.int32()), pa.array(np.arange(len(pivots)), pa.int32()), pa.array(low[mine].min(axis=0)), pa.array(high[mine].max(axis=0))], ["group", "cell", "low", "high"])

    bounds = known.select("group", "v", "norm", "least", "greatest").mapInArrow(bound, "group int, cell int, low double, high double")
    bounds = materialize(bounds.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")), "bounds")
    # 3. Candidates of each group, in as many parts as make the blocks even; the bounds are a row a group and pivot.
    n_groups = max(merged.values()) + 1
    parts = max(1, -(-parallel // n_groups))
    held = bounds.withColumnRenamed("cell", "of")
    sent = space.rows.join(F.broadcast(held), (F.col("cell") == F.col("of")) & F.col("far").between(F.col("low"), F.col("high")))
    block = F.col("group") * parts
    sent = sent.withColumn("block", block + F.pmod(F.col("salt"), F.lit(parts)).cast("int"))
    at = known.withColumn("block", F.explode(F.sequence(block, block + (parts - 1))))
    found = local_joins(_blocks(at, sent, n_groups * parts), same, k, exact)
    order = Window.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("score"), "vec_id")
    # Repeated rows can be dealt to several blocks.
    return found.dropDuplicates().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grouped(split: dict[int, tuple[int, int]], sizes: dict[int, int], least_groups: int, group_anchors: int) -> dict[int, int]:
    """Puts the numbers of _split, in order of their cells, together into groups of like size."""
    most = max(1.0, min(group_anchors, -(-sum(sizes.values()) // least_groups)))
    out, group, held = {}, 0, 0.0
    for cell in sorted(split):
        first, n = split[cell]
        for i in range(n):
            if held and held + sizes[cell] / n > most:
                group, held = group + 1, 0.0
            out[first + i] = group
            held += sizes[cell] / n
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, k_positive: int = 5, k_negative: int = 5, percent: int = 80, pivots: int = 64, least_groups: int = 4, group_anchors: int = 100_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, label, embedding). `anchor` picks the anchors; negatives score at least `percent` of the positive and no more than it."""
    space = Partition(integer_vectors(vectors), pivots)
    whole = lambda x: F.array(F.lit(x).cast("long"))
    anchors = space.rows.filter(anchor).dropDuplicates(["vec_id", "label", "v"]).withColumn("key", F.xxhash64("label", "v"))
    positives = windowed_join(materialize(anchors.withColumns({"lows": whole(LOW), "highs": whole(HIGH)}), "wanted"), space, True, k_positive, least_groups, group_anchors)
    positives = materialize(positives.filter("score >= 0").withColumn("window", F.col("rank") - 1).select("anchor_id", "anchor_key", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Windows in order of rank; of the scores, which are whole, the least that reaches the share.
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda p: p["positive_score"])
    wanted = positives.groupBy("anchor_id", "anchor_key").agg(ranked.alias("highs"))
    wanted = wanted.withColumn("lows", F.transform("highs", lambda p: F.ceil(p.cast("decimal(20,0)") * percent / 100).cast("long")))
    asked = anchors.join(wanted, (anchors["vec_id"] == wanted["anchor_id"]) & (anchors["key"] == wanted["anchor_key"])).drop("anchor_id", "anchor_key")
    negatives = windowed_join(materialize(asked, "wanted"), space, False, k_negative, least_groups, group_anchors)
    negatives = negatives.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
    return negatives.join(positives, ["anchor_id", "anchor_key", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    with intermediates(spark, "hard-negatives"):
        found = hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
        return materialize(found, "hard-negatives")


OP12_SQL = """
WITH given AS (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
