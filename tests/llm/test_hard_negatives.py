"""Operator 12 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quill.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every):
    given = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        if all(-(2**31) <= x < 2**31 for x in v) and sum(x * x for x in v) < 2**62:
            given.append((vec_id, label, tuple(v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a_id, a_label, a in set(given):
        if a_id % every:
            continue
        near = {s: set() for s in (True, False)}
        for b_id, b_label, b in given:
            if b_id != a_id:
                near[a_label == b_label].add((-dot(a, b), b_id))
        for p, p_id in sorted(near[True])[:5]:
            fit = [(n, i) for n, i in sorted(near[False]) if 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a_id, p_id, k, i, -p, -n) for k, (n, i) in enumerate(fit[:5], 1)]
    return sorted(out)


def check(spark, rows, every=4, **options):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, **options)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every)
    return got.count()


def clustered(n, d=6, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, d))
    return [(i, int(r.integers(0, 3)), [float(x) for x in np.float32(centres[i % 5] + 0.1 * r.normal(size=d))]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "group_anchors": 2}, {"pivots": 1, "least_groups": 1}])
def test_clusters(spark, options):
    assert check(spark, clustered(120), **options) > 50


def test_ties_repeated_rows_and_a_common_vector(spark):
    r = random.Random(5)
    rows = [(i, r.randint(0, 2), [0.5, 0.25, float(i % 3)]) for i in range(60)] + [(200 + i, i % 2, [0.5, 0.5, 0.5]) for i in range(40)]
    rows += [(8, 1, [0.5, 0.25, 2.0])] * 3 + [(8, 2, [0.1, 0.1, 0.1]), (201, 1, [0.9, 0.9, 0.9])] * 2
    assert check(spark, rows, 20, pivots=4) > 20


def test_edges(spark):
    assert check(spark, []) == 0
    assert check(spark, [(1, 1, [1.0])]) == 0
    rows = clustered(40, 3) + [(None, 1, [1.0] * 3), (4000, None, [1.0] * 3), (4004, 1, None), (4008, 1, [1.0, None, 2.0]), (4012, 1, [float("nan"), 1.0, 1.0]), (4016, 1, [float("inf"), 1.0, 1.0]), (4020, 1, [3e38, 1.0, 1.0]), (4024, 1, []), (4028, 2, [1.0]), (4032, 0, [0.0, 0.0, 0.0]), (4036, 0, [-1.0, -1.0, -1.0])]
    assert check(spark, rows, 4, pivots=5) > 0


def test_scores_beyond_floating_point_are_exact(spark):
    r = random.Random(2)
    rows = [(i, i % 2, [float(np.float32(r.uniform(0.5, 1) * 2**19)), float(np.float32(r.uniform(0.5, 1) * 2**20))]) for i in range(40)]
    assert H.Partition(H.integer_vectors(spark.createDataFrame(rows, SCHEMA))).most >= 2**53
    assert check(spark, rows) > 0


def test_bounds_keep_rows_from_groups_they_cannot_serve(spark):
    """Far clusters are sent to few groups, and the result is the same."""
    rows = [(i, i // 5 % 2, [10.0 * math.cos(i % 5 * 1.25), 10.0 * math.sin(i % 5 * 1.25), 0.01 * (i % 7)]) for i in range(400)]
    space = H.Partition(H.integer_vectors(spark.createDataFrame(rows, SCHEMA)), 10)
    assert len(space.pivots) > 3
    anchors = space.rows.filter("vec_id % 4 = 0").withColumn("key", F.lit(0).cast("long")).withColumns({"lows": F.array(F.lit(H.LOW)), "highs": F.array(F.lit(H.HIGH))})
    sent = []
    blocks = H._blocks
    try:
        H._blocks = lambda a, r, n: (sent.append(r.count()), blocks(a, r, n))[1]
        H.windowed_join(anchors, space, True, 5, least_groups=5).collect()
    finally:
        H._blocks = blocks
    assert sent[1] < 3 * len(rows)
    check(spark, rows, 4, least_groups=5, pivots=10)
