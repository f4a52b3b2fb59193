"""The result store: versions, deletes, failed writes, compaction."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quill.sources import results as S


def put(spark, path, rows):
    S.save(spark.createDataFrame(rows, "token string, result string"), path)


def seen(spark, path):
    return {r.token: r.result for r in S.view(spark, path).collect()}


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_versions_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    assert seen(spark, path) == {}
    put(spark, path, [("a", "1"), ("b", "1"), ("c", "1")])
    old = files(path)
    put(spark, path, [("b", "2")])
    # Saving one key writes one row and leaves the other files.
    assert old.items() <= files(path).items() and seen(spark, path) == {"a": "1", "b": "2", "c": "1"}
    put(spark, path, [("c", None), ("d", None)])
    assert seen(spark, path) == {"a": "1", "b": "2"}
    put(spark, path, [("c", "3")])
    want = {"a": "1", "b": "2", "c": "3"}
    assert seen(spark, path) == want and S.vacuum(path) == 0
    S.compact(spark, path)
    assert seen(spark, path) == want and len(S._live(path)) == 1
    assert S.vacuum(path) == 4 and seen(spark, path) == want
    put(spark, path, [("a", "9")])
    assert seen(spark, path) == {**want, "a": "9"}
    S.save(spark.createDataFrame([], "token string, result string"), path)
    assert seen(spark, path) == {**want, "a": "9"}


def test_what_is_saved_during_a_compaction_stays_newer(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, [("a", "1"), ("b", "1")])
    names, old = [v["name"] for v in S.versions(path)], S.view(spark, path)
    put(spark, path, [("a", "2")])
    S.save(old, path, names)
    assert seen(spark, path) == {"a": "2", "b": "1"}


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, [("a", "1")])
    bad = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("token"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("x").alias("result"))
    before = files(path)
    with pytest.raises(Exception, match="broken"):
        S.save(bad, path)
    assert seen(spark, path) == {"a": "1"} and files(path) == before and len(S.versions(path)) == 1
