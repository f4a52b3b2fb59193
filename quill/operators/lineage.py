"""Cutting the lineage of tables that several parts of a result read, and dealing texts out once for all that is done by text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_KEPT: list[tuple[str, str | None]] = []


def parts_for(spark: SparkSession, rows: int, each: int = 100_000) -> int:
    """How many parts a table of so many rows is dealt to: the session's shuffle partitions, more where parts would hold over `each` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quill-"))
    return _OWN[0]


def cut(frame: DataFrame, key: str | None = None, parts: int | None = None) -> DataFrame:
    """The table as computed once and written in columns to the checkpoint folder that the cluster names (spark.checkpoint.dir), so that plans over it stay short and lost executors cost nothing. Where no folder is named, as in tests on a local master, it is a temporary one of this process. With a key it is bucketed by it: windows, groupings and joins that hold the key then shuffle nothing, provided that they have the same parts; a table that is dealt by the key and as many parts already is written as it lies. The files stay until clear()."""
    spark = frame.sparkSession
    name = f"quill_{uuid.uuid4().hex}"
    path = f"{_folder(spark)}/{name}"
    if key is None:
        frame.write.parquet(path)
        _KEPT.append((path, None))
        return spark.read.schema(frame.schema).parquet(path)
    parts = parts or parts_for(spark, 0)
    frame.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    _KEPT.append((path, name))
    return spark.table(name)


@contextmanager
def met_by_text(spark: SparkSession) -> Iterator[None]:
    """While it lasts, tables that are both dealt by a text's id meet by (id, place) without being dealt again. For what is cut() inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clear(spark: SparkSession) -> None:
    """Deletes what cut() wrote. For callers that have used or saved all results, which are read from there."""
    while _KEPT:
        path, name = _KEPT.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
