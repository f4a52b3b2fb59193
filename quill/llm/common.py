"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, as in tests on a local master, one temporary folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quill-"))
    return _OWN[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this process wrote to the shared folder. For callers that have used or saved all results, which are read from there."""
    while _SCRATCH:
        remove(spark, _SCRATCH.pop())


@contextmanager
def intermediates(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Deletes the scratch paths that are asked for inside, once it ends without an error, but for those of a kept name: for work whose result reads the kept tables alone."""
    before = len(_SCRATCH)
    yield
    for path in _SCRATCH[before:]:
        if path.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in kept:
            _SCRATCH.remove(path)
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through Hadoop's file systems."""
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def make_dir(spark: SparkSession, path: str) -> None:
    """A folder for files of tasks, so that it is there even if no task has rows."""
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target)


#: Rows that Spark hands to Python at a time. Its default of 10,000 is meant for rows of a few bytes; of whole texts that is tens of megabytes, held by the JVM, the pipe and the worker at once.
ARROW_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_ROWS rows, unless it has set its own. Results are the same for any size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, for queries over whole texts."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number for a row's id and text, to tell rows apart whose doc_id is null or repeated."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def without(docs: DataFrame, rejected: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns, whose (doc_id, row_key) is not among the rejected. These are written and counted; while they fit broadcast_bytes, at 64 bytes each, they go to the texts, beyond that both are shuffled."""
    out = materialize(rejected.select(F.col("doc_id").alias("_rejected_id"), F.col("row_key").alias("_rejected_key")), "rejected")
    same = (row_key() == F.col("_rejected_key")) & F.col("doc_id").eqNullSafe(F.col("_rejected_id"))
    small = 64 * out.count() <= broadcast_bytes
    return docs.join(F.broadcast(out) if small else out, same, "left_anti")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path, usable in a task: local (mounted) folders, S3, GCS or HDFS, as pyarrow resolves them."""
    return pafs.FileSystem.from_uri(uri)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that Python objects exist for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class WordCoder:
    """Maps words to byte strings and joins them; the first `limit` words seen are remembered, later ones are coded again for each call."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = 400_000):
        self.encode_many, self.limit, self.known = encode_many, limit, {}

    def code(self, words: list) -> list[bytes]:
        found = list(map(self.known.get, words))
        at = [i for i, v in enumerate(found) if v is None]
        if at:
            missing = list(dict.fromkeys([words[i] for i in at]))
            new = dict(zip(missing, self.encode_many(missing)))
            for i in at:
                found[i] = new[words[i]]
            if len(self.known) < self.limit:
                self.known.update(new)
        return found
