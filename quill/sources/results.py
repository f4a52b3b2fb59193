"""A store of result documents by key: append-only versions, the last of each key as the view, and compaction.

A save writes only the documents it is given, as files of its own run; committing is one small
manifest that names them, put in place by a rename. Until then, and if tasks fail, readers see the
old versions. A document that is deleted is saved as null. Compaction writes the view as one
version that stands where the versions it replaces end, so what is saved meanwhile stays newer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_SCHEMA = pa.schema([("token", pa.string()), ("result", pa.string())])


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Local (mounted) folders, with or without a scheme, S3, GCS or HDFS, as pyarrow resolves them."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class ResultWriter(DataSourceArrowWriter):
    """Tasks write files of this run; the driver commits them as one version or takes them away."""

    def __init__(self, options: dict):
        self.path, self.run, self.replaces = options["path"], uuid.uuid4().hex, json.loads(options.get("replaces", "[]"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context, fs_root, writer = TaskContext.get(), _open(self.path), None
        fs, root = fs_root
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.parquet"
        for batch in iterator:
            if writer is None and batch.num_rows:
                fs.create_dir(f"{root}/data/{self.run}", recursive=True)
                writer = pq.ParquetWriter(f"{root}/data/{self.run}/{name}", _SCHEMA, filesystem=fs)
            if batch.num_rows:
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.columns], schema=_SCHEMA))
        if writer is not None:
            writer.close()
        return _Written(name if writer is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/versions", recursive=True)
        known = versions(self.path)
        number = int(known[-1]["name"].split("-")[0]) + 1 if known else 1
        manifest = {"run": self.run, "files": sorted(m.file for m in messages if m is not None and m.file), "replaces": self.replaces}
        with fs.open_output_stream(f"{root}/versions/.{self.run}") as out:
            out.write(json.dumps(manifest).encode())
        fs.move(f"{root}/versions/.{self.run}", f"{root}/versions/{number:012d}-{self.run}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/data/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/data/{self.run}")


class ResultStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quill_results"

    def schema(self) -> str:
        return "token string, result string"

    def writer(self, schema, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options)


def versions(path: str) -> list[dict]:
    """The manifests by name: name, run, files, replaces. Two saves that commit at once may have one number; their runs order them."""
    fs, root = _open(path)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/versions", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with fs.open_input_stream(info.path) as source:
                found.append({"name": info.base_name.removesuffix(".json"), **json.loads(source.read())})
    return sorted(found, key=lambda v: v["name"])


def _live(path: str) -> list[dict]:
    """The versions that no compaction replaced, oldest first; a compaction stands where what it replaced ended."""
    found = versions(path)
    gone = {name for v in found for name in v["replaces"]}
    return sorted((v for v in found if v["name"] not in gone), key=lambda v: (max(v["replaces"], default=v["name"]), v["name"]))


def save(results: DataFrame, path: str, replaces: list[str] | None = None) -> None:
    """Appends a version of (token, result), one row a token; a null result deletes."""
    results.sparkSession.dataSource.register(ResultStore)
    rows = results.select(F.col("token").cast("string").alias("token"), F.col("result").cast("string").alias("result"))
    rows.write.format("quill_results").option("path", path).option("replaces", json.dumps(replaces or [])).mode("append").save()


def view(spark: SparkSession, path: str) -> DataFrame:
    """token, result: the last version of each token that is not deleted."""
    live = [v for v in _live(path) if v["files"]]
    if not live:
        return spark.createDataFrame([], "token string, result string")
    files = [f"{path}/data/{v['run']}/{f}" for v in live for f in v["files"]]
    order = F.create_map(*[F.lit(x) for k, v in enumerate(live) for x in (v["run"], k)])
    rows = spark.read.schema("token string, result string").parquet(*files).withColumn("at", order[F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]+)/[^/]+$", 1)])
    # A struct, as max_by would pass over nulls.
    last = rows.groupBy("token").agg(F.max_by(F.struct("result"), "at")["result"].alias("result"))
    return last.filter("result is not null")


def compact(spark: SparkSession, path: str) -> None:
    """Writes the view as one version. The files of what it replaces stay for those who read them; vacuum() takes them away."""
    names = [v["name"] for v in versions(path)]
    if names:
        save(view(spark, path), path, names)


def vacuum(path: str) -> int:
    """Deletes the files of replaced versions and of runs that never committed; no one may be writing or reading them. Returns how many runs went."""
    fs, root = _open(path)
    kept = {v["run"] for v in _live(path)}
    gone = [i for i in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)) if i.base_name not in kept]
    for info in gone:
        fs.delete_dir(info.path)
    return len(gone)
