"""Operator 1: token-id output in the Arrow file format with fixed-size-list batches.

The documents, in ascending (doc_id, hash of text) order, are dealt by range to
shards. A shard is one Arrow IPC file (the stream format between magic numbers, with
a footer that locates each batch): column `ids` is fixed_size_list<uint16>[seq_len],
column `mask` a dictionary of at most two fixed_size_list<uint8>[seq_len], of a full and of the padded
sequence (1 an id, 0 padding), so that a mask costs its number; all batches but the last hold the same
number of sequences, so sequence k is row k % rows of batch k // rows, read in place
from the mapped file. Documents follow each other without gaps; the last sequence of
a shard is padded with zeros, which the mask marks. A second file lists the shard's
documents (doc_id, start, n_tokens).

Null text: the end id alone. Null doc_id: kept, first in order. Repeated rows: each is
written. An empty table: a folder of no shards, read as no rows. Other columns are
ignored. A shard is written under another name and then renamed, so a task that is
run again replaces its own files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm.common import open_fs, scratch, slices, table
from quill.llm.tokens import TextEncoder, vocabulary_path

MANIFEST = "shard int, n_docs long, n_ids long, n_sequences long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _name(shard: int) -> str:
    return f"shard-{shard:06d}"


class _Sequences:
    """Cuts a run of ids into batches of fixed-size lists."""

    def __init__(self, sink, seq_len: int, rows: int):
        self.seq_len, self.rows, self.left, self.n = seq_len, rows, bytearray(), 0
        self.schema = pa.schema([("ids", pa.list_(pa.uint16(), seq_len)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), seq_len)))])
        self.out = pa.ipc.new_file(sink, self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))

    def _write(self, ids: np.ndarray, padded: int = 0) -> None:
        """A batch of sequences, of whose last the last `padded` ids are padding. The padded mask is added to the dictionary when it is known, with the last batch."""
        n, place = len(ids) // self.seq_len, np.arange(self.seq_len)
        masks = [place < self.seq_len] + ([place < self.seq_len - padded] if padded else [])
        kinds = np.zeros(n, np.int8)
        kinds[-1] = padded > 0
        values = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(masks).astype(np.uint8)), self.seq_len)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.seq_len), pa.DictionaryArray.from_arrays(pa.array(kinds), values)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n += n

    def add(self, ids: bytes) -> None:
        self.left += ids
        size = 2 * self.seq_len * self.rows
        while len(self.left) >= size:
            self._write(np.frombuffer(bytes(self.left[:size]), "<u2"))
            del self.left[:size]

    def close(self) -> None:
        n = len(self.left) // 2
        if n:
            pad = -n % self.seq_len
            self._write(np.concatenate([np.frombuffer(bytes(self.left), "<u2"), np.zeros(pad, "<u2")]), pad)
        self.out.close()


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, seq_len: int = 2048, batch_rows: int = 128) -> DataFrame:
    """Encodes every whole text of (doc_id, text), appends end_id and writes the shards under `path`; returns the manifest, a row a shard."""
    vocabulary = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        encoder, base = TextEncoder(vocabulary), f"{root}/{_name(shard)}"
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{base}.arrow.{attempt}") as a, fs.open_output_stream(f"{base}.docs.{attempt}") as b:
            sequences, index = _Sequences(a, seq_len, batch_rows), pa.ipc.new_file(b, _DOCS)
            for batch in slices(batches, 256):
                coded = encoder.encode_many(batch.column(1).to_pylist(), end_id)
                sizes = np.array([len(x) // 2 for x in coded], np.int64)
                sequences.add(b"".join(coded))
                starts = n_ids + np.cumsum(sizes) - sizes
                index.write_batch(pa.record_batch([batch.column(0), pa.array(starts), pa.array(sizes)], schema=_DOCS))
                n_docs, n_ids = n_docs + batch.num_rows, n_ids + int(sizes.sum())
            sequences.close()
            index.close()
        for kind in ("arrow", "docs"):
            fs.move(f"{base}.{kind}.{attempt}", f"{base}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids], "n_sequences": [sequences.n]})

    text_hash = F.xxhash64("text").alias("text_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash)
    ordered = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").select("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


class TokenFile:
    """One shard, open for reading; nothing is copied while a file is mapped."""

    def __init__(self, path: str, shard: int):
        fs, root = open_fs(path)
        base = f"{root}/{_name(shard)}"
        local = fs.type_name == "local"
        self.source = pa.memory_map(f"{base}.arrow") if local else fs.open_input_file(f"{base}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.docs = pa.ipc.open_file(fs.open_input_file(f"{base}.docs"))
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def _values(self, k: int) -> pa.Array:
        return self.file.get_batch(k).column(0).values

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k, as views: of the file, and of its dictionary of masks, which is read once."""
        row = k % self.rows
        ids = self._values(k // self.rows).slice(row * self.seq_len, self.seq_len)
        masks = self.file.get_batch(k // self.rows).column(1)
        mask = masks.dictionary.values.slice(masks.indices[row].as_py() * self.seq_len, self.seq_len)
        return ids.to_numpy(), mask.to_numpy()

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from `start` of the shard's run of ids."""
        size, out = self.seq_len * self.rows, []
        while n > 0:
            values = self._values(start // size)
            part = values.slice(start % size, min(n, len(values) - start % size)).to_numpy()
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u2")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start over all shards, n_tokens, ids_crc32 (of unsigned 32-bit integers), shard, shard_start. A task reads one shard."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    shards = [r[0] for r in manifest.filter("n_docs > 0").select("shard").collect()]  # one number a shard
    result = "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                file = TokenFile(path, shard)
                for k in range(file.docs.num_record_batches):
                    docs = file.docs.get_batch(k)
                    crc = [zlib.crc32(file.ids(s, n).astype("<u4")) for s, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist())]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array([shard] * docs.num_rows, pa.int32()), docs.column(1), docs.column(2), pa.array(crc, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    task = spark.createDataFrame([(s,) for s in shards], "shard int").repartitionByRange(max(1, len(shards)), "shard")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select(F.col("shard"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    rows = task.mapInArrow(read, result).join(F.broadcast(bases), "shard")  # a row a shard
    return rows.select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "shard_start")


def op1_token_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-arrow")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
