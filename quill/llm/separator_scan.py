"""Operator 9: token counts by a separator scan of flat token files.

A flat file is nothing but little-endian unsigned 16-bit ids, documents one after
another, each closed by the end-of-document id; it has no index. A file is cut into
blocks of a fixed number of ids wherever documents begin or end. Tasks search the
blocks' ids for the separator with vector comparisons; a prefix scan over the blocks
of a file then carries the number of documents before a block and the place of the
last separator before it, which stitches the document that crosses the boundary.

Null text: a document of the separator alone. Repeated rows and null doc_id: each row
is a document. Empty tables and empty files give no rows. Ids after a file's last
separator are a document that was never closed: scan_token_files returns it with
closed = false. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm.common import make_dir, open_fs, scratch, slices, table
from quill.llm.tokens import TextEncoder, vocabulary_path

#: The id of <|endoftext|> in word_bpe_49k; that string in a text is encoded as ordinary text, so the id ends documents only.
END_OF_DOCUMENT = 49407


def write_flat_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Writes a flat file for each partition of (doc_id, text); returns the order of the documents: file, ordinal, doc_id."""
    vocabulary = vocabulary or vocabulary_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = open_fs(f"{path}/flat")
        fs.create_dir(root, recursive=True)
        encoder, name, n = TextEncoder(vocabulary, special_as_text=True), f"part-{part:06d}.u16", 0
        with fs.open_output_stream(f"{root}/.{name}.{attempt}") as out:
            for batch in slices(batches, 256):
                out.write(b"".join(encoder.encode_many(batch.column(1).to_pylist(), end_id)))
                yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), pa.array(np.arange(n, n + batch.num_rows)), batch.column(0)], ["file", "ordinal", "doc_id"])
                n += batch.num_rows
        fs.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "file int, ordinal long, doc_id long"
    make_dir(docs.sparkSession, f"{path}/flat")
    rows.mapInArrow(write, schema).write.parquet(f"{path}/order")
    return docs.sparkSession.read.schema(schema).parquet(f"{path}/order")


def scan_token_files(spark: SparkSession, folder: str, end_id: int = END_OF_DOCUMENT, block_ids: int = 1 << 20) -> DataFrame:
    """Documents of the flat files part-*.u16 in a folder: file, ordinal, start, n_tokens (with the separator), closed. The files' lengths are the only thing known beforehand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.u16").load(folder).select("path", "length")
    name = F.regexp_extract("path", r"part-(\d+)\.u16$", 1).cast("int")
    first = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("length") / 2 - 1).cast("long"), F.lit(block_ids).cast("long")))
    blocks = files.filter("length >= 2").select(name.alias("file"), (F.col("length") / 2).cast("long").alias("ids"), first.alias("first"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for file, ids, at in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/part-{file:06d}.u16") as source:
                    block = np.frombuffer(source.read_at(2 * min(block_ids, ids - at), 2 * at), "<u2")
                ends = np.flatnonzero(block == end_id).astype(np.int64) + at
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([ids]), pa.array([at]), pa.array([ends], pa.list_(pa.int64()))], ["file", "ids", "first", "ends"])

    dealt = blocks.repartition("file", "first")
    found = dealt.mapInArrow(search, "file int, ids long, first long, ends array<long>")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "file", "ids", "first", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("end_before"),
    )
    # The last block of a file also closes what has no separator.
    last = F.greatest(F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)), F.col("end_before"))
    is_open = (F.col("first") + block_ids >= F.col("ids")) & (last < F.col("ids") - 1)
    ends = F.when(is_open, F.concat("ends", F.array(F.col("ids") - 1))).otherwise(F.col("ends"))
    stitched = carried.withColumn("n_closed", F.size("ends")).withColumn("ends", ends).select("file", "docs_before", "n_closed", F.concat(F.array("end_before"), "ends").alias("edges"))
    one = stitched.select("file", "docs_before", "n_closed", "edges", F.posexplode(F.slice("edges", F.lit(2), F.size("edges") - 1)).alias("i", "end"))
    start = F.element_at("edges", F.col("i") + 1) + 1
    return one.select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start + 1).alias("n_tokens"), (F.col("i") < F.col("n_closed")).alias("closed"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document from flat files written and scanned again: doc_id, n_tokens (with the separator), file, ordinal, start."""
    path = scratch(spark, "flat-tokens")
    order = write_flat_files(table(spark, sf_dir, "documents"), path)
    counts = scan_token_files(spark, f"{path}/flat")
    return order.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
