"""Operator 2: vector bin packing of examples under limits on tokens, segments and loss-bearing tokens.

Each partition packs its own documents, so nothing is shuffled and no state grows with
the table: pieces wait in a window of bounded size, whole sequences are cut off long
documents, and the remainders are placed by the dot-product heuristic of vector bin
packing: the bin being filled takes the piece whose demand vector (tokens, segments,
loss-bearing tokens, each as a share of its limit), scaled to one length, has the largest
dot product with what the bin has left, limits weighed by how much the waiting pieces ask
of them; of directions within a twentieth of one another the piece with most tokens goes
first, so that where tokens alone bind hardly more is cut than by largest-first. When no whole piece fits and tokens are left, a piece is cut to
fill the bin, so that only a partition's last sequences, and bins that reach another
limit first, are padded.

Null text: the end id alone. Repeated rows and null doc_id: each row is packed by
itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import slices, table
from quill.llm.tokens import TextEncoder, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class DotProductPacker:
    """Packs (tokens, loss mask) examples. place(example, start, length, bin, offset) is called for each piece; bins are numbered from 0. loss: per example an array of booleans, or None for all but the first token of each segment, which nothing predicts."""

    def __init__(self, place: Callable, max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, window: int = 512):
        self.place, self.limits, self.window = place, np.array([max_tokens, max_segments, max_loss], float), window
        self.max_tokens, self.bin, self.waiting = max_tokens, 0, []

    @staticmethod
    def _loss(sums: np.ndarray | None, start: int, length: int) -> int:
        return length - 1 if sums is None else int(sums[start + length] - sums[start])

    def _fits(self, sums: np.ndarray | None, start: int, most: int, loss: float) -> int:
        """The largest length up to `most` that bears at most `loss` loss tokens."""
        if self._loss(sums, start, most) <= loss:
            return most
        return int(loss) + 1 if sums is None else int(np.searchsorted(sums[start : start + most + 1], sums[start] + loss, "right")) - 1

    def add(self, example, length: int, loss: np.ndarray | None = None) -> None:
        sums = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        start = 0
        while length - start >= self.max_tokens:
            n = self._fits(sums, start, self.max_tokens, self.limits[2])
            if n < self.max_tokens:
                break
            self.place(example, start, n, self.bin, 0, self._loss(sums, start, n))
            self.bin, start = self.bin + 1, start + n
        if start < length:
            self.waiting.append((example, start, length - start, sums))
        if len(self.waiting) >= 2 * self.window:
            self._fill(self.window)

    def finish(self) -> None:
        self._fill(0)

    def _fill(self, keep: int) -> None:
        """Makes bins until at most `keep` pieces wait. Demands are columns of numbers that the bins share; a piece that is cut changes its own."""
        items = self.waiting
        share = lambda k: self._demand(*items[k][1:])
        demand = np.array([share(k) for k in range(len(items))], float).reshape(-1, 3).T.copy()
        open_, n = np.ones(len(items), bool), len(items)
        # A limit weighs as much as the waiting pieces ask of it, and a piece's size does not count, only its direction.
        weight = demand.mean(axis=1) if n else np.ones(3)
        norm = np.sqrt(weight @ demand**2)
        while n > keep:
            n -= self._one_bin(items, demand, open_, share, weight, norm)
        self.waiting = [x for x, o in zip(items, open_) if o]

    def _demand(self, start: int, length: int, sums: np.ndarray | None) -> np.ndarray:
        return np.array([length, 1, self._loss(sums, start, length)]) / self.limits

    def _one_bin(self, items: list, demand: np.ndarray, open_: np.ndarray, share: Callable, weight: np.ndarray, norm: np.ndarray) -> int:
        """Fills one bin; returns how many pieces it used up."""
        left, used, done = np.ones(3), 0, 0
        while open_.any():
            fit = open_.copy()
            for d, room in zip(demand, left + 1e-12):
                fit &= d <= room
            if fit.any():
                ask = weight * left
                # The cosine in steps of a twentieth; behind it the tokens, which are less than a step.
                cosine = ask @ demand / (norm * max(np.sqrt(weight @ left**2), 1e-12))
                k = int(np.argmax(np.where(fit, np.floor(20 * cosine) + 0.999 * demand[0], -1.0)))
                n = items[k][2]
            elif left[1] * self.limits[1] >= 0.5 and (room := self.max_tokens - used) > 0:
                k = int(np.argmax(np.where(open_, demand[0], -1.0)))
                example, at, n, sums = items[k]
                n = self._fits(sums, at, min(room, n), round(left[2] * self.limits[2]))
                if n < 1:
                    break
            else:
                break
            example, at, whole, sums = items[k]
            loss = self._loss(sums, at, n)
            self.place(example, at, n, self.bin, used, loss)
            used += n
            left -= np.array([n, 1, loss]) / self.limits
            if n == whole:
                open_[k] = False
                done += 1
            else:
                items[k] = (example, at + n, whole - n, sums)
                demand[:, k] = share(k)
                norm[k] = np.sqrt(weight @ demand[:, k] ** 2)
                break
        self.bin += 1
        return done


def _packed(rows: DataFrame, examples: Callable, end_id: int, vocabulary: str | None, limits: tuple[int, int, int], window: int) -> DataFrame:
    """Packs what examples(encoder, batch) gives of each Arrow batch: (doc_id, ids, loss mask or None). A sequence_id holds the partition's number in its high bits, so ids need no agreement between tasks."""
    vocabulary = vocabulary or vocabulary_path()
    if min(limits) < 1:
        raise ValueError("the limits must be positive")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, base = TextEncoder(vocabulary), [], TaskContext.get().partitionId() << 33

        def place(example, start, length, bin_, offset, loss):
            doc_id, ids = example
            crc = zlib.crc32(np.frombuffer(ids, "<u2")[start : start + length].astype("<u4"))
            rows.append((doc_id, start, length, crc, len(ids) // 2, base + bin_, offset, loss))

        def taken():
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

        packer = DotProductPacker(place, *limits, window)
        for batch in slices(batches, 256):
            for doc_id, ids, loss in examples(encoder, batch):
                packer.add((doc_id, ids), len(ids) // 2, loss)
            if rows:
                yield taken()
        packer.finish()
        if rows:
            yield taken()

    return rows.mapInArrow(pack, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256, max_loss: int = 2048, window: int = 512) -> DataFrame:
    """Packs every whole text of (doc_id, text) with end_id appended; a row a piece. Every token but a segment's first bears loss, so of the limits it is that on tokens that binds."""

    def examples(encoder: TextEncoder, batch: pa.RecordBatch):
        return ((d, ids, None) for d, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist(), end_id)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _packed(rows, examples, end_id, vocabulary, (max_tokens, max_segments, max_loss), window)


def pack_conversations(turns: DataFrame, learned: tuple[str, ...] = ("assistant",), vocabulary: str | None = None, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 1024, window: int = 512, most_turns: int = 256) -> DataFrame:
    """Packs instruction data, (conv_id, turn, role, text): a conversation's turns in order, each closed by end_id, are one example, of which the tokens of learned roles bear loss. A row a piece, doc_id being the conv_id. Turns are gathered by most_turns turn numbers, so a longer conversation is several examples. Null text is an empty turn; a null turn comes first."""

    def examples(encoder: TextEncoder, batch: pa.RecordBatch):
        for conv_id, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            coded = encoder.encode_many([t["text"] for t in said], end_id)
            loss = np.repeat([t["role"] in learned for t in said], [len(c) // 2 for c in coded])
            yield conv_id, b"".join(coded), loss

    said = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))))
    rows = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / most_turns).alias("part")).agg(said.alias("said")).select("conv_id", "said")
    return _packed(rows, examples, end_id, vocabulary, (max_tokens, max_segments, max_loss), window)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
