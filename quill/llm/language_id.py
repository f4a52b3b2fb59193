"""Operator 3: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary
(piece_bpe_32k). The probability of a word is the sum over all its segmentations into
pieces of the product of their probabilities, which the forward algorithm computes in
one pass over the word; a text's is the product over its words (runs of letters, in
lower case, after a word mark). Pieces never cross words, so each task sums a word once
for all languages and remembers the result. The prediction is the language with the
largest posterior, prior included; its posterior is the score.

Training is expectation maximisation: expected piece counts over all segmentations
(forward-backward) of the words of training texts, from equal piece probabilities. The
classifier is fitted on a bounded sample of labelled rows, about `sample_docs` for each
language, chosen by a hash of doc_id; word counts and expected counts are summed by
Spark, and the driver holds vocabulary x languages numbers.

Null text, or a text without a letter: `und`, score 0. Null lang: not trained on. Null
doc_id: predicted, never trained on, held_out false. Repeated rows are predicted alike.
Without training rows every prediction is `und`. Ties: the first language by name.
Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm.common import WordCoder, materialize, slices, table

PIECES = "piece_bpe_32k.model"
_MARK = "▁"
_LETTERS = regex.compile(r"\p{L}+")
_LATIN_LETTERS = regex.compile(r"[a-zªµºß-öø-ÿ]+")
_BEYOND_LATIN = regex.compile(r"[^\x00-\xff]")


def vocabulary_pieces(path: str | None = None) -> list[str]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(k(i) for k in kinds)]


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    if not text:
        return []
    if _BEYOND_LATIN.search(text):
        return _LETTERS.findall(unicodedata.normalize("NFC", text).lower())
    return _LATIN_LETTERS.findall(text.lower())


class Lattice:
    """The pieces as numbers; row 0 of a table of probabilities is for single characters that are no piece."""

    def __init__(self, pieces: list[str]):
        lower = dict.fromkeys(p for p in pieces if p == p.lower())
        self.index = {p: i + 1 for i, p in enumerate(lower)}
        self.size, self.longest = len(self.index) + 1, max(map(len, self.index), default=1)

    def log_probability(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """The log of each word's sum over all segmentations, for each column of `table` (pieces x languages). Words of one length go together; sums are scaled as they grow small."""
        out = np.empty((len(words), table.shape[1]))
        groups: dict[int, list[int]] = {}
        for w, word in enumerate(words):
            groups.setdefault(len(word), []).append(w)
        get, most = self.index.get, self.longest
        none = len(table)  # a row of zeros: no piece
        padded = np.vstack([table, np.zeros((1, table.shape[1]))])
        for n, members in groups.items():
            marked = [_MARK + words[w] for w in members]
            alpha = [np.ones((len(members), table.shape[1]))]
            scale = np.zeros((len(members), table.shape[1]))
            for j in range(1, n + 2):
                total = np.zeros_like(scale)
                for i in range(max(0, j - most), j):
                    default = 0 if j - i == 1 else none
                    k = [get(word[i:j], default) for word in marked]
                    total += alpha[i] * padded[k]
                alpha.append(total)
                if j % 8 == 0:
                    top = total.copy()
                    for i in range(max(0, j - most), j):
                        np.maximum(top, alpha[i], out=top)
                    for i in range(max(0, j - most), j + 1):
                        alpha[i] = alpha[i] / top
                    scale += np.log(top)
                if j > most:
                    alpha[j - most - 1] = None
            out[members] = np.log(alpha[-1]) + scale
        return out

    def expected_counts(self, words: list[str], weights: list[int], probability: np.ndarray, held: int = 2_000_000) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, each counted `weight` times. Sums are in logs, so a word may have any length; words of one length go together, about `held` arcs at a time."""
        out = np.zeros(self.size + 1)
        log_p = np.append(np.log(probability), -np.inf)  # the last: no piece
        groups: dict[int, list[int]] = {}
        for w, word in enumerate(words):
            groups.setdefault(len(word) + 1, []).append(w)
        get, most = self.index.get, self.longest
        for n, members in groups.items():
            step = max(1, held // (n * min(n, most)))
            for part in (members[at : at + step] for at in range(0, len(members), step)):
                marked = [_MARK + words[w] for w in part]
                weight = np.array([weights[w] for w in part], float)
                arcs, forward = [None], np.zeros((n + 1, len(part)))
                for j in range(1, n + 1):
                    low = max(0, j - most)
                    arcs.append(np.array([[get(word[i:j], 0 if j - i == 1 else self.size) for word in marked] for i in range(low, j)]))
                    forward[j] = np.logaddexp.reduce(forward[low:j] + log_p[arcs[j]], axis=0)
                backward, uses = np.full((n + 1, len(part)), -np.inf), []
                backward[n] = 0
                for j in range(n, 0, -1):
                    low = max(0, j - most)
                    onward = log_p[arcs[j]] + backward[j]
                    uses.append(np.exp(forward[low:j] + onward - forward[n]) * weight)
                    backward[low:j] = np.logaddexp(backward[low:j], onward)
                pieces = np.concatenate([k.ravel() for k in reversed(arcs[1:])])
                out += np.bincount(pieces, np.concatenate([u.ravel() for u in uses]), self.size + 1)
        return out[: self.size]


@lru_cache(maxsize=2)
def lattice_of(vocabulary: str | None) -> Lattice:
    """Loaded once in a Python worker, whose tasks share it."""
    return Lattice(vocabulary_pieces(vocabulary))


def _bucket(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def training_words(docs: DataFrame, sample_docs: int) -> DataFrame:
    """lang, word, n over the sample of training texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = _bucket(rows).filter("not held_out and doc_id is not null and lang is not null")
    share = rows.groupBy("lang").agg((F.lit(sample_docs) / F.count("*")).alias("share"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    chosen = rows.filter("text is not null").join(F.broadcast(share), "lang").filter(drawn).select("lang", "text")  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(words), "word": list(words), "n": pa.array(list(words.values()), pa.int64())})

    return chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample_docs: int = 400, rounds: int = 3, vocabulary: str | None = None, floor: float = 1e-7) -> tuple[list[str], np.ndarray]:
    """The languages by name, and log prior (first row) over piece probabilities (rows) of each."""
    spark, lattice = docs.sparkSession, lattice_of(vocabulary)
    words = materialize(training_words(docs, sample_docs), "language-words")
    langs = [r[0] for r in words.select("lang").distinct().sort("lang").collect()]
    model = np.full((lattice.size, len(langs)), 1.0 / lattice.size)
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = lattice_of(vocabulary)
            total = np.zeros((lattice.size, len(langs)))
            for batch in batches:
                lang, word, n = (np.array(c.to_pylist(), object) for c in batch.columns)
                for k, name in enumerate(langs):
                    mine = lang == name
                    if mine.any():
                        total[:, k] += lattice.expected_counts(list(word[mine]), list(n[mine]), shared.value[:, k])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": piece.astype(np.int32), "k": k.astype(np.int32), "n": total[piece, k]})

        dealt = words.repartition(spark.sparkContext.defaultParallelism, "word")  # few bytes, but much work
        sums = dealt.mapInArrow(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n"))
        counts = np.zeros_like(model)
        for piece, k, n in sums.collect():  # vocabulary x languages at most
            counts[piece, k] = n
        model = counts / counts.sum(axis=0) + floor
        model /= model.sum(axis=0)
    rows = _bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))).filter("not held_out and doc_id is not null")
    number = dict(map(tuple, rows.groupBy("lang").count().filter("lang is not null").collect()))
    prior = np.log(np.array([number[x] for x in langs], float) / max(1, sum(number[x] for x in langs)))
    return langs, np.vstack([prior, model])


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, vocabulary: str | None = None, remembered: int = 200_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(vocabulary)
        prior, table = shared.value[0], shared.value[1:]
        coder = WordCoder(lambda words: [r.tobytes() for r in lattice.log_probability(words, table).astype("<f4")], remembered)
        for batch in slices(batches, 256):
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            coded, at, best, score = coder.code([w for words in split for w in words]) if langs else [], 0, [], []
            for words in split:
                if not words or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                mine = coded[at : (at := at + len(words))]
                total = prior + np.frombuffer(b"".join(mine), "<f4").reshape(len(words), -1).sum(axis=0, dtype=float)
                k = int(np.argmax(total))
                best.append(langs[k])
                score.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _bucket(rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")).select("doc_id", "held_out", "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, *fit(docs))
