"""Encoding with public tokenizers, word by word.

The normalizer of word_bpe_49k drops white space and its pre-tokenizer never joins
characters across white space, so a text's ids are the ids of its white-space
separated chunks, one after another. Chunks repeat, so each task encodes a chunk
once with the tokenizers library and remembers its ids. Texts of Latin-1 letters
(where lower-casing and composition are plain) share chunks over letter case, and a
new chunk is put together from its pre-tokens, most of which are known too.
"""

from __future__ import annotations

import gc
import os
import re
import struct

import numpy as np

from quill.llm.common import WordCoder

#: Python's split() also cuts at these, which the tokenizers' \s does not match.
_PLAIN_SPLIT_FAILS = re.compile("[\x1c-\x1f]")
_NOT_PLAIN = re.compile("[\x1c-\x1f\u0100-\U0010ffff]")
#: May begin a special token.
_SPECIAL = "<|"
#: The pre-tokens of word_bpe_49k for lower-cased Latin-1 text without white space.
_LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as the characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_alphabet()

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Encodes texts to unsigned 16-bit ids, as word_bpe_49k does. special_as_text: strings of special tokens in a text are ordinary text. limit: chunks and pre-tokens that are remembered."""

    def __init__(self, path: str, special_as_text: bool = False, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.model = self.tokenizer.model
        self.raw = WordCoder(self._encode_raw, limit // 4)
        self.latin = WordCoder(self._encode_latin, limit)
        self.pieces = WordCoder(self._encode_pieces, limit)

    def _encode_raw(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_latin(self, words: list[str]) -> list[bytes]:
        split = [_LATIN_PIECES.findall(w) for w in words]
        coded = iter(self.pieces.code([p for pieces in split for p in pieces]))
        return [b"".join([next(coded) for _ in pieces]) for pieces in split]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pre-tokens go straight to the merges, in the byte alphabet."""
        tokenize = self.model.tokenize
        spelled = [p if p.isalpha() and p.isascii() else p.encode().decode("latin-1").translate(_BYTES) for p in pieces]
        coded = [[k.id for k in tokenize(p)] for p in spelled]
        return [struct.pack(f"<{len(ids)}H", *ids) for ids in coded]

    def encode_many(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each whole text (null: empty) and then `end`, as little-endian unsigned 16-bit integers."""
        collects = gc.isenabled()
        gc.disable()  # no cycles arise here, and collections would visit the large tables again and again
        try:
            return self._encode_many(texts, end)
        finally:
            if collects:
                gc.enable()

    def _encode_many(self, texts: list[str | None], end: int) -> list[bytes]:
        last = np.array([end], dtype="<u2").tobytes()
        out, plain = [last] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            if _SPECIAL not in text and not _NOT_PLAIN.search(text):
                plain.append((i, text.lower().split()))
            elif _PLAIN_SPLIT_FAILS.search(text):
                out[i] = self._encode_raw([text])[0] + last
            else:
                out[i] = b"".join(self.raw.code(text.split())) + last
        coded, at = self.latin.code([w for _, words in plain for w in words]), 0
        for i, words in plain:
            out[i] = b"".join(coded[at : (at := at + len(words))]) + last
        return out
