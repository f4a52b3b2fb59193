"""Texts that are marked up alike: what follows from markup alone is worked out once for each skeleton and placed in all texts that have it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.operators.lineage import cut

#: Up to how many bytes what is known of skeletons is broadcast to their texts; more is shuffled.
BROADCAST = 16 << 20
#: How many skeletons a part holds while there are fewer parts than texts are dealt to.
PER_PART = 500


def skeleton(text: Column) -> Column:
    """A text with what is said on a line between two tags as one letter. Tags, comments, line ends, and which gaps are empty or blank stay, so checkers find the same in both at other offsets. Only characters after a `>` or the text's start and before the next bracket go, which are in no tag; those before a `>` may end a comment and stay."""
    return F.regexp_replace(text, r"(?U)(>\s*+|\G\s*+)[^<>\s][^<>\n]*+(?=[\n<]|\z)", "$1x")


def bounds_of(texts: pa.Array) -> pa.Array:
    """For each text its start, the places before each `<` and after each `>`, and its end, in code points."""
    texts = texts.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    at = np.flatnonzero((data == ord("<")) | (data == ord(">")))
    place, first = at + (data[at] == ord(">")), np.searchsorted(at, starts)
    if len(data) and data.max() > 127:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        place, starts = points[place], points[starts]
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    offsets = first + 2 * np.arange(len(texts) + 1)
    out = np.zeros(offsets[-1], np.int32)
    out[offsets[1:] - 1] = np.diff(starts)
    out[np.arange(len(at)) + 2 * text + 1] = place - starts[text]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))


#: What stands for a word of a form, and what ends its number: characters for private use. Texts that have either keep their words.
_WORD, _END = "\ue000", "\ue001"
_WORDS = r"(?U)(>\s*+|\G\s*+)([^<>&\s]++)"


def form(text: Column) -> Column:
    """A text with each word between its tags as one mark, for what treats words as a whole and whatever they are. Words that a reference is part of stay, as do all white space and brackets; of a text without a `<` nothing is kept."""
    held = F.concat(F.lit(_END), text)
    return F.when(~text.contains("<"), "").when(text.contains(_WORD) | text.contains(_END), held).otherwise(F.regexp_replace(text, _WORDS, f"$1{_WORD}"))


def numbered(form: Column) -> Column:
    """A form as a text, with its marks numbered."""
    pieces = F.transform(F.split(form, _WORD, -1), lambda p, i: F.when(i > 0, F.concat(F.lit(_WORD), (i - 1).cast("string"), F.lit(_END), p)).otherwise(p))
    return F.when(form.startswith(_END), F.substr(form, F.lit(2))).otherwise(F.array_join(pieces, ""))


def words_put_in(form: Column, made: Column, text: Column) -> tuple[Column, Column]:
    """For a form and what was made of its numbered() text: `made` cut at its marks, and, of that as `cut_up`, what it is for a text of the form."""
    at = lambda p: F.struct(F.substring_index(p, _END, 1).cast("int").alias("k"), F.substr(p, F.instr(p, F.lit(_END)) + 1).alias("rest"))
    whole = lambda p: F.struct(F.lit(None).cast("int").alias("k"), p.alias("rest"))
    cut_up = F.when(form.startswith(_END), F.array(whole(made))).otherwise(F.transform(F.split(made, _WORD, -1), lambda p, i: F.when(i > 0, at(p)).otherwise(whole(p))))
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(2))
    return cut_up, F.array_join(F.zip_with(F.transform("cut_up", lambda c: c["k"]), F.transform("cut_up", lambda c: c["rest"]), lambda k, rest: F.concat(F.coalesce(F.get(words, k), F.lit("")), rest)), "")


@dataclass(frozen=True)
class Shared:
    """texts: (id, text, skeleton); skeletons: each different one once, as (id, text) with an id of its own; parts: to how many parts skeletons are dealt."""

    texts: DataFrame
    skeletons: DataFrame
    parts: int


def share(docs: DataFrame, id_column: str, parts: int) -> Shared:
    """Texts (id, text) that are dealt by their id to `parts`, with their skeletons. Both are written once, bucketed by id. Where no two texts are marked up alike there are as many skeletons as texts, and they are dealt as texts are."""
    texts = cut(docs.select(id_column, "text", skeleton(F.col("text")).alias("skeleton")), id_column, parts)
    kinds = cut(texts.select(F.col("skeleton").alias("text")).filter("text is not null").distinct().select(F.monotonically_increasing_id().alias(id_column), "text"))
    kept = parts_of(kinds, texts, parts)
    return Shared(texts, cut(kinds.repartition(kept, id_column), id_column, kept), kept)


def parts_of(kinds: DataFrame, texts: DataFrame, parts: int) -> int:
    """To how many parts kinds of texts are dealt, where texts are dealt to `parts`."""
    n, of = kinds.count(), max(texts.count(), 1)
    return max(-(-n * parts // of), min(parts, -(-n // PER_PART)), 1)


def meet(texts: DataFrame, known: DataFrame, key: str, size: Column) -> DataFrame:
    """Texts with what is known of their kind, a row each in a written table; size: how many bytes a row takes about."""
    total = known.agg(F.sum(size)).first()[0] or 0
    return texts.join(F.broadcast(known) if total <= BROADCAST else known.hint("merge"), key)


def in_texts(shared: Shared, rows: DataFrame, places: list[str], id_column: str) -> DataFrame:
    """Rows of skeletons (by their id) as rows of each text that has the skeleton: id, text and the rows' columns, of which `places` are offsets at the ends of tags, gaps or texts. Such a place is told by its number among the brackets, which are as many in a text as in its skeleton."""
    bounds = F.arrow_udf(bounds_of, "array<int>")
    told = [c for c in rows.columns if c != id_column]
    ends = shared.skeletons.select(id_column, bounds("text").alias("_at"))
    number = lambda c: F.array_position("_at", F.col(c).cast("int")).cast("int").alias(c)
    met = rows.join(ends, id_column).select(id_column, F.struct(*[number(c) if c in places else F.col(c) for c in told]).alias("f"))
    known = cut(met.groupBy(id_column).agg(F.collect_list("f").alias("f")).join(shared.skeletons, id_column).select(F.col("text").alias("skeleton"), "f"))
    texts = meet(shared.texts, known, "skeleton", F.octet_length("skeleton") + F.size("f") * (64 + 16 * len(told)))
    texts = texts.select(id_column, "text", "f", bounds("text").alias("_at"))
    texts = texts.select(id_column, "text", "_at", F.explode("f").alias("f"))
    return texts.select(id_column, "text", *[F.element_at("_at", F.col(f"f.{c}")).cast("long").alias(c) if c in places else F.col(f"f.{c}") for c in told])
