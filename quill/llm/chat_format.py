"""Operator 13: chat formatting of event-sourced conversations, native.

A log of events is dealt by conversation and put in order of its sequence numbers. The
fold takes the last state of each message from windows and sorted arrays:

- `start` opens a message, with its role and perhaps a first text; it stands where it started;
- `delta` appends streamed text;
- `edit` replaces the text so far, later deltas append to it;
- `regenerate` drops the text so far, and the messages that started behind this one before
  it was regenerated, as they answered what is gone.

Final messages are rendered by a template. Control strings begin with `<` or `[`; in roles
and texts each of `<`, `[` and the backslash is followed by a backslash, so that none can
occur there, and taking these backslashes away gives the text again. The loss mask is a
list of spans, in UTF-8 bytes of the formatted conversation, of the learned roles' texts.

Null text or role: empty. A null conv_id is a conversation of its own. Null turns and
sequence numbers come first; rows of one turn follow by role and text, events of one number
by message, kind and text; repeated rows each count. Events of a message that never starts
are ignored, and so is a second `start`; a message that went stays away, but a
`regenerate` sent to it still takes what started behind it. An empty table gives no rows; other columns are
ignored. A conversation is one row of the output, so it must fit one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm.common import scratch, table


@dataclass(frozen=True)
class Template:
    """Control strings around a turn's role and text. They begin with `<` or `[` and go on with anything but a backslash."""

    turn: str = "<s>"
    text: str = "[INST]"
    end: str = "</s>"

    def __post_init__(self) -> None:
        marks = (self.turn, self.text, self.end)
        if any(len(m) < 2 or m[0] not in "<[" or m[1] == "\\" for m in marks) or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("control strings begin with < or [, go on without a backslash, and none holds another")


def escaped(text: Column) -> Column:
    """A backslash behind each character that may begin a control string or an escape."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def event_log(turns: DataFrame, piece: int = 400, draft: int = 40) -> DataFrame:
    """The log (conv_id, seq, kind, message, role, text) of a chat service that streamed these turns (conv_id, turn, role, text), `piece` code points at a time. By a hash of conversation and place, a quarter of the messages are edited after a draft and a quarter regenerated, after a reply to the draft that goes with it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    said = said.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long"))

    def event(kind: str, text: Column, message: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("place") if message is None else message).alias("message"), text.alias("text"))

    start, begun = event("start", F.lit("")), event("delta", F.substring("text", 1, draft))
    streamed = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda t: event("delta", t))
    reply = [event("start", F.lit(""), -F.col("place")), event("delta", F.substring("text", 1, draft), -F.col("place"))]
    way = F.pmod(F.xxhash64("conv_id", "place"), F.lit(4))
    events = F.when(way == 1, F.array(start, begun, event("edit", F.col("text")))).when(way == 2, F.concat(F.array(start, begun, *reply, event("regenerate", F.lit(""))), streamed)).otherwise(F.concat(F.array(start), streamed))
    log = said.select("conv_id", "place", "role", F.posexplode(events).alias("i", "e"))
    return log.select("conv_id", (F.col("place") * (1 << 32) + F.col("i")).alias("seq"), "e.kind", "e.message", "role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the final messages of a log (conv_id, seq, kind, message, role, text); a log that is dealt by conv_id already is not shuffled again."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", F.col("kind").cast("string").alias("kind"), "message", text("role").alias("role"), text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("seq"), "message", "kind", "text")
    log = log.withColumn("n", F.row_number().over(order))
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("n"))
    message = log.groupBy("conv_id", "message").agg(
        F.min(at("start")).alias("place"),
        F.min_by("role", at("start")).alias("role"),
        F.max(at("edit", "regenerate")).alias("reset"),
        F.max(at("regenerate")).alias("again"),
        F.array_sort(F.collect_list(F.struct("n", "kind", "text"))).alias("log"),
    )
    message = message.filter("place is not null").withColumn("since", F.greatest("place", F.coalesce("reset", "place")))
    alive = F.filter("log", lambda e: (e["n"] >= F.col("since")) & (e["kind"].isin("delta", "edit") | (e["n"] == F.col("place"))))
    message = message.select("conv_id", "place", "role", F.array_join(F.transform(alive, lambda e: e["text"]), "").alias("text"), F.when(F.col("again") > F.col("place"), F.col("again")).alias("again"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("again").over(before) > F.col("place"), F.lit(False))
    return message.withColumn("gone", gone).filter("not gone").select("conv_id", "place", "role", "text")


def format_chats(messages: DataFrame, template: Template = Template(), learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (array of start and end in bytes) of messages (conv_id, place, role, text)."""
    head = F.concat(F.lit(template.turn), escaped(F.col("role")), F.lit(template.text))
    pieces = messages.select("conv_id", "place", F.col("role").isin(*learned).alias("learned"), head.alias("head"), escaped(F.col("text")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(template.end)))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(before), F.lit(0).cast("long")) + F.octet_length("head")
    span = F.when(F.col("learned"), F.struct(start.alias("start"), (start + F.octet_length("body")).alias("end")))
    turns = F.array_sort(F.collect_list(F.struct("place", "piece", "span")))
    whole = pieces.select("conv_id", "place", "piece", span.alias("span")).groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (array of role and text), loss_text, formatted of a table whose `formatted` is read as bytes: spans are cut from bytes, so a cut costs no more than what it takes."""
    quoted = lambda mark: "".join("\\" + c if not c.isalnum() else c for c in mark)
    text = F.col("formatted").cast("string")
    pieces = F.split(text, quoted(template.end), -1)
    parts = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.split(p, quoted(template.text), 2))
    turns = F.transform(parts, lambda p: F.struct(unescaped(F.substring(p[0], F.lit(len(template.turn) + 1), F.length(p[0]))).alias("role"), unescaped(p[1]).alias("text")))
    # Spark counts places in bytes from 1.
    cut = F.transform("loss_spans", lambda s: F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string"))
    return formatted.select("conv_id", turns.alias("turns"), unescaped(F.array_join(cut, "")).alias("loss_text"), text.alias("formatted"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    path = scratch(spark, "formatted")
    format_chats(fold_events(event_log(turns.unionByName(planted)))).write.parquet(path)
    # The files' strings are read as their bytes.
    stored = spark.read.schema("conv_id long, formatted binary, loss_spans array<struct<start: long, end: long>>").parquet(path)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(stored).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP13_SQL = r"""
WITH turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL
    SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) + length('<s>[INST]</s>')) AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""
