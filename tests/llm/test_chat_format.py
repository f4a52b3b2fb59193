"""Operator 13: the fold against a fold in Python, and exact round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quill.llm import chat_format as C

LOG = "conv_id long, seq long, kind string, message long, role string, text string"


def folded(log):
    out = {}
    key = lambda e: (e[1] is not None, e[1] or 0, e[3] is not None, e[3] or 0, e[2], e[5] or "")
    for conv_id, seq, kind, message, role, text in sorted(log, key=key):
        said = out.setdefault(conv_id, [])
        at = next((i for i, m in enumerate(said) if m["id"] == message), None)
        if kind == "start" and at is None:
            said.append({"id": message, "role": role or "", "text": text or "", "live": True})
        elif at is not None and kind == "delta":
            said[at]["text"] += text or ""
        elif at is not None and kind == "edit":
            said[at]["text"] = text or ""
        elif at is not None and kind == "regenerate":
            said[at]["text"] = ""
            for m in said[at + 1 :]:
                m["live"] = False
    return {c: [(m["role"], m["text"]) for m in v if m["live"]] for c, v in out.items() if v}


def test_fold_of_random_logs(spark):
    r = random.Random(13)
    log = []
    for conv_id in range(60):
        n = 0
        for seq in range(r.randint(1, 25)):
            kind = r.choice(["start", "delta", "delta", "edit", "regenerate"])
            message = n if kind == "start" else r.randint(0, max(0, n - 1))
            n += kind == "start"
            log.append((conv_id, seq, kind, message, r.choice(["user", "assistant"]), r.choice(["a", "bc", "", None])))
    r.shuffle(log)
    got = {}
    for m in sorted(C.fold_events(spark.createDataFrame(log, LOG)).collect(), key=lambda m: m.place):
        got.setdefault(m.conv_id, []).append((m.role, m.text))
    assert got == folded(log)


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "a\\b<\\[\\\\", "<<[[\\", "é\U0001f600<s>", "\n\t ", "x" * 5000, "<s>user[INST]hi</s>"]
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("template", [C.Template(), C.Template("<|im_start|>", "[:]", "<|im_end|>")])
def test_round_trip(spark, tmp_path, template):
    r = random.Random(4)
    turns = [(c, t, r.choice(["user", "assistant", "system", "[INST]", None]), r.choice([*TEXTS, None])) for c in range(40) for t in range(r.randint(1, 6))]
    turns += [(None, None, "assistant", "null id"), (None, 1, "user", "b"), (50, None, "assistant", "later"), (50, None, "assistant", "first"), (50, 0, "user", "x"), (50, 0, "user", "x")]
    frame = spark.createDataFrame(turns, TURNS).withColumns({"place": F.lit("x"), "kind": F.lit(1)})
    C.format_chats(C.fold_events(C.event_log(frame, piece=3, draft=2)), template).write.parquet(str(tmp_path / "f"))
    stored = spark.read.schema("conv_id long, formatted binary, loss_spans array<struct<start: long, end: long>>").parquet(str(tmp_path / "f"))
    got = {x.conv_id: x for x in C.read_back(stored, template).collect()}
    want = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in x.turns] for c, x in got.items()} == want
    assert {c: x.loss_text for c, x in got.items()} == {c: "".join(t for role, t in v if role == "assistant") for c, v in want.items()}
    for c, x in got.items():
        assert all(x.formatted.count(mark) == len(want[c]) for mark in (template.turn, template.text, template.end))
    spans = {x.conv_id: (bytes(x.formatted), x.loss_spans) for x in stored.collect()}
    for whole, of in spans.values():
        inside = [whole[s.start : s.end].decode() for s in of]
        assert not any(mark in t for t in inside for mark in (template.turn, template.text, template.end))


def test_the_log_has_drafts_edits_and_regenerations(spark):
    turns = [(c, t, "user", f"text {c} {t} " * 60) for c in range(30) for t in range(4)]
    log = C.event_log(spark.createDataFrame(turns, TURNS))
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert min(kinds["edit"], kinds["regenerate"]) > 10 and kinds["delta"] > len(turns) and kinds["start"] > len(turns)


def test_templates_must_be_told_from_escaped_text():
    for marks in (("s>", "[INST]", "</s>"), ("<\\", "[INST]", "</s>"), ("<s", "[INST]", "<s>"), ("<", "[I", "</s>")):
        with pytest.raises(ValueError):
            C.Template(*marks)


def test_query(spark, tmp_path):
    turns = [(3, 1, "assistant", "b<c"), (3, 0, "user", "a"), (9, 0, "user", None)]
    spark.createDataFrame(turns, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op13_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    control = "</s>[INST] ok [/INST]"
    assert (got[3].n_turns, got[3].turns_sha256, got[3].loss_chars, got[3].loss_sha256) == (2, sha("user\na\nassistant\nb<c\n"), 3, sha("b<c"))
    assert (got[-7].turns_sha256, got[-7].loss_sha256) == (sha(f"user\n{control}\nassistant\n{control}\n"), sha(control))
    assert (got[9].turns_sha256, got[9].loss_chars, got[9].loss_sha256) == (sha("user\n\n"), 0, sha(""))
    assert got[3].formatted_chars == len("<s>user[INST]a</s><s>assistant[INST]b<\\c</s>")


def test_empty(spark):
    assert C.format_chats(C.fold_events(C.event_log(spark.createDataFrame([], TURNS)))).count() == 0
