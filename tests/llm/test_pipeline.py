"""Every stage of the pipeline against brute force, each on its own input."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quill.llm.importance import op4_importance
from quill.llm.secret_scan import find_secrets
from quill.llm.tokens import vocabulary_path
from tests.llm.test_operators import LOWER, SF, WORDS, components_by_force


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def stages(spark):
    """The table before the first stage and after each but the last, and the last's rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        out[name] = docs.toPandas() if name == "packing" else docs.toPandas().set_index("doc_id")
    return out


def test_quality_classifier(spark, stages):
    """Who is drawn follows from weights that test_op4_weights_by_force checks."""
    drawn = op4_importance(spark, SF).filter("kept").toPandas()["doc_id"]
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    kept = stages["quality_classifier"].index
    assert set(kept) == set(drawn) and set(kept) < set(stages["documents"].index)
    clean = labels.index[(labels["quality"] == 1) & (labels["toxic"] == 0)]
    assert np.isin(clean, kept).mean() > 0.9


def test_near_dedup(stages):
    before = stages["quality_classifier"]["text"]
    groups = components_by_force(dict(before), percent=80)
    assert set(stages["near_dedup"].index) == {d for d in before.index if groups[d][1] == d} < set(before.index)


def test_benchmark_decontamination(stages):
    before = stages["near_dedup"]["text"]
    items = [shingles(t) for t in pd.read_parquet(f"{SF}/benchmark.parquet")["text"]]
    leaks = {d for d, t in before.items() if any(100 * len(i & shingles(t)) >= 80 * len(i) for i in items)}
    assert leaks and set(stages["benchmark_decontamination"].index) == set(before.index) - leaks


def test_secret_scan(spark, stages):
    """Every found span becomes one mask, overlapping ones together, and nothing else changes."""
    assert set(stages["benchmark_decontamination"].index) == set(stages["secret_scan"].index)
    planted = "client_id=web-7 with aB3xY7zQaB3xY7zQaB3x, password = hunter22 and token=AKIA" + "Z9" * 9 + " end"
    before = pd.concat([stages["benchmark_decontamination"], pd.DataFrame({"text": [planted], "n_chars": [len(planted)]}, index=pd.Index([-1], name="doc_id"))])
    rows = spark.createDataFrame(before[["text", "n_chars"]].reset_index())
    after = corpus_pipeline.secret_scan(spark, rows, SF).toPandas().set_index("doc_id")
    assert (after["text"].drop(-1) == stages["secret_scan"]["text"]).all()
    spans = {r.doc_id: sorted((s["start"], s["end"]) for s in [*r.base, *r.linked]) for r in find_secrets(spark.createDataFrame(before["text"].reset_index())).collect()}
    masked = 0
    for d, text in before["text"].items():
        keep = np.ones(len(text), bool)
        starts = np.zeros(len(text) + 1, bool)
        end = -1
        for a, b in spans[d]:
            starts[a] |= a >= end
            keep[a:b] = False
            end = max(end, b)
        expected = "".join(("[secret]" if starts[i] else "") + (c if keep[i] else "") for i, c in enumerate(text))
        assert after["text"][d] == expected and after["n_chars"][d] == len(expected)
        masked += text != expected
        assert not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", expected)
    assert masked and after["text"][-1] == "[secret] with [secret], [secret] and [secret] end"


def test_packing(stages):
    texts, pieces = stages["secret_scan"]["text"], stages["packing"]
    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {d: len(v) for d, v in ids.items()}
    for r in pieces.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    total = pieces.groupby("sequence_id")["length"].sum()
    assert total.max() <= 2048 and (total < 2048).sum() <= 4  # one for each partition


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, stages["packing"][columns].values.tolist()))
