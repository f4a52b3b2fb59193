"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quill.llm import containment, quality_rules
from quill.llm.common import open_fs, scratch
from quill.llm.importance import best_cut, gumbel_noise, importance_resample, kth_largest, labelled_sample, op4_importance
from quill.llm.language_id import Lattice, identify, lattice_of, op3_language_id
from quill.llm.minhash_dedup import near_duplicates, op6_minhash_dedup
from quill.llm.packing import DotProductPacker, op2_packing, pack_conversations
from quill.llm.quality_rules import op8_quality_rules
from quill.llm.registry import ORACLE_SQL, QUERIES
from quill.llm.secret_scan import base_spans, linked_spans, op5_secret_scan, redact_secrets, weak_parts
from quill.llm.separator_scan import op9_separator_scan, scan_token_files, write_flat_files
from quill.llm.token_arrow import TokenFile, op1_token_arrow, write_token_files
from quill.llm.tokens import TextEncoder, vocabulary_path
from quill.llm.warc_bundle import BundleReader, op7_warc_bundle, parse_records, write_warc_bundles

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in zip(docs["doc_id"], docs["text"])}


def crc(values):
    return zlib.crc32(np.array(values, "<u4"))


@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list("'sS tT\"!İΣß²é́ \x1c\x85<|>")), max_size=30))
@settings(max_examples=300, deadline=None)
def test_encoder_agrees_with_whole_texts(text):
    from tokenizers import Tokenizer

    encoder = test_encoder_agrees_with_whole_texts.__dict__.setdefault("encoder", TextEncoder(vocabulary_path()))
    whole = test_encoder_agrees_with_whole_texts.__dict__.setdefault("whole", Tokenizer.from_file(vocabulary_path()))
    assert np.frombuffer(encoder.encode_many([text], 1)[0], "<u2").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_op1(spark, docs, ids):
    got = op1_token_arrow(spark, SF).toPandas().set_index("doc_id")
    start = 0
    for d in sorted(ids):
        assert (got.start[d], got.n_tokens[d], got.ids_crc32[d]) == (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])


def test_op1_sequences_are_views(spark):
    path = scratch(spark, "t")
    frame = spark.createDataFrame([(i, f"some text number {i}") for i in range(40)], "doc_id long, text string")
    manifest = write_token_files(frame, path, seq_len=8, batch_rows=4).filter("n_ids > 0").collect()
    for row in manifest:
        file, run = TokenFile(path, row.shard), []
        for k in range(row.n_sequences):
            values, mask = file.sequence(k)
            assert len(values) == len(mask) == 8 and not values.flags.owndata and not mask.flags.owndata
            file.source.seek(0)
            mapped = file.source.read_buffer()  # the map itself
            assert mapped.address <= values.ctypes.data < mapped.address + mapped.size
            assert mask.ctypes.data == file.sequence(k)[1].ctypes.data  # the dictionary's memory, whoever asks
            run += values[mask == 1].tolist()
        assert run == file.ids(0, row.n_ids).tolist()


def test_op2(spark, docs, ids):
    got = op2_packing(spark, SF).toPandas()
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and crc(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for d, pieces in got.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        assert (pieces["start"] == pieces["length"].cumsum() - pieces["length"]).all() and pieces["length"].sum() == len(ids[d])
    total = got.groupby("sequence_id")["length"].sum()
    assert total.max() <= 2048 and (total < 2048).sum() <= 1


@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 100)), max_size=60), st.integers(1, 4), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_packer_keeps_every_limit(examples, segments, loss):
    placed = []
    packer = DotProductPacker(lambda *x: placed.append(x), 40, segments, loss, window=4)
    masks = [np.arange(n) % 100 < share for n, share in examples]
    for k, ((n, _), mask) in enumerate(zip(examples, masks)):
        packer.add(k, n, mask)
    packer.finish()
    covered = {k: [] for k in range(len(examples))}
    bins = {}
    for k, start, length, b, offset, lossy in placed:
        covered[k] += range(start, start + length)
        assert masks[k][start : start + length].sum() == lossy and length > 0
        bins.setdefault(b, []).append((offset, length, lossy))
    assert all(sorted(v) == list(range(examples[k][0])) for k, v in covered.items())
    for pieces in bins.values():
        assert sum(p[1] for p in pieces) <= 40 and len(pieces) <= segments and sum(p[2] for p in pieces) <= loss


def largest_first(examples, max_tokens, max_segments, max_loss):
    """Bins of whole examples, each put into the first that holds it, by descending tokens."""
    bins = []
    for n, loss in sorted(examples, reverse=True):
        for b in bins:
            if b[0] + n <= max_tokens and b[1] + 1 <= max_segments and b[2] + loss <= max_loss:
                b[0], b[1], b[2] = b[0] + n, b[1] + 1, b[2] + loss
                break
        else:
            bins.append([n, 1, loss])
    return len(bins)


def test_op2_every_limit_binds_and_the_heuristic_balances():
    rng = np.random.default_rng(8)
    for limits in ((2048, 256, 700), (2048, 6, 2048), (2048, 8, 900), (2048, 7, 1100)):
        examples = [(int(n), int(n * share)) for n, share in zip(rng.integers(40, 700, 900), rng.choice([0.05, 0.9], 900))]
        placed = []
        packer = DotProductPacker(lambda *x: placed.append(x), *limits, window=300)
        for k, (n, loss) in enumerate(examples):
            packer.add(k, n, np.arange(n) < loss)
        packer.finish()
        sums = {}
        for _, _, length, b, _, loss in placed:
            t = sums.setdefault(b, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + length, t[1] + 1, t[2] + loss
        assert all(x <= y for t in sums.values() for x, y in zip(t, limits))
        assert any(t[0] < 2048 and (t[1] == limits[1] or t[2] >= limits[2] - 1) for t in sums.values())  # another limit was reached first
        assert len(sums) < largest_first(examples, *limits)


def largest_first_cut(lengths, max_tokens):
    """Pieces when each bin takes the largest that fits and then a cut of the largest one left."""
    waiting, pieces = sorted(lengths, reverse=True), 0
    while waiting:
        room = max_tokens
        while waiting and room:
            k = next((i for i, n in enumerate(waiting) if n <= room), None)
            pieces += 1
            if k is None:
                waiting[0] -= room
                waiting.sort(reverse=True)
                room = 0
            else:
                room -= waiting.pop(k)
    return pieces


def test_op2_cuts_hardly_more_than_largest_first():
    rng = np.random.default_rng(3)
    for _ in range(3):
        lengths = [int(n) for n in np.minimum(rng.lognormal(5.5, 1.2, 600) + 1, 2047)]
        placed = []
        packer = DotProductPacker(lambda *x: placed.append(x), window=10_000)
        for k, n in enumerate(lengths):
            packer.add(k, n)
        packer.finish()
        assert len(placed) <= 1.04 * largest_first_cut(lengths, 2048)


def test_op2_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids, loss = {}, {}
    for r in turns.orderBy("conv_id", "turn").collect():
        coded = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        ids.setdefault(r.conv_id, []).extend(coded)
        loss.setdefault(r.conv_id, []).extend([r.role == "assistant"] * len(coded))
    limits = {"max_tokens": 512, "max_segments": 4, "max_loss": 300}
    got = pack_conversations(turns, **limits).toPandas()
    for r in got.itertuples():
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and sum(loss[r.doc_id][r.start : r.start + r.length]) == r.loss_tokens
    assert got.groupby("doc_id")["length"].sum().to_dict() == {c: len(v) for c, v in ids.items()}
    sums = got.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss_tokens", "sum"))
    assert sums["tokens"].max() <= 512 and sums["segments"].max() <= 4 and 290 <= sums["loss"].max() <= 300
    odd = spark.createDataFrame([(1, None, None, None), (1, 0, "assistant", "hi"), (None, 2, "user", "")], "conv_id long, turn int, role string, text string")
    assert pack_conversations(odd).agg({"length": "sum"}).first()[0] >= 4 and pack_conversations(odd.limit(0)).isEmpty()


def test_op3(spark, docs):
    got = op3_language_id(spark, SF).toPandas().merge(docs[["doc_id", "lang", "text"]], on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(held) and (held["lang"] == held["lang_pred"]).mean() >= 0.95 and got["score"].between(0, 1).all()


@given(st.text("ab", min_size=1, max_size=12))
@settings(deadline=None)
def test_forward_sums_all_segmentations(word):
    lattice = Lattice(["▁", "a", "b", "ab", "▁a", "ba", "aab"])
    table = np.random.default_rng(1).random((lattice.size, 2))

    def total(text):
        return np.ones(2) if not text else sum(table[lattice.index[text[:n]]] * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in lattice.index)

    assert np.allclose(np.exp(lattice.log_probability([word], table)[0]), total("▁" + word))

    def segmentations(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            if text[:n] in lattice.index:
                yield from ([lattice.index[text[:n]], *rest] for rest in segmentations(text[n:]))

    expected = np.zeros(lattice.size)
    every = [(np.prod(table[s, 0]), s) for s in segmentations("▁" + word)]
    for p, pieces in every:
        np.add.at(expected, pieces, 2 * p / sum(q for q, _ in every))
    assert np.allclose(lattice.expected_counts([word], [2], table[:, 0]), expected)
    assert np.allclose(lattice.expected_counts([word, "ab", word], [1, 3, 1], table[:, 0], held=1), expected + lattice.expected_counts(["ab"], [3], table[:, 0]))


def test_op3_trains_on_words_of_any_length():
    lattice = Lattice(["▁", "a", "b", "ab", "▁a", "ba", "aab"])
    table = np.full(lattice.size, 1e-4)
    used = lattice.expected_counts(["ab" * 5_000], [1], table)
    sizes = np.array([0, *map(len, lattice.index)])
    assert np.isclose(used @ sizes, 10_001) and np.isfinite(lattice.log_probability(["ab" * 5_000], table[:, None])).all()


def test_op3_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (2, "12")], "doc_id long, text string")
    pieces = 1 + len(lattice_of(None).index)
    got = {r.doc_id: r for r in identify(docs, ["aa", "bb"], np.vstack([np.log([[0.5, 0.5]]), np.full((pieces, 2), 1e-4)])).collect()}
    assert (got[1].lang_pred, got[1].score, got[2].lang_pred) == ("aa", 0.5, "und")


def test_op4_weights_by_force(spark, docs):
    """Every weight, toxicity and draw of the query, from plain counts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = labelled_sample(labels, 30_000).toPandas().set_index("doc_id")
    texts = dict(zip(docs["doc_id"], docs["text"]))
    buckets = 1 << 17

    def ngrams(text):
        one = [int.from_bytes(xxhash.xxh3_64_digest(t), "little") for t in re.findall(r"\w+|[^\w\s]+", text or "")]
        two = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(one, one[1:])]
        return one + [x ^ (x >> 32) for x in two]

    found = {d: ngrams(t) for d, t in texts.items()}
    raw = Counter(x % buckets for f in found.values() for x in f)
    fitted = sample[~sample["held"]]
    target = Counter(x % buckets for d in fitted.index[fitted["good"].eq(True)] for x in found[d])
    n_raw, n_target = raw.total(), target.total()
    p = lambda b: (raw[b] + 1) / (n_raw + buckets)
    ratio = lambda b: math.log((target[b] + buckets * p(b)) / (n_target + buckets)) - math.log(p(b))
    holds = {flag: Counter(x for d in fitted.index[fitted["toxic"] == flag] for x in set(found[d])) for flag in (True, False)}
    n = {flag: int((fitted["toxic"] == flag).sum()) for flag in (True, False)}
    excess = {}
    for x, t in holds[True].items():
        c = holds[False][x]
        r = math.log((t + 0.5) / (n[True] + 1)) - math.log((c + 0.5) / (n[False] + 1))
        if r - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) > 1.5:
            excess[x] = r
    got = op4_importance(spark, SF).toPandas().set_index("doc_id")
    toxicity = {d: sum(excess[x] for x in set(f) & set(excess)) for d, f in found.items()}
    for d, f in found.items():
        assert math.isclose(got.log_weight[d], sum(ratio(x % buckets) for x in f) / max(1, len(f)) / 0.02, rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(got.toxicity[d], toxicity[d], rel_tol=1e-9, abs_tol=1e-9)
    held = sample[sample["held"]]
    most = max(toxicity[d] for d in held.index[~held["toxic"].astype(bool)])
    pool = got[got["toxicity"] <= most + 1e-9]
    drawn = got[got["kept"]]
    assert set(drawn.index) == set(pool["sample_key"].nlargest(len(drawn)).index)
    noise = got["sample_key"] - got["log_weight"]
    assert abs(noise.mean() - 0.5772) < 0.4 and abs(noise.std() - math.pi / math.sqrt(6)) < 0.4


def test_op4_leaves_toxic_documents_out(spark):
    rng = np.random.default_rng(1)
    words, slurs = [f"word{i}" for i in range(500)], [f"slur{i}" for i in range(8)]
    toxic = lambda i: i % 6 == 0
    rows = [(i, " ".join([*rng.choice(words, 300), *(rng.choice(slurs, 3) if toxic(i) else [])])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(toxic(i))) for i in range(0, 600)], "doc_id long, quality int, toxic int")
    got = importance_resample(docs, labels).toPandas().set_index("doc_id")["kept"]
    assert got[[not toxic(i) for i in got.index]].mean() > 0.97 and got[[toxic(i) for i in got.index]].mean() < 0.05
    assert importance_resample(docs, labels.filter("toxic = 0")).filter("toxicity > 0").isEmpty()


def test_op4_draw_follows_the_weights(spark):
    """The first of a draw is row i with probability w_i / sum of w; the second follows what is left."""
    weights = [1.0, 2.0, 4.0, 8.0]
    rows = spark.createDataFrame([(i, i * 31, math.log(w)) for i, w in enumerate(weights)], "doc_id long, row_key long, log_weight double").crossJoin(spark.range(6000).withColumnRenamed("id", "seed"))
    drawn = rows.withColumn("key", F.col("log_weight") + gumbel_noise(F.col("seed"))).groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("key", "doc_id")), False).alias("d")).select(F.col("d")[0].doc_id.alias("a"), F.col("d")[1].doc_id.alias("b")).toPandas()
    for i, w in enumerate(weights):
        assert abs((drawn["a"] == i).mean() - w / 15) < 0.02
        second = sum(v / 15 * w / (15 - v) for j, v in enumerate(weights) if j != i)
        assert abs((drawn["b"] == i).mean() - second) < 0.02


def test_op4_seeds_give_different_draws(spark):
    """Texts of one kind are near one another in weight, so of half of them each seed takes others; bad ones stay out."""
    rng = np.random.default_rng(0)
    words, junk = [f"word{i}" for i in range(60)], [f"zz{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(junk if i % 5 == 0 else words, 80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    draws = [importance_resample(docs, labels, share=0.4, seed=s).filter("kept").toPandas()["doc_id"] for s in (1, 2)]
    assert [len(d) for d in draws] == [160, 160]
    assert 20 < len(set(draws[0]) - set(draws[1])) and all((d % 5 != 0).all() for d in draws)


def test_op4_kth_and_cut(spark):
    values = [0.0] * 50 + [float(i) / 7 for i in range(2000)] + [1e300, -1e300]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 900, 2001, 2052, 5000):
        assert kth_largest(frame, "v", k, few=16) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert best_cut(np.array([1.0, 2.0]), np.array([-3.0, 0.0]), 1) == 0.5


def test_op4_rejects_the_bad(spark):
    rng = np.random.default_rng(0)
    words, junk = [f"word{i}" for i in range(60)], [f"zz{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(junk if i % 5 == 0 else words, 80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    got = importance_resample(docs, labels).toPandas()
    assert (got["kept"] == (got["doc_id"] % 5 != 0)).all()
    assert importance_resample(docs, labels, k=17).filter("kept").count() == 17


def test_op5(spark, docs):
    got = op5_secret_scan(spark, SF).toPandas().set_index("doc_id")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for d, t in zip(docs["doc_id"], docs["text"]):
        spans = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got.base_sha256[d] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(got.spans[d].split(","))
        assert [got[f"n_{k}"][d] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]


def test_op5_query_links_planted_credentials(spark, tmp_path):
    """Through the query itself: of each kind one part alone is no span, and the parts together are."""
    parts = {"ident": "client_id = web-7", "endpoint": "https://db.example.com/x", "opaque": "aB3xY7zQ" * 5}
    texts = [*parts.values(), f"{parts['ident']} with {parts['opaque']}", f"{parts['endpoint']} takes {parts['opaque']}", f"{parts['ident']}, password: hunter22", f"{parts['endpoint']}, secret=abcdefgh", f"AKIA{'A1' * 8} and {parts['opaque']}", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in op5_secret_scan(spark, str(tmp_path)).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["ident", "opaque"], 4: ["endpoint", "opaque"], 5: ["ident", "assign"], 6: ["endpoint", "assign"], 7: ["access", "opaque"], 8: [], 9: []}


def test_op5_links_complementary_parts():
    key = "aB3" + "xY7z" * 9 + "q"
    assert linked_spans(key, base_spans(key)) == []
    both = f"client_id=web-7 uses {key}"
    assert [k for k, _, _ in linked_spans(both, base_spans(both))] == ["ident", "opaque"]
    assert linked_spans(f"client_id=web-7\n\n{key}", []) == []
    assert linked_spans("client_id=web-7 " + "word " * 99 + key, []) == []
    url = "see https://db.example.com with password: hunter22"
    assert [k for k, _, _ in linked_spans(url, base_spans(url))] == ["endpoint"]
    assert linked_spans("see https://db.example.com and https://x.example.com", []) == []


def test_op5_links_whole_scopes_and_other_keys(spark):
    keys = ["aB3xY7zQ" * 4, "aB3xY7zQ" * 5 + "aB==", "aB3-Y7_Q" * 5 + "aB3=", "aB3xY/z+" * 8, "k3j4h5n6m7p8q9r2s3t4", "0123456789ABCDEF"]
    for key in keys:
        for sep in (" ", " key="):
            text = "client_id=web-7 " + "word " * 99 + "at" + sep + key
            assert linked_spans(text, base_spans(text), None) == [("ident", 0, 15), ("opaque", len(text) - len(key), len(text))], key
            assert linked_spans(text.replace(" word", "\n\nword", 1), [], None) == []
    for plain in ("internationalization-of-2024", "ontionretioninlyereander", "https://example.com/Docs-2024/Intro", "client_id=aB3xY7zQaB3xY7zQ"):
        assert linked_spans("client_id=web-7 " + plain, [], None) == []
    text = "client_id=web-7 " + "word " * 99 + keys[1]
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert redact_secrets(frame).first().text == "[secret] " + "word " * 99 + "[secret]"


PARTS = [
    "client_id=web-7", "user: bob.x", "https://db.example.com/path", "cache.internal.net:6379", "aB3xY7zQaB3xY7zQaB3x", "0123456789abcdef", "AKIA" + "Z9" * 9,
    "password=hunter22", "d" * 30, "plain words", "\n", "\n\n", "\n \t\n", "x" * 90, "word " * 30,
]


@given(st.lists(st.sampled_from(PARTS), max_size=14), st.sampled_from([None, 20, 200]))
@settings(max_examples=300, deadline=None)
def test_op5_links_as_all_pairs_do(parts, reach):
    text = " ".join(parts)
    base = base_spans(text)
    weak = weak_parts(text, base)
    is_secret = lambda s: s[0] in ("assign", "hex", "opaque")

    def links(a, b):
        first, second = sorted((a, b), key=lambda s: s[1])
        if is_secret(a) == is_secret(b) or re.search(r"\n[ \t\r]*\n", text[first[1] : second[1]]):
            return False
        return reach is None or max(a[1], b[1]) - min(a[2], b[2]) < reach

    expected = sorted({w for w in weak if any(links(w, other) for other in base + weak if other != w)}, key=lambda s: (s[1], s[0]))
    assert sorted(linked_spans(text, base, reach), key=lambda s: (s[1], s[0])) == expected


def test_op5_redacts(spark):
    frame = spark.createDataFrame([(1, "a token = abcdef0123 b", 5), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    assert [(r.text, r.n_chars) for r in redact_secrets(frame).orderBy("doc_id").collect()] == [("a [secret] b", 12), ("clean", 5), (None, None)]


def components_by_force(texts, percent=85):
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op6(spark, docs):
    got = op6_minhash_dedup(spark, SF).toPandas()
    expected = components_by_force(dict(zip(docs["doc_id"], docs["text"])))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == expected
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()


def test_op6_large_group_of_near_copies(spark):
    """Copies of one text with a few edits each, of which some only meet through others."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for d in range(120):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 6), replace=False):
            words[at] = f"x{rng.integers(0, 4)}"
        texts[d] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for rounds in (0, 1, 3):
        got = near_duplicates(frame, rounds=rounds).toPandas()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == components_by_force(texts)


def test_op7(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = op7_warc_bundle(spark, SF).toPandas().set_index("page_id")
    payload = pages["html"].fillna("").str.encode("utf-8")
    largest = pages["page_id"].groupby(payload).transform("max")
    import base64

    for p, b, r in zip(pages["page_id"], payload, largest):
        row = got.loc[p]
        assert (row.payload_bytes, row.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert row.record_type == ("response" if p == r else "revisit") and (pd.isna(row.refers_to) if p == r else row.refers_to == r)


def test_op7_random_access(spark):
    frame = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>" * 50) for i in range(60)], "page_id long, url string, html string")
    path = scratch(spark, "t")
    index = write_warc_bundles(frame, path, frame_bytes=4096).collect()
    fs, root = open_fs(f"{path}/bundles")
    assert len({(r.bundle, r.frame) for r in index}) > 5
    for r in index:
        with fs.open_input_file(f"{root}/bundle-{r.bundle:06d}.warc.zst") as source:
            ((headers, block, _, _),) = parse_records(BundleReader(source).record(r.frame, r.offset, r.length))
        assert headers["X-Page-ID"] == str(r.page_id) and block == f"<p>{r.page_id}</p>".encode() * 50


def test_op7_references_resolve(spark):
    """Also where several rows share the page_id of a response."""
    rows = [(5, "a", "same"), (5, "b", "same"), (5, "c", "other"), (3, "d", "same"), (4, "e", "once"), (2, "f", "twice"), (1, "g", "twice"), (None, "h", "twice")]
    path = scratch(spark, "t")
    index = write_warc_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), path).collect()
    ids, found = {f"<urn:quill:{r.record_id}>": r.page_id for r in index}, []
    assert len(ids) == len(rows)
    fs, root = open_fs(f"{path}/bundles")
    for r in index:
        with fs.open_input_file(f"{root}/bundle-{r.bundle:06d}.warc.zst") as source:
            ((headers, _, _, _),) = parse_records(BundleReader(source).record(r.frame, r.offset, r.length))
        if "WARC-Refers-To" in headers:
            assert str(ids[headers["WARC-Refers-To"]]) == headers["X-Refers-To-Page"]
        found += [(r.page_id, headers["X-Refers-To-Page"], "WARC-Refers-To" in headers)] if headers["WARC-Type"] == "revisit" else []
    assert sorted(found, key=str) == [(1, "2", True), (3, "5", False), (None, "2", True)]


def test_op8(spark, docs):
    got = op8_quality_rules(spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"]):
        w = WORDS.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = pd.Series(windows, dtype=object).value_counts() if windows else {}
        covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        row = got.loc[d]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (row.base_failed and row.kept)
    good = pd.read_parquet(f"{SF}/labels.parquet").query("quality == 1")["doc_id"]
    assert got.loc[good, "kept"].mean() > 0.8


def test_op8_verdict_by_force(spark, docs):
    """Fences from exact quartiles: a sketch of fewer values than it holds is exact, so every verdict must agree."""
    got = op8_quality_rules(spark, SF).toPandas().merge(docs[["doc_id", "lang", "source", "text"]], on="doc_id")
    lines = [max(1, sum(1 for x in t.split("\n") if WORDS.search(x))) for t in got["text"]]
    got["dup_line_share"], got["repeat_share"] = got["n_dup_lines"] / lines, got["n_repeat_words"] / got["n_words"].clip(lower=1)
    got["symbol_share"], got["mean_word_chars"] = got["n_symbols"] / got["word_chars"].clip(lower=1), got["word_chars"] / got["n_words"].clip(lower=1)
    judged = got[got["n_words"] >= 20]

    def fences(r, measure, spread):
        pair = judged[(judged["lang"] == r.lang) & (judged["source"] == r.source)][measure]
        lang = judged[judged["lang"] == r.lang][measure]
        values = pair if len(pair) >= 50 else lang if len(lang) >= 50 else judged[measure]
        low, high = np.quantile(values, [0.25, 0.75], method="inverted_cdf")
        width = 3 * max(high - low, spread)
        return low - width, high + width

    for r in got.itertuples():
        inside = all(getattr(r, m) <= fences(r, m, s)[1] for m, s in (("symbol_share", 0.01), ("dup_line_share", 0.1), ("repeat_share", 0.05), ("mean_word_chars", 0.6)))
        inside = inside and r.mean_word_chars >= fences(r, "mean_word_chars", 0.6)[0]
        assert r.kept == (not r.base_failed and (inside or r.n_words < 20)), r


def test_op8_a_value_on_a_fence_is_kept(spark):
    rows = [(i, " ".join(["word"] * 30 + [f"w{i}x{k}" for k in range(30)])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("web")})
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(frame).collect())
    counts = quality_rules._measured(quality_rules.base_counts(frame)).filter("doc_id = 0")
    limits = quality_rules.adaptive_thresholds(quality_rules._measured(quality_rules.base_counts(frame)))
    value, high = counts.first().symbol_share, limits.first().high_symbol_share
    edge = counts.withColumn("symbol_share", F.lit(high)).join(limits, ["lang", "source"]).filter(F.col("symbol_share").between(F.col("low_symbol_share"), F.col("high_symbol_share")))
    assert value < high and edge.count() == 1


def test_op8_each_measure_alone_rejects(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fresh = lambda n, chars=5: ["".join(rng.choice(list("abcdefgh"), chars)) for _ in range(n)]
    lines = lambda n: [" ".join(fresh(8)) for _ in range(n)]
    run = fresh(10)
    bad = {
        "symbol_share": "\n".join(lines(6)) + " ## ## ## ##",
        "dup_line_share": "\n".join(x for line in lines(5) for x in (line, "of same")),
        "repeat_share": " ".join(fresh(40) + run + fresh(20) + run + fresh(20)),
        "mean_word_chars": " ".join(fresh(48, 12)),
    }
    rows = [(i, "\n".join(lines(6)), "en", "web") for i in range(80)] + [(100 + k, t, "en", "web") for k, t in enumerate(bad.values())]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.quality_rules(frame).toPandas().set_index("doc_id").sort_index()
    assert not got["base_failed"].any() and got.loc[:99, "kept"].all() and not got.loc[100:, "kept"].any()
    for k, measure in enumerate(bad):
        with monkeypatch.context() as patch:
            patch.delitem(quality_rules.MEASURES, measure)
            rest = quality_rules.quality_rules(frame).toPandas().set_index("doc_id").sort_index()["kept"]
        assert rest.loc[100:].tolist() == [i == k for i in range(4)]


def test_op9(spark, docs, ids):
    got = op9_separator_scan(spark, SF).toPandas().set_index("doc_id")
    assert {d: got.n_tokens[d] for d in ids} == {d: len(v) for d, v in ids.items()}


def test_op10_counts_only_pairs_that_the_search_finds(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30])), (3, "w1 w2 w3 w4 w5 other words here"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[5:40])), (2, " ".join(words[2:20])), (3, "not in any of these documents at all")], "item_id long, text string")
    whole = containment._item_shingles(items)
    signatures = containment.item_signatures(whole, 80)
    sizes = {r.item_id: r["count"] for r in signatures.groupBy("item_id").count().collect()}
    assert sizes == {1: 7, 2: 4, 3: 2}  # of 31, 14 and 4 shingles
    found = {(r.doc_id, r.item_id) for r in containment.contained_items(docs, items).collect()}
    assert found == {(1, 1), (1, 2), (2, 2)}
    counted = containment.candidate_pairs(docs, signatures).select("doc_id", "item_id").collect()
    assert found <= {tuple(r) for r in counted}
    # Without an item's signature its pairs are counted no more, though its shingles are there.
    with monkeypatch.context() as patch:
        whole_signatures = containment.item_signatures
        patch.setattr(containment, "item_signatures", lambda w, p: whole_signatures(w, p).filter("item_id <> 2"))
        assert {(r.doc_id, r.item_id) for r in containment.contained_items(docs, items).collect()} == {(1, 1)}
    # The same rows come out where nothing may be broadcast.
    assert {(r.doc_id, r.item_id) for r in containment.contained_items(docs, items, broadcast_bytes=0).collect()} == found


def test_op9_counts_texts_that_spell_the_separator(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "", None, "plain"]
    path = scratch(spark, "t")
    order = write_flat_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = {r.doc_id: r.n_tokens for r in order.join(scan_token_files(spark, f"{path}/flat", block_ids=3), ["file", "ordinal"]).collect()}
    encoder = TextEncoder(vocabulary_path(), special_as_text=True)
    assert got == {i: len(encoder.encode_many([t], 1)[0]) // 2 for i, t in enumerate(texts)} and got[0] > 4 and got[2] == got[3] == 1


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_op9_stitches_blocks(spark, block):
    run = np.array([5, 9, 9, 7, 9, 1, 2, 3, 4, 5, 6, 9, 8, 8], "<u2")
    path = scratch(spark, "t")
    fs, root = open_fs(path)
    fs.create_dir(root)
    for name, data in (("part-000000.u16", run), ("part-000001.u16", run[:5]), ("part-000002.u16", run[:0])):
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(data.tobytes())
    got = sorted(map(tuple, scan_token_files(spark, path, end_id=9, block_ids=block).select("file", "ordinal", "start", "n_tokens", "closed").collect()))
    assert got == [(0, 0, 0, 2, True), (0, 1, 2, 1, True), (0, 2, 3, 2, True), (0, 3, 5, 7, True), (0, 4, 12, 2, False), (1, 0, 0, 2, True), (1, 1, 2, 1, True), (1, 2, 3, 2, True)]


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = con.sql(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda frame: sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in frame[columns].astype(object).values.tolist())
    assert plain(a) == plain(b)
