"""Operator 11 against brute force: tries, rollups over parts and shards, and the rebuilt conversations."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quill.llm import prefix_trie as P


def rebuilt(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv_id, []).append((-(10**9) if turn is None else turn, digest, len(text.encode())))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(t[0] for t in turns[:d]), []).append((c, turns[d - 1][1] if d else 0, d == len(turns)))
    out = []
    for path, held in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)
        ends = ",".join(map(str, sorted(c for c, _, end in held if end)))
        out.append(
            (
                min(c for c, _, _ in held),
                len(path),
                min(c for c, _, _ in nodes[path[:-1]]) if path else None,
                len(held),
                sum(len(q) == len(path) + 1 and q[:-1] == path for q in nodes),
                sum(leaf(p) for p in below),
                sum((len(nodes[p]) - 1) * nodes[p][0][1] for p in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


def conversations(seed, n, turns=4, texts=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice("abcde"[:texts]) * r.randint(1, 2)) for c in r.sample(range(-n, 3 * n), n) for t in range(r.randint(1, turns))]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_rebuilt_paths_and_nodes(spark):
    for seed, n in ((1, 40), (2, 90)):
        rows = conversations(seed, n)
        paths = P.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)).cache()
        want = rebuilt(rows)
        assert {r.conv_id: (bytes(r.path), r.sizes) for r in paths.collect()} == {c: (b"".join(t[0] for t in v), [t[1] for t in v]) for c, v in want.items()}
        for shards, most in ((1, 1000), (3, 7), (7, 1)):
            tries = P.build_tries(paths, shards, most)
            assert found(P.trie_nodes(tries)) == brute(want)
            assert tries.count() >= len(want) // most
        paths.unpersist()


def test_upper_nodes_are_merged_alike_when_they_are_shuffled(spark):
    rows = conversations(3, 60)
    tries = P.build_tries(P.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)), 4, 5)
    assert found(P.trie_nodes(tries, broadcast_bytes=0)) == brute(rebuilt(rows))


def test_copies_of_one_conversation_are_spread_over_shards(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 500, 5) for t in range(3)] + [(1000 + 5 * c, 0, "user", str(c)) for c in range(60)]
    tries = P.build_tries(P.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)), 8, 10).cache()
    assert found(P.trie_nodes(tries)) == brute(rebuilt(rows))
    hot = hashlib.md5(b"4:usert0").digest()
    assert tries.filter(F.contains(F.col("labels"), F.lit(hot))).select("shard").distinct().count() > 2
    tries.unpersist()


def test_louds_navigation():
    paths = sorted({tuple(np.random.default_rng(i).integers(0, 3, i % 5)) for i in range(60)})
    digest = lambda p: b"".join(hashlib.md5(str(x).encode()).digest() for x in p)
    ordered = sorted(map(digest, paths))
    row = P.build_trie(ordered, np.ones(sum(map(len, paths)), np.int64), np.arange(len(paths)))
    trie = P.opened(row)
    nodes = {digest(p[:d]) for p in paths for d in range(len(p) + 1)}
    assert len(trie) == len(nodes) == 1 + len(trie.labels)
    for path in nodes:
        at = trie.find(path)
        assert at >= 0 and len(trie.children(at)) == sum(len(q) == len(path) + 16 and q.startswith(path) for q in nodes)
        assert all(trie.parents[k] == at and trie.find(path + trie.labels[k - 1].tobytes()) == k for k in trie.children(at))
    assert trie.find(hashlib.md5(b"none").digest()) == -1
    members = np.frombuffer(row["members"], np.int64)
    assert all(members[trie.find(p)] == sum(q.startswith(p) for q in ordered) for p in nodes)
    assert trie.rolled_up(np.ones((len(trie), 1), np.int64))[0, 0] == len(trie)


def test_edges(spark):
    assert found(P.trie_nodes(P.build_tries(P.rebuilt_paths(spark.createDataFrame([], SCHEMA))))) == []
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (2, 1, "user", "é\x00" * 3000), (2, 1, "user", "b"), (None, 1, "user", "x"), (7, 1, "user", "a"), (-8, 2, "user", "b")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"base": F.lit("x"), "path": F.lit(1)})
    assert found(P.trie_nodes(P.build_tries(P.rebuilt_paths(frame)))) == brute(rebuilt(rows))
