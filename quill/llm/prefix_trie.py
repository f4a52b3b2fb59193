"""Operator 11: conversation prefixes in succinct level-order tries.

A conversation is a path of turn digests (md5 of role and text, 16 bytes a turn). Paths are
put in order, bytes first and conv_id behind, and cut into shards at paths of a sample, so
a shard holds the paths from one cut to the next and a prefix that many conversations
share, or many copies of one conversation, are spread over as many shards as they need.
Each shard is streamed in parts of bounded size. A part is a LOUDS trie made with numpy:
in level order as many ones as a node has children and then a zero, with an array of
labels, members, smallest members, text bytes and ends. Parents are found by rank and
select, and sums roll up from the last level to the first with add.at.

As paths are in order, only the nodes on the first and the last path of a part can have
members elsewhere. What lies beneath them is counted in the part in which its last member
stands, which the next path tells, so the sums of parts add up: these heavy upper levels
are merged by a grouping of their own, two paths a part, and all other nodes are final in
their part. Digests of the conversations that end at an upper node are taken over its
parts' lists in order, one list at a time.

A conversation travels as one row of 24 bytes a turn. Null role or text: empty. Null turns
come first, rows of one turn follow by digest, repeated rows are further turns. Rows with a
null conv_id belong to no conversation. An empty table has no members and gives no node;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm.common import intermediates, materialize, slices, table

WIDTH = 16
_LABEL = np.dtype(f"V{WIDTH}")


class LoudsTrie:
    """Navigation in a level-order trie: bits (ones for children, a zero behind them, node by node) and a label for each node but the root. Nodes are numbered in level order, the root is 0."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits.astype(bool), labels
        self.zeros = np.flatnonzero(~self.bits)  # select of zeros: where the children of each node end
        self.degrees = np.diff(self.zeros, prepend=-1) - 1
        ones = np.flatnonzero(self.bits)
        self.parents = np.concatenate([[-1], ones - np.arange(len(ones))])  # the zeros before a node's one

    def __len__(self) -> int:
        return len(self.zeros)

    def children(self, node: int) -> range:
        first = int(self.zeros[node] - self.degrees[node] - node) + 1  # the ones before it
        return range(first, first + int(self.degrees[node]))

    def levels(self) -> list[int]:
        """Where each level starts, and where the last one ends."""
        bounds = [0, 1]
        while bounds[-1] > bounds[-2]:
            bounds.append(int(self.zeros[bounds[-1] - 1] - bounds[-1] + 1) + 1)
        return bounds[:-1]

    def find(self, path: bytes) -> int:
        """The node of a path, -1 if there is none."""
        node = 0
        for at in range(0, len(path), WIDTH):
            label = np.frombuffer(path, _LABEL, 1, at)[0]
            node = next((k for k in self.children(node) if self.labels[k - 1] == label), -1)
            if node < 0:
                break
        return node

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (a row a node) over subtrees: from the last level to the first, each node is added to its parent."""
        out, bounds = values.copy(), self.levels()
        for low, high in zip(bounds[-2:0:-1], bounds[:1:-1]):
            np.add.at(out, self.parents[low:high], out[low:high])
        return out


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """How many first turns two paths share; -1 where one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = np.frombuffer(a, _LABEL, n), np.frombuffer(b, _LABEL, n)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def build_trie(paths: list[bytes], sizes: np.ndarray, conv_ids: np.ndarray) -> dict:
    """The trie of ordered paths. sizes: the bytes of all turns, path by path. members, first (smallest conv_id), text bytes and number of ends of each node, and the conv_ids that end at each, in order."""
    lengths = np.array([len(p) // WIDTH for p in paths], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(paths), _LABEL)
    node, rows = np.zeros(len(paths), np.int64), np.arange(len(paths))
    members, first, text = [[len(paths)]], [[conv_ids.min()]], [[0]]
    parents, labels, depth, total = [], [], 0, 1
    ended = [rows[lengths == 0]]
    while True:
        depth += 1
        rows = rows[lengths[rows] >= depth]
        if not len(rows):
            break
        at = starts[rows] + depth - 1
        new = np.ones(len(rows), bool)
        new[1:] = (node[rows[1:]] != node[rows[:-1]]) | (flat[at[1:]] != flat[at[:-1]])
        begin = np.flatnonzero(new)
        parents.append(node[rows[begin]])
        labels.append(flat[at[begin]])
        members.append(np.diff(begin, append=len(rows)))
        first.append(np.minimum.reduceat(conv_ids[rows], begin))
        text.append(sizes[at[begin]])
        node[rows] = total + np.cumsum(new) - 1
        total += len(begin)
        ended.append(rows[lengths[rows] == depth])
    degrees = np.bincount(np.concatenate(parents), minlength=total) if parents else np.zeros(1, np.int64)
    bits = np.ones(len(degrees) + int(degrees.sum()), np.uint8)
    bits[np.cumsum(degrees) + np.arange(total)] = 0
    ended = np.concatenate(ended)  # by depth, and within it in the order of nodes
    return {
        "nodes": total,
        "louds": np.packbits(bits).tobytes(),
        "labels": np.concatenate(labels).tobytes() if labels else b"",
        "members": np.concatenate(members).astype(np.int64).tobytes(),
        "first": np.concatenate(first).astype(np.int64).tobytes(),
        "text_bytes": np.concatenate(text).astype(np.int64).tobytes(),
        "ends": np.bincount(node[ended], minlength=total).astype(np.int64).tobytes(),
        "end_ids": conv_ids[ended].astype(np.int64).tobytes(),
    }


TRIE = "shard int, part int, first_depth int, last_depth int, next_depth int, nodes long, louds binary, labels binary, members binary, first binary, text_bytes binary, ends binary, end_ids binary"


def opened(row: dict) -> LoudsTrie:
    n = row["nodes"]
    bits = np.unpackbits(np.frombuffer(row["louds"], np.uint8))[: 2 * n - 1]
    return LoudsTrie(bits, np.frombuffer(row["labels"], _LABEL))


def turn_paths(turns: DataFrame) -> DataFrame:
    """conv_id, turns (digest and size, in order) of (conv_id, turn, role, text), dealt by conv_id less its last digit to five."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).filter("conv_id is not null")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.select((F.col("conv_id") - F.col("conv_id") % 5).alias("base"), "conv_id", "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
    said = F.array_sort(F.collect_list(F.struct("turn", "digest", "size")))
    return rows.repartition("base").groupBy("base", "conv_id").agg(said.alias("turns"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path, sizes of every conversation after its first h turns gave way to those of the conversation at the multiple of five below it; h is the remainder by nine of crc32 of the decimal conv_id."""
    own = turn_paths(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))).over(Window.partitionBy("base"))
    none = F.slice("turns", 1, 0)
    spliced = F.concat(F.slice(F.coalesce(head, none), F.lit(1), h.cast("int")), F.slice("turns", (h + 1).cast("int"), F.greatest(F.size("turns") - h, F.lit(0)).cast("int")))
    out = own.select("conv_id", F.when(F.col("conv_id") == F.col("base"), F.col("turns")).otherwise(spliced).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return out.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def shard_cuts(paths: DataFrame, shards: int, most_bytes: int = 16 << 20) -> list[tuple[bytes, int]]:
    """(path, conv_id) of the first row of each shard but the first one: quantiles of a sample by a hash of conv_id, 64 rows a shard, or as many as hold most_bytes."""
    order = [F.xxhash64("conv_id"), F.col("conv_id")]
    drawn = paths.orderBy(*order).limit(64 * shards)
    lengths = np.cumsum([r[0] for r in drawn.select(F.octet_length("path")).collect()])  # bounded by the shards
    n = int((lengths <= most_bytes).sum())
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in paths.orderBy(*order).limit(n).select("path", "conv_id").collect()) if n else []
    at = np.unique(np.arange(1, shards) * len(sample) // shards)
    return [sample[i] for i in at if i]


def build_tries(paths: DataFrame, shards: int | None = None, most_rows: int = 1 << 15, most_bytes: int = 8 << 20) -> DataFrame:
    """A row a part of the trie of (conv_id, path, sizes), which is read twice; parts are of most_rows conversations, or of most_bytes of paths."""
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(shard_cuts(paths, shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in slices(batches, 4096):
            shard = [bisect_right(cuts, x) for x in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """shard, paths, sizes, conv_ids of each part, and the path behind it."""
        cuts, held, shard, weight = shared.value, [], None, 0
        for batch in slices(batches, 4096):
            flat, ends = batch.column(3).flatten().to_numpy(), batch.column(3).offsets.to_numpy()
            ends = ends - ends[0]
            for i, (s, conv_id, path) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)])):
                if held and (s != shard or len(held) >= most_rows or weight >= most_bytes):
                    yield shard, held, path if s == shard else cuts[shard][0]
                    held, weight = [], 0
                shard, weight = s, weight + len(path)
                held.append((path, conv_id, flat[ends[i] : ends[i + 1]]))
        if held:
            yield shard, held, cuts[shard][0] if shard < len(cuts) else None

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = [f.split()[0] for f in TRIE.split(", ")], (None, None)
        count = 0
        for shard, held, after in parts(batches):
            count = count + 1 if last[0] == shard else 0
            trie = build_trie([h[0] for h in held], np.concatenate([h[2] for h in held]), np.array([h[1] for h in held], np.int64))
            first, final = held[0][0], held[-1][0]
            trie |= {
                "shard": shard,
                "part": count,
                # Depths to which the first path's nodes may have members before, and the last path's have some behind.
                "first_depth": common_turns(last[1], first) if last[0] == shard else len(first) // WIDTH,
                "last_depth": len(final) // WIDTH,
                "next_depth": common_turns(final, after),
            }
            last = shard, final
            yield pa.RecordBatch.from_pydict({k: [trie[k]] for k in names}, schema=_TRIE_SCHEMA)

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(deal, "shard int, conv_id long, path binary, sizes array<long>")
    ordered = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return ordered.mapInArrow(build, TRIE)


_TRIE_SCHEMA = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in TRIE.split(", ")])
_NODES = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, shard int, part int"


def _ids(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def part_nodes(row: dict) -> dict[str, list]:
    """The nodes of one part. Upper ones, which may have members in other parts, have a key `node`, and in `ends` the list of conv_ids instead of its digest; nodes under an upper one have its key as `parent`."""
    trie = opened(row)
    n, bounds = len(trie), trie.levels()
    members, first, text, ends = (np.frombuffer(row[k], np.int64) for k in ("members", "first", "text_bytes", "ends"))
    depth = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # The first path's nodes are the first of their levels, the last path's the last ones.
    closes, keys = np.ones(n, bool), {}
    left = [bounds[d] for d in range(min(row["first_depth"], len(bounds) - 2) + 1)]
    right = [bounds[d + 1] - 1 for d in range(row["next_depth"] + 1)]
    closes[right] = False
    for side in (left, right):
        digest = hashlib.md5()
        for k in side:
            digest.update(trie.labels[k - 1].tobytes() if k else b"")
            keys[k] = digest.digest()
    sums = trie.rolled_up(np.stack([closes & (trie.degrees == 0), members * text - closes * text], axis=1).astype(np.int64))
    children = np.zeros(n, np.int64)
    np.add.at(children, trie.parents[1:], closes[1:].astype(np.int64))
    upto = np.cumsum(ends)
    ids = np.frombuffer(row["end_ids"], np.int64)
    none = hashlib.sha256(b"").hexdigest()
    lists = [_ids(ids[e - k : e]) if k else "" for e, k in zip(upto.tolist(), ends.tolist())]
    parents = trie.parents.tolist()
    return {
        "node": [keys.get(k) for k in range(n)],
        "parent": [keys.get(p) for p in parents],
        "depth": depth,
        "conv_id": first,
        "parent_conv_id": [None if p < 0 or p in keys else int(first[p]) for p in parents],
        "n_convs": members,
        "n_children": children,
        "n_leaves": sums[:, 0],
        "saved_tokens": sums[:, 1],
        "ends": [s if k in keys else hashlib.sha256(s.encode()).hexdigest() if s else none for k, s in enumerate(lists)],
        "shard": np.full(n, row["shard"], np.int32),
        "part": np.full(n, row["part"], np.int32),
    }


_NODE_SCHEMA = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]]) for f in _NODES.split(", ")])


def _ends_digests(upper: DataFrame) -> DataFrame:
    """node, ends_sha256 of the upper nodes: their parts' lists in order, one at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in slices(batches, 16):
            out = []
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if key != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ends.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})

    lists = upper.filter("ends != ''").select("node", "shard", "part", "ends")
    return lists.repartition("node").sortWithinPartitions("node", "shard", "part").mapInArrow(digest, "node binary, ends_sha256 string")


def trie_nodes(tries: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """A row a node of the whole trie. Upper nodes go to the nodes beneath them while their counted rows, at 64 bytes each, are within broadcast_bytes; beyond that both are shuffled."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_pydict(part_nodes(batch.to_pylist()[0]), schema=_NODE_SCHEMA)

    nodes = materialize(tries.mapInArrow(roll, _NODES), "trie-nodes")
    pieces = nodes.filter("node is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    upper = pieces.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    upper = materialize(upper.join(_ends_digests(pieces), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "upper-nodes")
    small = 64 * upper.count() <= broadcast_bytes
    above = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    above = F.broadcast(above) if small else above
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    lower = nodes.filter("node is null").withColumnRenamed("ends", "ends_sha256")
    inside = lower.filter("parent is null").select(columns)
    beneath = lower.filter("parent is not null").drop("parent_conv_id").join(above, "parent").select(columns)
    return inside.unionByName(beneath).unionByName(upper.join(above, "parent", "left").select(columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with intermediates(spark, "trie-nodes", "upper-nodes"):
        paths = materialize(rebuilt_paths(table(spark, sf_dir, "conversations")), "paths")
        return trie_nodes(build_tries(paths))


OP11_SQL = r"""
WITH turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS place, md5(length(role) || ':' || role || text) AS turn, strlen(text) AS size FROM turns
), sizes AS (
    SELECT conv_id, max(place) AS n FROM own GROUP BY conv_id
), bytes AS (
    SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)) AS b FROM sizes
), heads AS (
    SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h FROM bytes
), rebuilt AS (
    SELECT heads.conv_id, own.place, own.turn, own.size FROM heads JOIN own ON own.conv_id = heads.conv_id - heads.conv_id % 5 AND own.place <= h
    UNION ALL
    SELECT own.conv_id, least(h, coalesce(base.n, 0)) + own.place - h, own.turn, own.size
    FROM own JOIN heads USING (conv_id) LEFT JOIN sizes base ON base.conv_id = heads.conv_id - heads.conv_id % 5 WHERE own.place > h
), prefixes AS (
    SELECT conv_id, place AS depth, size, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM sizes
), reach AS (
    SELECT conv_id, max(depth) AS d FROM prefixes GROUP BY conv_id
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = depth), '')) AS ends_sha256
    FROM prefixes JOIN reach USING (conv_id) GROUP BY path, depth
), children AS (
    SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), above AS (
    SELECT nodes.path, left(nodes.path, 32 * a) AS top, (n_convs - 1) * size AS saved, CAST(children.n IS NULL AS BIGINT) AS leaf
    FROM nodes LEFT JOIN children USING (path), unnest(range(0, depth + 1)) AS t(a)
), sums AS (
    SELECT top AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY top
)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
    CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums USING (path) LEFT JOIN children USING (path) LEFT JOIN nodes parent ON nodes.depth > 0 AND parent.path = left(nodes.path, 32 * (nodes.depth - 1))
"""
