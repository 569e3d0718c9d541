"""Prefix trie of conversations from sorted turn-id matrices.

1. A turn becomes a 128-bit id (hash of role and text) and its text's bytes;
   no text is shuffled.  A conversation becomes the row of its ids in order.
2. Rows are range-partitioned by (ids, conversation): a shard holds a stretch
   of the sorted order, and copies of one conversation, however many, spread
   over shards.  The number of shards follows the number of turns.
3. In a shard, ids get dense codes and the rows become padded matrices of
   ``WIDTH`` columns (only rows that go on are in the next one, so padding is
   bounded by ``WIDTH`` a conversation).  ``numpy.lexsort`` orders a matrix, the
   change masks of its columns, OR-ed from the left, mark where the nodes of
   each depth start, and ``reduceat`` aggregates them.  Subtree sums go up depth
   by depth.
4. Only nodes on the paths of a shard's first and last row can lie in other
   shards, too.  They are sent on with a hash of their prefix and are added up;
   one small task (two paths a shard) sums them towards the root.  The ids that
   end in such a node come in ordered chunks that a digest streams over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import drop_staged, ragged, release, stage

WIDTH = 16                      # columns of a matrix
SHARD_TURNS = 1_000_000         # turns of a shard, on average
CHUNK = 1 << 20                 # ids whose decimals are one chunk
BROADCAST_ROWS = 200_000        # boundary nodes that are broadcast
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
INNER, BOUNDARY, ENDS = 0, 1, 2

_NODE = pa.schema([
    ("kind", pa.int8()), ("shard", pa.int32()), ("chunk", pa.int32()), ("depth", pa.int64()),
    ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("text_bytes", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("ends", pa.binary())])
_NODE_DDL = ", ".join(f"{f.name} " + {"int8": "tinyint", "int32": "int", "int64": "long", "string": "string",
                                       "binary": "binary"}[str(f.type)] for f in _NODE)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, t): per non-null conv_id its turns in order, as structs (turn, h1, h2, n_bytes).

    Null turns come first; equal turn numbers are ordered by their hashes.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"),
            F.xxhash64(F.lit(1), role, text).alias("h2"), F.octet_length(text).cast("long").alias("n_bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))


def rebuilt_turns(turns: DataFrame, family: int = 5, spread: int = 9) -> DataFrame:
    """Conversations that branch off another: the first h turns of conversation c - c % ``family``, then the own turns
    after the first h; h is the CRC-32 of c's decimal form modulo ``spread``."""
    h = (F.crc32(F.col("c.conv_id").cast("string").cast("binary")) % spread).cast("int")
    base = F.coalesce(F.col("b.t"), F.slice("c.t", 1, 0))
    rest = F.slice("c.t", h + 1, F.greatest(F.size("c.t") - h, F.lit(0)))
    return (turns.alias("c").join(turns.alias("b"), F.expr(f"b.conv_id = c.conv_id - c.conv_id % {int(family)}"), "left")
            .select("c.conv_id", F.concat(F.slice(base, 1, h), rest).alias("t")))


class ShardTrie:
    """The trie of a shard's rows: node arrays (``depth``, ``parent``, ...), and for each node the rows that end there."""

    def __init__(self, conv: np.ndarray, lens: np.ndarray, ids: np.ndarray, n_bytes: np.ndarray):
        """``ids``: (turns, 2) hashes of all rows, one after the other; ``n_bytes``: of each turn's text."""
        starts = np.cumsum(lens) - lens
        order = np.lexsort((ids[:, 1], ids[:, 0]))          # codes in the order of the hashes: that of the shards
        new = np.ones(len(order), bool)
        new[1:] = (ids[order[1:]] != ids[order[:-1]]).any(axis=1)
        code = np.empty(len(order), np.int32)
        code[order] = np.cumsum(new) - 1
        del order, new
        self.conv, self.lens, self.starts, self.ids = conv, lens, starts, ids
        depth, parent, first, count, size = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.full(1, conv.min())], [np.full(1, len(conv))], [np.zeros(1, np.int64)]
        empty = np.flatnonzero(lens == 0)
        end_rows, end_nodes = [empty[np.argsort(conv[empty])]], [np.zeros(len(empty), np.int64)]
        self.edges = self._edge_rows(code)
        paths: dict[int, list[int]] = {r: [0] for r in self.edges}
        rows, group, n_nodes, base = np.arange(len(conv)), np.zeros(len(conv), np.int64), 1, 0
        while True:
            live = lens[rows] > base
            rows, group = rows[live], group[live]
            if not len(rows):
                break
            matrix = np.full((len(rows), WIDTH), -1, np.int32)          # padding sorts first: a prefix before what goes on
            width = np.minimum(lens[rows] - base, WIDTH)
            at = ragged(np.zeros(len(rows), np.int64), width)
            matrix[np.repeat(np.arange(len(rows)), width), at] = code[np.repeat(starts[rows] + base, width) + at]
            order = np.lexsort((conv[rows], *matrix.T[::-1], group))
            rows, group, matrix = rows[order], group[order], matrix[order]
            mask = np.ones(len(rows), bool)
            mask[1:] = group[1:] != group[:-1]
            where = {r: int(np.flatnonzero(rows == r)[0]) for r in paths if lens[r] > base}
            node = group
            for c in range(WIDTH):
                mask[1:] |= matrix[1:, c] != matrix[:-1, c]
                seg = np.flatnonzero(mask)
                real = matrix[seg, c] >= 0
                if not real.any():
                    break
                begin = seg[real]
                count.append(np.diff(np.append(seg, len(rows)))[real])
                first.append(np.minimum.reduceat(conv[rows], seg)[real])
                parent.append(node[begin])
                depth.append(np.full(len(begin), base + c + 1))
                size.append(n_bytes[starts[rows[begin]] + base + c])
                number = np.full(len(seg), -1, np.int64)
                number[real] = n_nodes + np.arange(len(begin))
                n_nodes += len(begin)
                node = number[np.cumsum(mask) - 1]
                done = np.flatnonzero(lens[rows] == base + c + 1)       # in order of node and conversation
                end_rows.append(rows[done])
                end_nodes.append(node[done])
                for r, i in where.items():
                    if lens[r] > base + c:
                        paths[r].append(int(node[i]))
            group, base = node, base + WIDTH
        self.depth, self.parent, self.first, self.count, self.size = map(np.concatenate, (depth, parent, first, count, size))
        self.paths = paths
        self.level = np.cumsum([0, *map(len, depth)])
        self.end_rows, self.end_nodes = np.concatenate(end_rows), np.concatenate(end_nodes)

    def _edge_rows(self, code: np.ndarray) -> list[int]:
        """The rows that come first and last in the order of (ids, conversation)."""
        data, c, s, n = code.astype(">u4").tobytes(), self.conv.tolist(), self.starts.tolist(), self.lens.tolist()
        key = lambda i: (data[4 * s[i]:4 * (s[i] + n[i])], c[i])  # noqa: E731  a prefix sorts before what goes on
        return list({min(range(len(c)), key=key): 0, max(range(len(c)), key=key): 0})

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether a node is on an edge's path, and n_children, n_leaves and saved tokens: of a whole subtree for the
        other nodes; for those on a path, of their children that are not on one."""
        n = len(self.depth)
        edge = np.zeros(n, bool)
        edge[[k for path in self.paths.values() for k in path]] = True
        children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(len(self.level) - 2, -1, -1):
            own = np.arange(self.level[d], self.level[d + 1])
            own = own[~edge[own]]
            leaves[own] += children[own] == 0
            saved[own] += (self.count[own] - 1) * self.size[own]
            up = self.parent[own]
            np.add.at(children, up, 1)
            np.add.at(leaves, up, leaves[own])
            np.add.at(saved, up, saved[own])
        return edge, children, leaves, saved

    def prefix_keys(self) -> dict[int, tuple[int, int]]:
        """128-bit hashes of the prefixes of the nodes on the edges' paths."""
        from xxhash import xxh3_128
        keys = {}
        for r, path in self.paths.items():
            h, at = xxh3_128(), self.starts[r]
            for d, k in enumerate(path):
                if d:
                    h.update(self.ids[at + d - 1].astype("<i8").tobytes())
                keys[k] = tuple(np.frombuffer(h.digest(), ">i8").tolist())
        return keys


def shard_nodes(shard: int, conv: np.ndarray, lens: np.ndarray, ids: np.ndarray, n_bytes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard: whole ones, parts of boundary nodes, and the ids that end in those."""
    trie = ShardTrie(conv, lens, ids, n_bytes)
    edge, children, leaves, saved = trie.sums()
    keys = trie.prefix_keys()
    n = len(edge)
    by_node = np.argsort(trie.end_nodes, kind="stable")
    ended = conv[trie.end_rows[by_node]]
    bounds = np.searchsorted(trie.end_nodes[by_node], np.arange(n + 1))
    sha = np.full(n, EMPTY_SHA, object)
    has = np.flatnonzero(np.diff(bounds) > 0)
    for k in has[~edge[has]].tolist():
        h = hashlib.sha256()
        for j in range(bounds[k], bounds[k + 1], CHUNK):
            h.update((b"," if j > bounds[k] else b"") + _decimals(ended[j:min(j + CHUNK, bounds[k + 1])]))
        sha[k] = h.hexdigest()

    def batch(kind: int, rows: int, **cols) -> pa.RecordBatch:
        cols |= {"kind": np.full(rows, kind, np.int8), "shard": np.full(rows, shard, np.int32)}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows, f.type) for f in _NODE],
                                          schema=_NODE)

    inner = np.flatnonzero(~edge)
    for j in range(0, len(inner), 200_000):
        k = inner[j:j + 200_000]
        up = trie.parent[k]
        above = edge[up]                    # parents that other shards may change: their smallest member is joined later
        p = np.zeros((len(k), 2), np.int64)
        for x in np.unique(up[above]).tolist():
            p[up == x] = keys[x]
        yield batch(INNER, len(k), depth=trie.depth[k], conv_id=trie.first[k], n_convs=trie.count[k],
                    n_children=children[k], n_leaves=leaves[k], saved_tokens=saved[k], ends_sha256=sha[k],
                    parent_conv_id=pa.array(trie.first[up], mask=above),
                    p1=pa.array(p[:, 0], mask=~above), p2=pa.array(p[:, 1], mask=~above))
    k = np.flatnonzero(edge)
    own = np.array([keys[x] for x in k.tolist()], np.int64)
    up = [keys.get(x, (None, None)) for x in trie.parent[k].tolist()]
    yield batch(BOUNDARY, len(k), depth=trie.depth[k], k1=own[:, 0], k2=own[:, 1], p1=[x[0] for x in up], p2=[x[1] for x in up],
                conv_id=trie.first[k], n_convs=trie.count[k], text_bytes=trie.size[k], n_children=children[k],
                n_leaves=leaves[k], saved_tokens=saved[k])
    for x, (k1, k2) in zip(k.tolist(), own.tolist()):
        for c, j in enumerate(range(bounds[x], bounds[x + 1], CHUNK)):
            yield batch(ENDS, 1, chunk=[c], depth=[int(trie.depth[x])], k1=[k1], k2=[k2],
                        ends=[_decimals(ended[j:min(j + CHUNK, bounds[x + 1])])])


def _decimals(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def sharded(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """``shard_nodes`` of (conv_id, t), range-partitioned by turn ids and conv_id."""
    seq = F.flatten(F.transform("t", lambda x: F.array(x["h1"], x["h2"])))
    flat = rows.select("conv_id", seq.alias("ids"), F.col("t.n_bytes").alias("n_bytes"))
    dealt = flat.repartitionByRange(*([shards] if shards else []), "ids", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, lens, ids, size = [], [], [], []
        for b in batches:
            conv.append(b.column("conv_id").to_numpy())
            at = b.column("n_bytes").offsets.to_numpy()
            lens.append(np.diff(at).astype(np.int64))
            size.append(b.column("n_bytes").values.to_numpy()[at[0]:at[-1]])
            ids.append(b.column("ids").values.to_numpy()[2 * at[0]:2 * at[-1]])
        if sum(map(len, conv)):
            yield from shard_nodes(TaskContext.get().partitionId(), np.concatenate(conv), np.concatenate(lens),
                                   np.concatenate(ids).reshape(-1, 2), np.concatenate(size))
        release()

    return dealt.mapInArrow(run, _NODE_DDL)


def recombine(parts: DataFrame) -> DataFrame:
    """Boundary nodes, added up over their shards and summed towards the root.

    The sum runs in one task: its rows are two paths a shard, whatever the
    number of conversations.
    """
    same = parts.groupBy("depth", "k1", "k2").agg(
        F.first("p1", True).alias("p1"), F.first("p2", True).alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.max("text_bytes").alias("text_bytes"), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: -r["depth"])
        of = {(r["k1"], r["k2"], r["depth"]): r for r in rows}
        for r in rows:                      # deepest first
            r["n_leaves"] += r["n_children"] == 0
            r["saved_tokens"] += (r["n_convs"] - 1) * r["text_bytes"]
            up = of.get((r["p1"], r["p2"], r["depth"] - 1))
            r["parent_conv_id"] = up and up["conv_id"]
            if up:
                up["n_children"] += 1
                up["n_leaves"] += r["n_leaves"]
                up["saved_tokens"] += r["saved_tokens"]
        for j in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[j:j + 10_000], schema=schema)

    names = ["depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    return same.repartition(1).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def end_digests(chunks: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 over the chunks of a node, in the order of shard and chunk.

    A digest is sequential, so the chunks of one node meet in one task; it streams over them.
    """
    key = ("depth", "k1", "k2")
    dealt = chunks.select(*key, "shard", "chunk", "ends").repartition(*key).sortWithinPartitions(*key, "shard", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            for *k, text in zip(*(b.column(c).to_pylist() for c in (*key, "ends"))):
                if k != now:
                    if now:
                        yield out(now, h)
                    now, h = k, hashlib.sha256(text)
                else:
                    h.update(b",")
                    h.update(text)
        if now:
            yield out(now, h)

    def out(k: list[int], h) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in k), pa.array([h.hexdigest()])], names=[*key, "ends_sha256"])

    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """Per node of the trie of (conv_id, t): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``t``: structs with h1, h2, n_bytes, as ``ordered_turns`` gives them; it may
    be empty (the conversation ends in the root).  ``shards`` (default: one for
    ``SHARD_TURNS`` turns, Spark's own number at least) is the number of ranges.
    The ids of a shard's conversations (16 bytes a turn) are in a task's memory.
    An empty table has no root.
    """
    spark = rows.sparkSession
    nodes = stage(sharded(rows, shards), "trie")
    boundary = stage(recombine(nodes.where(F.col("kind") == BOUNDARY)), "boundary")
    digests = end_digests(nodes.where(F.col("kind") == ENDS))
    top = (boundary.join(digests, ["depth", "k1", "k2"], "left")
           .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).select(*OUT))
    above = boundary.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                            F.col("conv_id").alias("above"))
    if boundary.count() <= BROADCAST_ROWS:
        above = F.broadcast(above)
    inner = (nodes.where(F.col("kind") == INNER).join(above, ["depth", "p1", "p2"], "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*OUT))
    return inner.unionByName(top)


def n_shards(conversations: DataFrame) -> int:
    least = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-conversations.count() // SHARD_TURNS))


def branched_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations (``rebuilt_turns``) of (conv_id, turn, role, text).

    Null role or text is empty, null turns come first, rows that repeat a turn
    number are all turns (in the order of their hashes); rows with a null
    conv_id are left out.  Other columns are not read.
    """
    turns = stage(ordered_turns(conversations), "turns")
    out = prefix_trie(rebuilt_turns(turns), shards or n_shards(conversations))
    drop_staged(turns)
    return out
