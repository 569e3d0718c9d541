"""Suffix dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Finds every byte covered by a string of ``length`` bytes that also starts
elsewhere (in any document, the same one included).

Spark side: the windows of ``length`` bytes are dealt to shards by their least
gram hash (minimiser), so equal windows share a shard.  Successive windows of
one shard form a stretch; equal stretches are counted by fingerprint, and a
shard that has one stretch, once, and in it its minimiser once, has no repeat
and is dropped.  Only the distinct stretches of the remaining shards fetch
their bytes.

Inside a shard: the transform is taken over blocks of eight bytes.  Suffixes
are sorted, the symbol before row r is the block that precedes its suffix, and
the map from a row to the row of its suffix without the first block is the
inverse of the backward step.  All intervals of common prefixes of l blocks are
extended backward, breadth first, to those of l + 1 blocks, so boundaries
between rows (the common-prefix values) come in increasing order; the search
stops at ``length``.  Rows that are then in one interval are the repeated
windows.

Shards above GROUP_BYTES distinct bytes take an exact way around: their
windows are counted by 128-bit hash in a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import GOLDEN, mix64, one_row_per_id, ragged, run_list, stage, steps, text_bytes

LENGTH, GRAM, BLOCK = 400, 32, 8
#: Windows in one stretch at most (runs of one hash, as in periodic text, are cut).
STRETCH = 512
#: Bytes that one transform takes: small shards together (so much that its arrays stay in the cache), one shard alone.
CHUNK_BYTES, GROUP_BYTES = 128_000, 4_000_000
_PART = 2_000_000      # bytes of one long text handled at a time


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each position."""
    n = len(raw) - GRAM + 1
    word = np.ndarray(len(raw) - 7, "<u8", np.ascontiguousarray(raw).data, strides=(1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = word[:n] * GOLDEN
        for k in range(8, GRAM, 8):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k:k + n]
        return mix64(h)


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    have, out = 1, h
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def stretches(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window, number of windows, and whether the minimiser stands there twice."""
    a = np.frombuffer(raw, np.uint8)
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(a) - length + 1, _PART):
        part = a[at:at + _PART + length - 1]
        h = _grams(part)
        m = _window_min(h, length - GRAM + 1)
        edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        size = np.diff(np.append(edge, len(m)))
        cut = -(-size // STRETCH)
        first = ragged_steps(edge, cut)
        size = np.minimum(STRETCH, np.repeat(edge + size, cut) - first)
        value = m[first]
        span = size + length - GRAM
        twice = np.add.reduceat((h[ragged(first, span)] == np.repeat(value, span)).astype(np.int64), np.cumsum(span) - span) > 1
        out.append((value.view(np.int64), first + at, size, twice))
    return tuple(np.concatenate(x) for x in zip(*out))     # type: ignore[return-value]


def ragged_steps(edge: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Starts of the pieces of runs that are cut into ``cut`` pieces of STRETCH."""
    k = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
    return np.repeat(edge, cut) + k * STRETCH


def _stretch_rows(docs: DataFrame, length: int) -> DataFrame:
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if len(text) < length:
                    continue
                m, first, size, twice = stretches(text, length)
                fp = np.frombuffer(b"".join(xxh3_128_digest(text[s:s + c + length - 1])
                                            for s, c in zip(first.tolist(), size.tolist())), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(m), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array(np.full(len(m), doc)),
                    pa.array(first), pa.array(size.astype(np.int32)), pa.array(twice)],
                    names=["m", "fp1", "fp2", "id", "start", "c", "twice"])

    return docs.mapInArrow(run, "m long, fp1 long, fp2 long, id long, start long, c int, twice boolean")


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order, dense rank and number of ranks of 64-bit keys."""
    order = np.argsort(key)
    s = key[order]
    step = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return order, rank, int(step[-1]) + 1 if len(key) else 0


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, flags of the starts whose ``length`` bytes occur at another start of any of the strings."""
    blocks = length // BLOCK
    # one byte after each string, so that its last whole block is followed by a position of its own
    size = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    end = np.cumsum(size)
    n = int(end[-1])
    raw = np.frombuffer(b"\0".join(strings) + b"\0" * (1 + BLOCK), np.uint8)
    symbol = np.ndarray(n, "<u8", raw.data, strides=(1,)).astype(np.uint64)
    left = np.repeat(end, size) - np.arange(n) - 1      # bytes of the string from here on
    tail = left < BLOCK
    # rank of the first block; the last bytes of a string hold no block and are ranks of their own
    first = np.empty(n, np.int64)
    inner = np.flatnonzero(~tail)
    first[inner] = _rank(symbol[inner].view(np.int64))[1] + n
    first[tail] = np.arange(int(tail.sum()))
    # sort suffixes by doubling the number of blocks
    order, rank, ranks = _rank(first)
    reach, after = 1, np.minimum(np.arange(n) + BLOCK, n - 1)
    while ranks < n:
        nxt = np.minimum(np.arange(n) + reach * BLOCK, n - 1)
        order, new, ranks = _rank(rank * (n + 1) + rank[nxt])
        settled = ranks == n or reach * BLOCK > int(size.max())
        rank, reach = new, 2 * reach
        if settled:
            break
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    step = row[after[order]]             # row of the suffix without its first block
    stop = tail[order]
    # boundaries between rows whose common prefix is shorter than one block, then two, ...
    symbol_edge = np.empty(n, bool)
    symbol_edge[0] = True
    symbol_edge[1:] = first[order][1:] != first[order][:-1]
    edge = symbol_edge
    for _ in range(blocks - 1):
        interval = np.cumsum(edge)
        ahead = interval[step]
        new = symbol_edge.copy()
        new[1:] |= ahead[1:] != ahead[:-1]
        if (new == edge).all():
            break
        edge = new
    interval = np.cumsum(edge) - 1
    many = np.bincount(interval)[interval] > 1
    flags = np.zeros(n, bool)
    flags[order[many & ~stop]] = True
    # starts with fewer than ``length`` bytes left are no windows
    flags &= left >= length
    return [f[:-1] for f in np.split(flags, end[:-1])]


def _runs(keys: list[tuple[int, int, int]], flags: list[np.ndarray]) -> pa.RecordBatch:
    keep = [(k, [{"s": int(x), "e": int(y)} for x, y in run_list(f)]) for k, f in zip(keys, flags) if f.any()]
    cols = list(zip(*(k for k, _ in keep))) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in cols),
         pa.array([r for _, r in keep], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
        names=["m", "fp1", "fp2", "runs"])


_RUN_TYPE = "m long, fp1 long, fp2 long, runs array<struct<s:int,e:int>>"


def _expand_shards(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the shards (m) of pieces (m, fp1, fp2, bytes), whole shards in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int, int]] = []
        held: list[bytes] = []
        total, last = 0, None
        for b in batches:
            for m, x, y, raw in zip(*(b.column(c).to_pylist() for c in ("m", "fp1", "fp2", "bytes"))):
                if total >= CHUNK_BYTES and m != last:
                    yield _runs(keys, repeated_windows(held, length))
                    keys, held, total = [], [], 0
                keys.append((m, x, y))
                held.append(raw)
                total, last = total + len(raw), m
        if held:
            yield _runs(keys, repeated_windows(held, length))

    return pieces.repartition("m").sortWithinPartitions("m").mapInArrow(run, _RUN_TYPE)


def _count_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same for shards too large for one task: windows are counted by 128-bit hash."""
    from xxhash import xxh3_128_digest

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, x, y, raw in zip(*(b.column(c).to_pylist() for c in ("m", "fp1", "fp2", "bytes"))):
                k = len(raw) - length + 1
                h = np.frombuffer(b"".join(xxh3_128_digest(raw[i:i + length]) for i in range(k)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, v)) for v in (m, x, y)] + [pa.array(np.arange(k, dtype=np.int32))]
                    + [pa.array(h[:, j].copy()) for j in (0, 1)], names=["m", "fp1", "fp2", "at", "h1", "h2"])

    windows = stage(pieces.mapInArrow(explode, "m long, fp1 long, fp2 long, at int, h1 long, h2 long"), "windows")
    many = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return windows.join(many, ["h1", "h2"]).groupBy("m", "fp1", "fp2").agg(
        F.transform(F.collect_list("at"), lambda i: F.struct(i.alias("s"), (i + 1).cast("int").alias("e"))).alias("runs"))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, runs): starts [s, e) of the repeated windows of documents (id, text bytes), for those that have any."""
    if length % BLOCK or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of {BLOCK} and {2 * GRAM} at least")
    key = ["m", "fp1", "fp2"]
    rows = stage(_stretch_rows(docs, length), "stretches")
    shards = rows.groupBy("m").agg(F.count("*").alias("k"), F.max("twice").alias("t")).where("k > 1 or t")
    rows = stage(rows.join(shards.select("m"), "m"), "stretches")
    distinct = stage(rows.groupBy(*key).agg(F.count("*").alias("k"), F.max("twice").alias("t"),
                                            F.min(F.struct("id", "start", "c")).alias("first")), "distinct")
    # shards with several distinct stretches, or with a repeat inside one that occurs once
    work = distinct.groupBy("m").agg(F.count("*").alias("d"), F.max("t").alias("t"),
                                     F.sum(F.col("first.c") + (length - 1)).alias("size")).where("d > 1 or t")
    todo = distinct.join(work.select("m", (F.col("size") > GROUP_BYTES).alias("large")), "m").select(
        *key, "large", "first.id", "first.start", "first.c")
    wanted = todo.groupBy("id").agg(F.collect_list(F.struct(*key, "large", "start", "c")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            rows = [(x["m"], x["fp1"], x["fp2"], x["large"], text[x["start"]:x["start"] + x["c"] + length - 1])
                    for text, cuts in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist()) for x in cuts]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([
                *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.binary())],
                names=[*key, "large", "bytes"])

    pieces = stage(docs.join(wanted, "id").select("text", "cuts").mapInArrow(
        cut, "m long, fp1 long, fp2 long, large boolean, bytes binary"), "pieces")
    found = _expand_shards(pieces.where("not large").drop("large"), length)
    large = pieces.where("large").drop("large")
    if not large.isEmpty():
        found = found.unionByName(_count_windows(large, length))
    whole = distinct.where("k > 1").select(*key, F.array(F.struct(F.lit(0).alias("s"), F.col("first.c").alias("e"))).alias("runs"))
    found = stage(found.unionByName(whole), "found").groupBy(*key).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return rows.join(found, key).groupBy("id").agg(F.flatten(F.collect_list(F.transform("runs", lambda r: F.struct(
        (r["s"] + F.col("start")).alias("s"), (r["e"] + F.col("start")).alias("e"))))).alias("runs"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct non-null id: id, n_bytes, n_removed, n_spans, kept_sha256, longest_span (bytes of the longest removed
    run), kept (bytes), spans ("start:end,...").

    Every byte covered by a string of ``length`` bytes that also starts
    elsewhere goes; all is judged on the input.  Null text is empty.  Rows
    with a null id are left out; of rows that repeat an id, the one with the
    smallest text counts.
    """
    rows = one_row_per_id(docs.select(docs[id_col].cast("long").alias("id"), text_bytes(text_col).alias("text"))
                          .where("id is not null"))
    joined = rows.join(repeats(rows, length), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            out = []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                step = np.zeros(len(text) + 1, np.int64)
                if runs:
                    np.add.at(step, [r["s"] for r in runs], 1)
                    np.add.at(step, [r["e"] + length - 1 for r in runs], -1)
                spans = run_list(np.cumsum(step[:-1]) > 0)
                done, kept = 0, []
                for s, e in spans.tolist():
                    kept.append(text[done:s])
                    done = e
                kept = b"".join([*kept, text[done:]])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            int((spans[:, 1] - spans[:, 0]).max()) if len(spans) else 0, kept, ",".join(f"{s}:{e}" for s, e in spans.tolist())))
            types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_span", "kept", "spans"]
    return joined.select("id", "text", "runs").mapInArrow(
        run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_span long, "
             "kept binary, spans string")
