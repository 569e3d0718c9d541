"""Shared helpers: staging in the cluster's shared folder and Arrow word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir

#: Text bytes that one vectorised step handles at most (a longer text is a step of its own).
STEP_BYTES = 3_000_000
#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64

M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the reliable checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


#: Spark deletes a query's shuffle files when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    Once it is written, the shuffle files of the query are of no use and deleted.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def drop_staged(df: DataFrame) -> None:
    """Delete the folder of a table that ``stage`` wrote and that no later step reads."""
    _delete(df.sparkSession, _folders(df))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those given to the function that this yields.

    A table that is kept belongs to the scope around this one, if there is one.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rpartition("/")[2] for f in _folders(df))
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.pop()
        stays = [p for p in made if p.rpartition("/")[2] in kept]
        _delete(spark, (p for p in made if p not in stays))
        if _SCOPES:
            _SCOPES[-1].extend(stays)


_BEFORE: dict[str, list[str]] = {}


@contextmanager
def step_of(spark: SparkSession, chain: str) -> Iterator[None]:
    """A step of a chain whose every output is written before the next step begins: what the step before staged is
    deleted first, what this one stages stays for its output."""
    _delete(spark, _BEFORE.pop(chain, ()))
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        _BEFORE[chain] = made


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """``rows`` unless values of ``id`` repeat; then the least row of each id by the other columns, in reverse order
    (the text first).  Repeats are looked for on the id column alone."""
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    rest = [c for c in reversed(rows.columns) if c != "id"]
    least = rows.groupBy("id").agg(F.min(F.struct(*rest)).alias("r"))
    return stage(least.select(*(F.col("id") if c == "id" else F.col("r")[c].alias(c) for c in rows.columns)), "unique")


def text_bytes(col: str = "text"):
    """The text as bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.expr("X''"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a bijection of 64-bit words)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


_HELD: dict[tuple, Any] = {}
#: Where the C library has it: what numpy and tokenizers freed stays the process's own until it is asked for.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give memory that a worker no longer needs back to its machine."""
    gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    if _TRIM is not None:
        _TRIM(0)


def held(key: tuple, build: Callable[[], Any]) -> Any:
    """What a worker keeps from one task to the next (a vocabulary, an automaton).

    One thing at a time: Spark uses its workers for all stages, and what each
    operator of a chain holds would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = build()
    return _HELD[key]


def hold_nothing() -> None:
    """For operators that keep nothing: drops what the one before them kept."""
    held((), object)


def split(batch: pa.RecordBatch, col: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch that hold at most STEP_BYTES of ``col`` (one row at least)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0)
    end = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + STEP_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def steps(batches: Iterator[pa.RecordBatch], col: str = "text") -> Iterator[pa.RecordBatch]:
    """The parts of all batches of a task, whose memory is given back at its end."""
    for batch in batches:
        for part in split(batch, col):
            yield part
            pa.default_memory_pool().release_unused()
    release()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, as codes into a list of distinct words.

    ``codes``: the words of all rows, one after the other; ``starts``: row i has
    ``codes[starts[i]:starts[i + 1]]``; ``distinct``: Arrow strings.
    """

    def __init__(self, text: pa.Array, lower: bool = False):
        text = pc.fill_null(text.cast(pa.string()), "")
        if lower:
            text = pc.ascii_lower(text)
        parts = pc.ascii_split_whitespace(text.cast(pa.large_string()))
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        enc = flat.dictionary_encode()
        codes = enc.indices.to_numpy(zero_copy_only=False)
        self.distinct = enc.dictionary
        empty = pc.index(self.distinct, pa.scalar("", self.distinct.type)).as_py()
        if empty >= 0:          # around leading and trailing white space
            keep = codes != empty
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
        self.codes, self.starts = codes, offsets
        self.counts = np.diff(offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return string_hashes(self.distinct)


def string_hashes(strings: pa.Array, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each large_string: eight bytes of all strings at a time, long ones one by one."""
    from xxhash import xxh3_64_intdigest
    n = len(strings)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + n + 1]
    start, size = at[:-1] - at[0], np.diff(at)
    flat = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
    if len(flat) > 8:
        flat[:-8] = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    eight = np.ndarray(len(flat) - 7, "<u8", flat, strides=(1,))        # the eight bytes from each byte on
    out = mix64(mix64(size.astype(np.uint64) + np.uint64(1)) + np.uint64(seed))
    rows = np.flatnonzero(size <= LONG_WORD)
    for j in range(0, LONG_WORD, 8):
        rows = rows[size[rows] > j]
        if not len(rows):
            break
        spare = np.maximum(8 - (size[rows] - j), 0).astype(np.uint64) * np.uint64(8)
        out[rows] = mix64(out[rows] ^ ((eight[start[rows] + j] << spare) >> spare))
    far = np.flatnonzero(size > LONG_WORD)
    words = strings.take(pa.array(far)).to_pylist()
    out[far] = np.fromiter((xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(far))
    return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lens[i] - 1 for each i, one after the other."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - first, lens)


def run_list(flags: np.ndarray) -> np.ndarray:
    """Maximal runs of True as an (n, 2) array of [start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.reshape(-1, 2)
