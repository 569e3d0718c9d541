"""Line dedup by a range-partitioned, sorted scan of line hashes; the result is a keep bitmap per document.

1. Lines whose key (trimmed, A-Z in lower case) is long enough become rows
   (128-bit hash of the key, id, position).  No text is shuffled.
2. The rows are range-partitioned by hash, document (descending) and position
   and sorted so.  The whole order is the partitioning key, so a line that a
   third of all documents hold spreads over many partitions.
3. A scan reads each partition's runs of equal hashes: the first document of a
   run (the largest id) keeps its lines, and from the moment that the run has
   enough documents the lines of the others go.  At most the rows of
   ``min_docs`` - 1 documents are held.  Runs at a partition's edge send
   their rows on with a summary (at most two a partition); summaries of a hash
   are added up and decide those rows.
4. Positions to drop are gathered per document as a compressed bitmap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import drop_staged, one_row_per_id, stage, steps

MIN_CHARS, MIN_DOCS = 40, 5
DROP, PENDING, SUMMARY = 0, 1, 2
_SCAN = "kind tinyint, id long, pos int, h1 long, h2 long, shard int, docs long, first long, last long"


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, pos) of the lines of (id, text) whose key has ``min_chars`` code points or more."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            lines = pc.split_pattern(b.column("text").cast(pa.large_string()), "\n")
            at = lines.offsets.to_numpy().astype(np.int64)
            flat = lines.values.slice(at[0], at[-1] - at[0])
            row = np.repeat(np.arange(b.num_rows), np.diff(at))
            pos = np.arange(len(flat)) - np.repeat(at[:-1] - at[0], np.diff(at))
            keys = pc.ascii_trim_whitespace(flat)
            long_ = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
            keys = pc.ascii_lower(keys.take(pa.array(long_))).cast(pa.large_binary()).to_pylist()
            h = np.frombuffer(b"".join(map(xxh3_128_digest, keys)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), b.column("id").take(pa.array(row[long_])),
                pa.array(pos[long_].astype(np.int32))], names=["h1", "h2", "id", "pos"])

    return rows.mapInArrow(run, "h1 long, h2 long, id long, pos int")


class Scan:
    """The runs of one sorted partition; ``feed`` returns (kind, rows) to send on, ``end`` the rest."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key = None             # hash of the open run
        self.first_run = True       # whether it is the partition's first one, which may begin before it
        self.held = None            # its undecided rows
        self.docs = self.first = self.last = 0
        self.summaries: list[tuple] = []

    def _summary(self) -> None:
        self.summaries.append((*self.key, self.docs, self.first, self.last))

    def _open(self, rows: np.ndarray) -> None:
        self.key, self.first = (int(rows[0, 0]), int(rows[0, 1])), int(rows[0, 2])
        self.docs, self.last = 0, None

    def _count(self, ids: np.ndarray) -> None:
        self.docs += int(np.count_nonzero(ids[1:] != ids[:-1])) + (self.last is None or int(ids[0]) != self.last)
        self.last = int(ids[-1])

    def feed(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``rows``: h1, h2, id, pos in order."""
        if not len(rows):
            return
        if self.key is None:
            self._open(rows)
        change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts = np.concatenate([[0], change])
        ends = np.concatenate([change, [len(rows)]])
        k = 0
        if (int(rows[0, 0]), int(rows[0, 1])) == self.key:
            yield from self._more(rows[:ends[0]])
            k = 1
        if k == len(starts):
            return
        self._close()
        inner = slice(k, len(starts) - 1)                   # runs that begin and end in these rows
        if starts[inner].size:
            lo, hi = starts[k], ends[len(starts) - 2]
            part, begin = rows[lo:hi], starts[inner] - lo
            new_doc = np.ones(len(part), np.int64)
            new_doc[1:] = part[1:, 2] != part[:-1, 2]
            new_doc[begin] = 1
            docs = np.add.reduceat(new_doc, begin)
            run = np.repeat(np.arange(len(begin)), np.diff([*begin, len(part)]))
            yield DROP, part[(docs[run] >= self.min_docs) & (part[:, 2] != part[begin, 2][run])]
        tail = rows[starts[-1]:]
        self._open(tail)
        yield from self._more(tail)

    def _more(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Further rows of the open run."""
        decided = self.docs >= self.min_docs
        self._count(rows[:, 2])
        if self.first_run:
            yield PENDING, rows
            return
        if not decided:
            rows = rows if self.held is None else np.concatenate([self.held, rows])
            self.held = rows
            if self.docs < self.min_docs:
                return
        self.held = None
        yield DROP, rows[rows[:, 2] != self.first]

    def _close(self) -> None:
        """The open run ended inside the partition: with fewer documents than ``min_docs``, its held rows stay."""
        if self.first_run:
            self._summary()
        self.first_run, self.held = False, None

    def end(self) -> Iterator[tuple[int, np.ndarray]]:
        if self.key is not None:
            self._summary()
            if self.held is not None:
                yield PENDING, self.held


def scan(lines: DataFrame, min_docs: int) -> DataFrame:
    """Rows to drop, rows of edge runs, and the summaries of those (see ``_SCAN``)."""
    order = ("h1", "h2", F.desc("id"), "pos")
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)

    def rows_out(kind: int, rows: np.ndarray, shard: int) -> pa.RecordBatch:
        n = len(rows)
        null = pa.nulls(n, pa.int64())
        hashes = [pa.array(rows[:, k]) for k in (0, 1)] if kind == PENDING else [null, null]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int8)), pa.array(rows[:, 2]), pa.array(rows[:, 3].astype(np.int32)), *hashes,
            pa.array(np.full(n, shard, np.int32)), null, null, null], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = TaskContext.get().partitionId(), Scan(min_docs)
        for b in batches:
            for kind, rows in state.feed(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)):
                if len(rows):
                    yield rows_out(kind, rows, shard)
        for kind, rows in state.end():
            yield rows_out(kind, rows, shard)
        for h1, h2, docs, first, last in state.summaries:
            yield pa.RecordBatch.from_pylist([dict(kind=SUMMARY, h1=h1, h2=h2, shard=shard, docs=docs, first=first, last=last)],
                                             schema=schema)

    schema = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("shard", pa.int32()), ("docs", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    names = schema.names
    return dealt.mapInArrow(run, _SCAN)


def dropped_lines(scanned: DataFrame, min_docs: int) -> DataFrame:
    """(id, pos) of all lines to drop, from a staged ``scan``."""
    of_key = Window.partitionBy("h1", "h2")
    # a document whose rows of a hash lie in two partitions was counted in both
    again = F.coalesce((F.lag("last").over(of_key.orderBy("shard")) == F.col("first")).cast("long"), F.lit(0))
    keys = (scanned.where(F.col("kind") == SUMMARY).withColumn("again", again)
            .groupBy("h1", "h2").agg((F.sum("docs") - F.sum("again")).alias("n"), F.max("first").alias("keeper"))
            .where(F.col("n") >= min_docs))
    pending = scanned.where(F.col("kind") == PENDING).select("id", "pos", "h1", "h2")
    late = pending.join(F.broadcast(keys), ["h1", "h2"]).where("id <> keeper")      # keys: two rows a partition at most
    return scanned.where(F.col("kind") == DROP).select("id", "pos").unionAll(late.select("id", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct non-null id: id, n_lines, n_dropped, keep (zlib-compressed bits, one a line, the first line highest).

    A line goes if its key has ``min_chars`` code points or more, is found in
    ``min_docs`` documents or more, and this is not the largest id that has it.
    Null and empty text is one empty line.  Rows with a null id are left out;
    of rows that repeat an id, the one with the smallest text counts.  Other
    columns are not read.  An empty table gives an empty result.
    """
    return _bitmaps(_rows(docs, id_col, text_col), min_chars, min_docs).withColumnRenamed("id", id_col)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return one_row_per_id(docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
                          .where("id is not null"))


def _bitmaps(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    lines = stage(line_hashes(rows, min_chars), "lines")
    scanned = stage(scan(lines, min_docs), "scan")
    drop_staged(lines)
    drops = dropped_lines(scanned, min_docs).groupBy("id").agg(F.collect_list("pos").alias("gone"))
    counts = rows.select("id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone = b.column("n_lines").to_pylist(), b.column("gone").to_pylist()
            maps = []
            for k, g in zip(n, gone):
                keep = np.ones(k, bool)
                keep[g or []] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("n_lines"), pa.array([len(g or ()) for g in gone], pa.int64()),
                pa.array(maps, pa.binary())], names=["id", "n_lines", "n_dropped", "keep"])

    return counts.join(drops, "id", "left").mapInArrow(run, "id long, n_lines long, n_dropped long, keep binary")


def read_bitmap(keep: bytes, n_lines: int) -> np.ndarray:
    """The lines that stay, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id of ``bitmaps``: id, n_lines, n_dropped, kept_text (the lines that stay, joined by \\n), kept_sha256."""
    rows = _rows(docs, id_col, text_col)
    return _applied(rows, bitmaps.withColumnRenamed(id_col, "id")).withColumnRenamed("id", id_col)


def _applied(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            kept = []
            for text, n, gone, keep in zip(*(b.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep"))):
                if gone:
                    lines = text.split("\n")
                    text = "\n".join(lines[k] for k in np.flatnonzero(read_bitmap(keep, n)).tolist())
                kept.append(text)
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("n_lines"), b.column("n_dropped"), pa.array(kept, pa.string()),
                pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string())],
                names=["id", "n_lines", "n_dropped", "kept_text", "kept_sha256"])

    return rows.join(bitmaps, "id").mapInArrow(run, "id long, n_lines long, n_dropped long, kept_text string, kept_sha256 string")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_bitmaps`` applied to its own documents: id, n_lines, n_dropped, kept_text, kept_sha256."""
    rows = _rows(docs, id_col, text_col)
    return _applied(rows, _bitmaps(rows, min_chars, min_docs)).withColumnRenamed("id", id_col)
