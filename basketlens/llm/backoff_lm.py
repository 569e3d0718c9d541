"""Stupid-backoff language-model scores, computed by joins on n-gram hashes.

The n-gram count tables are partitioned by hash, and the n-grams of the
documents are joined to them.  Both sides move in packed form: a block of
documents (some megabytes of text) sends each of its distinct n-grams once,
with its own count, as sorted hashes cut by hash range; the task of a range
adds up the counts of all blocks and answers every block with the totals, in
the order of its request, so an answer is a list of numbers without keys.
Very frequent n-grams are one entry per block: there is no hot key.

Scores: S(w | context) = count(context, w) / count(context) if the n-gram was
seen ``min_count`` times, else ``alpha`` times the score with the context
shortened by its first word; a single word has count(w) / words.  An order k > 2 asks only
for n-grams whose two shorter parts were seen often enough (others cannot be).
Documents are scored by the sum of natural logarithms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import GOLDEN, Words, mix64, stage, steps, text_bytes

ORDER, ALPHA, MIN_COUNT = 5, 0.4, 2
#: Text bytes that one hash range stands for: sets the number of ranges, in proportion to the input.
RANGE_BYTES = 12_000_000


def _squeeze(values: np.ndarray) -> bytes:
    """64-bit numbers as byte planes, compressed."""
    import zstandard
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents (id, text) in blocks: block, ids, sizes (bytes), n_words, blob (compressed texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for b in steps(batches):
            texts = b.column("text").to_pylist()
            words = sum(len(t.split()) for t in texts)
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            yield pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]), pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([words], pa.int64()),
                pa.array([sum(map(len, texts))], pa.int64()), pa.array([blob], pa.binary())],
                names=["block", "ids", "sizes", "n_words", "n_bytes", "blob"])

    return docs.mapInArrow(run, "block string, ids array<long>, sizes array<long>, n_words long, n_bytes long, blob binary")


class _Block:
    """Word hashes of a block and, order by order, its n-grams and their counts in the corpus."""

    def __init__(self, sizes: list[int], blob: bytes):
        import zstandard
        raw = zstandard.ZstdDecompressor().decompress(blob) if sum(sizes) else b""
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.tobytes()), pa.py_buffer(raw))
        words = Words(text, lower=True)
        self.known, of = np.unique(mix64(words.hashes()), return_inverse=True)      # the distinct words need no sort of all
        self.code = of[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        self.word = self.known[self.code]
        self.starts, self.per_doc = words.starts, words.counts
        self.place = np.arange(len(self.word)) - np.repeat(words.starts[:-1], words.counts)
        self.gram = self.word        # of the current order, by last word
        self.totals: list[np.ndarray] = []      # per order, count in the corpus by last word (0: not asked for)

    def request(self, order: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions asked for, their n-grams' places in the sorted distinct list, that list, and own counts."""
        if order == 1:
            own = np.bincount(self.code, minlength=len(self.known))
            here = own > 0      # the list of a text that begins or ends with white space has the empty word, which is none
            return np.arange(len(self.code)), (np.cumsum(here) - 1)[self.code], self.known[here], own[here]
        ask = self.place >= order - 1
        with np.errstate(over="ignore"):
            before = np.concatenate([[np.uint64(0)], self.gram[:-1]])
            self.gram = mix64(before * GOLDEN + self.word + np.uint64(order))
        if order > 2:
            low = self.totals[-1]
            ask &= (low >= min_count) & (np.concatenate([[0], low[:-1]]) >= min_count)
        at = np.flatnonzero(ask)
        by = np.argsort(self.gram[at])
        sorted_ = self.gram[at][by]
        edge = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(by) else np.zeros(0, bool)
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(edge) - 1
        return at, place, sorted_[edge], np.diff(np.append(np.flatnonzero(edge), len(by)))

    def answer(self, order: int, min_count: int, totals: np.ndarray) -> None:
        at, place, *_ = self.request(order, min_count)
        out = np.zeros(len(self.word), np.int64)
        out[at] = totals[place] if len(place) else 0
        self.totals.append(out)


def _ranges(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash range of each sorted hash: the ranges present and where they begin."""
    of = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of[edge].astype(np.int64), np.append(edge, len(of))


_REQUEST = "block string, `order` int, part int, hashes binary, counts binary"
_ANSWER = "block string, `order` int, part int, totals binary"


def _request_rows(block: str, b: _Block, orders: list[int], min_count: int, n: int) -> Iterator[pa.RecordBatch]:
    for order in orders:
        _, _, hashes, own = b.request(order, min_count)
        parts, cut = _ranges(hashes, n)
        if not len(parts):
            continue
        rows = [(block, order, int(p), _squeeze(np.diff(hashes[i:j], prepend=np.uint64(0))), _squeeze(own[i:j]))
                for p, i, j in zip(parts, cut[:-1], cut[1:])]
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                         names=["block", "order", "part", "hashes", "counts"])


def _totals(requests: DataFrame) -> DataFrame:
    """Answers: the corpus counts of every requested n-gram, in the request's order."""
    def flush(key, rows) -> pa.RecordBatch:
        hashes = [np.cumsum(_unsqueeze(h), dtype=np.uint64) for _, h, _ in rows]
        flat = np.concatenate(hashes)
        own = np.concatenate([_unsqueeze(c).astype(np.int64) for *_, c in rows])
        by = np.argsort(flat, kind="stable")
        s = flat[by]
        edge = np.concatenate([[True], s[1:] != s[:-1]])
        total = np.add.reduceat(own[by], np.flatnonzero(edge))
        out = np.empty(len(flat), np.int64)
        out[by] = total[np.cumsum(edge) - 1]
        parts = np.split(out, np.cumsum([len(h) for h in hashes])[:-1])
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows]), pa.array([key[0]] * len(rows), pa.int32()),
            pa.array([key[1]] * len(rows), pa.int32()), pa.array([_squeeze(p) for p in parts], pa.binary())],
            names=["block", "order", "part", "totals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for i in range(b.num_rows):
                k = (b.column("order")[i].as_py(), b.column("part")[i].as_py())
                if k != key and rows:
                    yield flush(key, rows)
                    rows = []
                key = k
                rows.append(tuple(b.column(c)[i].as_py() for c in ("block", "hashes", "counts")))
        if rows:
            yield flush(key, rows)

    return requests.repartition("order", "part").sortWithinPartitions("order", "part").mapInArrow(run, _ANSWER)


def _with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with its answers, by order and part."""
    mine = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("order", "part", "totals"))).alias("answers"))
    return blocks.join(mine, "block", "left")


def _read_block(sizes, blob, answers, orders: range, min_count: int) -> _Block:
    """A block with its answers of some orders: all of them, or those from two words on that a longer n-gram needs."""
    b = _Block(sizes, blob)
    for k in orders:
        got = [_unsqueeze(a["totals"]).astype(np.int64) for a in answers or () if a["order"] == k]
        b.answer(k, min_count, np.concatenate(got) if got else np.zeros(0, np.int64))
    return b


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_backoffs (words whose full-length n-gram was not seen often enough), log_score, mean_log_score.

    The model is that of all rows' words ``[^\\x20\\x09-\\x0D]+`` (ASCII lower
    case); n-grams do not cross documents, and the first words of a document
    have shorter contexts.  Null and blank texts have no words, log_score 0
    and a null mean.  Ids may be null or repeated.  An empty table gives an
    empty result.
    """
    blocks = stage(_blocks(docs.select(docs[id_col].cast("long").alias("id"), text_bytes(text_col).alias("text"))), "blocks")
    size = blocks.agg(F.sum("n_words"), F.sum("n_bytes")).collect()[0]
    total, n = size[0] or 0, max(1, -(-(size[1] or 0) // RANGE_BYTES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(b.column("sizes")[i].as_py(), b.column("blob")[i].as_py())
                yield from _request_rows(b.column("block")[i].as_py(), block, list(range(1, min(order, 2) + 1)), min_count, n)

    answers = stage(_totals(blocks.mapInArrow(first, _REQUEST)), "answers")
    for k in range(3, order + 1):
        def more(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    block = _read_block(b.column("sizes")[i].as_py(), b.column("blob")[i].as_py(),
                                        b.column("answers")[i].as_py(), range(2, k), min_count)
                    yield from _request_rows(b.column("block")[i].as_py(), block, [k], min_count, n)

        asked = _with_answers(blocks, answers.where(F.col("order") > 1))
        answers = answers.unionAll(stage(_totals(asked.mapInArrow(more, _REQUEST)), "answers"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].as_py()
                x = _read_block(b.column("sizes")[i].as_py(), b.column("blob")[i].as_py(), b.column("answers")[i].as_py(),
                                range(1, order + 1), min_count)
                row = np.repeat(np.arange(len(ids)), x.per_doc)
                log = np.log(np.maximum(x.totals[0], 1)) - np.log(max(total, 1))
                backed = np.zeros(len(row), bool)
                for k in range(2, order + 1):
                    can = x.place >= k - 1
                    seen = can & (x.totals[k - 1] >= min_count)
                    context = np.concatenate([[1], x.totals[k - 2][:-1]]) if len(row) else x.totals[k - 2]
                    log = np.where(seen, np.log(np.maximum(x.totals[k - 1], 1)) - np.log(np.maximum(context, 1)),
                                   np.where(can, np.log(alpha) + log, log))
                    backed = can & ~seen
                n_words = np.bincount(row, minlength=len(ids))
                s = np.bincount(row, log, len(ids)).astype(float)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(n_words.astype(np.int64)),
                    pa.array(np.bincount(row, backed, len(ids)).astype(np.int64)), pa.array(s),
                    pa.array(s / np.maximum(n_words, 1), mask=n_words == 0)], names=names)

    names = [id_col, "n_words", "n_backoffs", "log_score", "mean_log_score"]
    return _with_answers(blocks, answers).mapInArrow(
        score, f"`{id_col}` long, n_words long, n_backoffs long, log_score double, mean_log_score double")
