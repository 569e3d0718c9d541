"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the instance is its
histogram: at most ``capacity`` counts, whatever the number of documents.  The
plan is computed on the histogram:

1. reduction: for the largest open length, a set of at most two documents that
   dominates every other set with it is fixed for good (nothing else fits; the
   pair fills the sequence; or the best partner is at least as long as any
   pair that could stand in its place);
2. best-fit decreasing on what remains, whole classes at a time.

The plan is a bounded list of placements "the documents ranked a .. b of
length w go to sequences s, s + 1, ... at offset o".  Ranks are dealt inside
(length, salt) cells, so no length is numbered by one task; the number of salts
grows with the pieces.  Full pieces need no rank: each is a sequence of its own.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.bpe import default_vocabulary, encoder
from basketlens.llm.common import ragged, stage, steps, text_bytes

CAPACITY, END_ID = 2048, 0
#: Salts that pieces are dealt to; rows that a (length, salt) cell has on average, at most until the salts run out.
SALTS, CELL_ROWS = 4096, 2000


@dataclass
class Plan:
    """Placements by length: (first rank, number of ranks, first sequence, offset)."""
    capacity: int
    sequences: int = 0
    fixed: int = 0                        # sequences that the reduction closed
    used: dict[int, int] = field(default_factory=dict)
    places: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.places.setdefault(length, []).append((rank, count, sequence, offset))
        self.used[length] = rank + count


def _largest(sizes: list[int], open_: dict[int, int], limit: int, but: int) -> int | None:
    """Largest open length up to ``limit``, one document of length ``but`` left aside."""
    i = bisect.bisect_right(sizes, limit)
    while i:
        i -= 1
        if open_[sizes[i]] - (sizes[i] == but) > 0:
            return sizes[i]
    return None


def _smallest_sum(sizes: list[int], open_: dict[int, int], n: int, but: int) -> float:
    """Sum of the n smallest open lengths, one document of length ``but`` left aside."""
    total = 0
    for s in sizes:
        take = min(n, open_[s] - (s == but))
        total, n = total + s * max(0, take), n - max(0, take)
        if n == 0:
            return total
    return float("inf")


def _best_pair(sizes: list[int], open_: dict[int, int], limit: int, but: int) -> int:
    """Largest sum of two open lengths up to ``limit``, one document of length ``but`` left aside; 0 if none."""
    best, j = 0, len(sizes) - 1
    for i, a in enumerate(sizes):
        if open_[a] - (a == but) <= 0:
            continue
        j = max(j, i)
        while j >= i and a + sizes[j] > limit:
            j -= 1
        for k in range(j, i - 1, -1):
            b = sizes[k]
            if open_[b] - (b == but) - (a == b) > 0:
                best = max(best, a + b)
                break
    return best


def reduce_dominated(open_: dict[int, int], plan: Plan) -> None:
    """Close the sequences of dominating sets; ``open_`` keeps what remains."""
    cap, changed = plan.capacity, True
    while changed:
        changed = False
        for w in sorted(open_, reverse=True):
            while open_.get(w, 0) > 0:
                sizes = sorted(s for s, c in open_.items() if c > 0)
                room = cap - w
                mate = _largest(sizes, open_, room, w)
                if mate is None:
                    n = open_[w]
                    plan.put(w, n, plan.sequences, 0)
                else:
                    if not (mate == room or _smallest_sum(sizes, open_, 2, w) > room
                            or _smallest_sum(sizes, open_, 3, w) > room and mate >= _best_pair(sizes, open_, room, w)):
                        break
                    n = open_[w] // 2 if mate == w else min(open_[w], open_[mate])
                    plan.put(w, n, plan.sequences, 0)
                    plan.put(mate, n, plan.sequences, w)
                    open_[mate] -= n
                open_[w] -= n
                plan.sequences += n
                plan.fixed += n
                changed = True
        for s in [s for s, c in open_.items() if c <= 0]:
            del open_[s]


def best_fit(open_: dict[int, int], plan: Plan) -> None:
    """Best-fit decreasing: each length goes where it leaves the least room, classes of equal sequences at once."""
    room: dict[int, list[tuple[int, int]]] = {}     # room left -> runs (first sequence, number)
    keys: list[int] = []                            # the same, sorted

    def give_back(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                bisect.insort(keys, left)
                room[left] = []
            room[left].append((first, n))

    for w in sorted(open_, reverse=True):
        todo = open_[w]
        while todo:
            i = bisect.bisect_left(keys, w)
            if i == len(keys):
                each = min(plan.capacity // w, todo)
                n, left, first = todo // each, plan.capacity, plan.sequences
                plan.sequences += n
            else:
                left = keys[i]
                first, have = room[left].pop()
                if not room[left]:
                    del room[left]
                    del keys[i]
                each = min(left // w, todo)
                n = min(have, todo // each)
                give_back(left, first + n, have - n)
            for k in range(each):
                plan.put(w, n, first, plan.capacity - left + k * w)
            give_back(left - each * w, first, n)
            todo -= n * each


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    open_, plan = {w: c for w, c in counts.items() if c > 0}, Plan(capacity)
    reduce_dominated(open_, plan)
    best_fit(open_, plan)
    return plan


PIECES = "piece int, start long, length long, ids_crc32 long, salt int"


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of a document's ids (with the end id): id, piece, start, length, ids_crc32, salt."""
    vocab = vocabulary or default_vocabulary()
    src = docs.select(docs[id_col].alias("__id"), text_bytes(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, salt = encoder(vocab), 0
        for b in steps(batches, "__text"):
            ids, n = enc.encode(b.column("__text"))
            end = np.cumsum(n + 1)
            out = np.full(int(end[-1]), end_id, "<u4")
            out[ragged(end - n - 1, n)] = ids
            many = -(-(n + 1) // capacity)
            row = np.repeat(np.arange(b.num_rows), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, (n + 1)[row] - start)
            at = (end - n - 1)[row] + start
            crc = [zlib.crc32(out[i:i + k].tobytes()) for i, k in zip(at.tolist(), length.tolist())]
            salts = (salt + np.arange(len(row))) % SALTS
            salt = (salt + len(row)) % SALTS
            yield pa.RecordBatch.from_arrays([
                b.column("__id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), pa.array(salts.astype(np.int32))], names=names)

    names = ["__id", *(c.split()[0] for c in PIECES.split(", "))]
    return src.mapInArrow(run, f"__id {dict(src.dtypes)['__id']}, {PIECES}").withColumnRenamed("__id", id_col)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a staged table of pieces (``length`` from 1 to capacity, ``salt``)."""
    whole, pieces = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    salts = max(64, min(SALTS, -(-pieces.count() // (capacity * CELL_ROWS))))
    pieces = pieces.withColumn("salt", F.col("salt") % salts)
    cells = pieces.groupBy("length", "salt").count().collect()      # at most capacity * salts rows, one for CELL_ROWS pieces or a length
    counts: dict[int, int] = {}
    before = np.zeros((capacity + 1, salts), np.int64)              # ranks of the length in earlier cells
    for r in sorted(cells):
        before[r["length"], r["salt"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    plan = make_plan(counts, capacity)
    rows = sorted((w, *p) for w, ps in plan.places.items() for p in ps)
    table = np.array(rows, np.int64).reshape(-1, 5)
    # places sorted by (length, first rank): one search key for both
    shared = pieces.sparkSession.sparkContext.broadcast((before, table))
    order = [c for c in pieces.columns if c not in ("length", "salt")]
    ranked = pieces.withColumn("__rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy(*order)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, table = shared.value
        first_of = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for b in batches:
            length, salt = b.column("length").to_numpy(), b.column("salt").to_numpy()
            rank = before[length, salt] + b.column("__rank").to_numpy() - 1
            at = np.zeros(len(rank), np.int64)
            for w in np.unique(length):
                mine = np.flatnonzero(length == w)
                lo, hi = first_of[w], first_of[w + 1]
                at[mine] = lo + np.searchsorted(table[lo:hi, 1], rank[mine], "right") - 1
            place = table[at]
            cols = [*b.columns[:-1], pa.array(place[:, 3] + rank - place[:, 1]), pa.array(place[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "sequence_id", "offset"])

    types = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    out = ranked.mapInArrow(run, f"{types}, sequence_id long, offset long").drop("salt")
    own = whole.drop("salt").withColumns({"sequence_id": F.monotonically_increasing_id() + plan.sequences, "offset": F.lit(0).cast("long")})
    return out.unionByName(own)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty text are the end id alone.  Ids may be null or repeated:
    each row is packed.  An empty table gives an empty result.
    """
    return pack(stage(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces"), capacity)
