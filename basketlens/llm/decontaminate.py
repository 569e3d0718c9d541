"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds the word sequences of all benchmark items.  Each document
is streamed through it word by word; at each word the state and the length of
the longest suffix that occurs in an item are known.  Where that length
reaches the window, the last ``window`` words are hit; an item shorter than
the window is hit where it occurs as a whole.

The automaton is sent to the tasks.  Its size is bounded: the items are cut
into groups of at most ``group_words`` words (by a running total over hashed
blocks); each group has an automaton and a pass of its own.  Documents are
never shuffled.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from basketlens.llm.common import held, run_list, stage, steps, text_bytes

WINDOW = 10
#: Words of benchmark items in one automaton (about 400 bytes a word in a task).
GROUP_WORDS = 200_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")     # of ASCII-lowered UTF-8: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Automaton:
    """Suffix automaton of several word sequences; states know which items hold a window of theirs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.items: dict[int, set] = {}
        ends = []
        for item, words in items:
            state = 0
            for w in words:
                state = self._extend(state, w)
            if words and len(words) < window:
                ends.append((item, words))
        for item, words in ends:
            self.short.setdefault(self._walk(words), []).append((len(words), item))
        for item, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                at = state
                while self.len[at] >= window and item not in self.items.setdefault(at, set()):
                    self.items[at].add(item)
                    at = self.link[at]
        # nearest state on the chain of suffix links (itself included) that ends a short item
        self.marked = [-1] * len(self.len)
        for at in sorted(range(len(self.len)), key=self.len.__getitem__):
            up = self.link[at]
            self.marked[at] = at if at in self.short else (self.marked[up] if up >= 0 else -1)

    def _walk(self, words: list[bytes]) -> int:
        at = 0
        for w in words:
            at = self.next[at][w]
        return at

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """State of exactly len(p) + 1 words for the transition p -w-> q."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._copy(q, self.len[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Flags of the hit words, items with an occurring window."""
        nxt, link, size, marked, window = self.next, self.link, self.len, self.marked, self.window
        root = nxt[0]
        hit, items, state, length = None, set(), 0, 0
        for i, w in enumerate(words):
            step = nxt[state].get(w)
            if step is None:
                if not state:
                    continue
                while step is None and state > 0:
                    state = link[state]
                    step = nxt[state].get(w)
                if step is None:
                    length = 0
                    continue
                length = size[state]
            state, length = step, length + 1
            if length >= window:
                at = state
                while size[link[at]] >= window:
                    at = link[at]
                hit = np.zeros(len(words), bool) if hit is None else hit
                hit[i + 1 - window:i + 1] = True
                items |= self.items[at]
            at = marked[state]
            while at >= 0:
                for n, item in self.short[at]:
                    if n <= length:
                        hit = np.zeros(len(words), bool) if hit is None else hit
                        hit[i + 1 - n:i + 1] = True
                        items.add(item)
                at = link[at]
                at = marked[at] if at >= 0 else -1
        return (np.zeros(len(words), bool) if hit is None else hit), items


def groups(benchmark: DataFrame, id_col: str, text_col: str, group_words: int) -> list[DataFrame]:
    """The items with words, cut into groups of at most ``group_words`` words (or one longer item)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), text_bytes(text_col).alias("text")).where(
        "item is not null")
    size = F.length("text") / 2 + 1        # words are at most that many
    blocks = items.select(F.pmod(F.xxhash64("item"), F.lit(4096)).alias("block"), size.alias("n")).groupBy("block").agg(
        F.sum("n").alias("n")).orderBy("block").collect()      # at most 4096 rows
    total, of, group = 0, {}, 0
    for b in blocks:
        if total and total + b["n"] > group_words * 3:         # a word has three bytes at least, on average, with its gap
            total, group = 0, group + 1
        total += b["n"]
        of[b["block"]] = group
    out = []
    for g in range(group + 1 if of else 0):
        ids = [k for k, v in of.items() if v == g]
        out.append(items.where(F.pmod(F.xxhash64("item"), F.lit(4096)).isin(ids)))
    return out


def _built(key: str, shared, window: int) -> Automaton:
    """The automaton of the group that a worker works on."""
    return held(("automaton", key), lambda: Automaton(shared.value, window))


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _tag(docs: DataFrame, benchmark: DataFrame, window: int, group_words: int, text_col: str, item_col: str) -> DataFrame:
    """``docs`` as columns c0, c1, ... with the text's bytes, its runs of hit words and its items.

    One pass for each group of items; between passes the rows are staged, so
    that a task never holds two automata.
    """
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = out.withColumns({"__text": text_bytes(f"c{docs.columns.index(text_col)}"),
                           "__hits": F.expr("cast(array() as array<struct<start:int,end:int>>)"),
                           "__items": F.expr("cast(array() as array<string>)")})
    schema = StructType([StructField(f.name, f.dataType, True) for f in out.schema.fields])
    parts = groups(benchmark, item_col, "text", group_words)
    for k, part in enumerate(parts):
        rows = part.collect()               # one group: at most group_words words or one item
        items: dict[str, list[list[bytes]]] = {}
        for r in rows:
            items.setdefault(r["item"], []).append(words_of(bytes(r["text"])))
        shared = docs.sparkSession.sparkContext.broadcast([(i, w) for i, ws in sorted(items.items()) for w in ws if w])
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            automaton = _built(key, shared, window)
            for b in steps(batches, "__text"):
                hits, found = [], []
                for text, old_hits, old_items in zip(*(b.column(c).to_pylist() for c in ("__text", "__hits", "__items"))):
                    flags, items = automaton.match(words_of(text))
                    for r in old_hits:
                        flags[r["start"]:r["end"]] = True
                    hits.append([{"start": int(x), "end": int(y)} for x, y in run_list(flags)])
                    found.append(sorted(items.union(old_items)))
                cols = [*b.columns[:-2], pa.array(hits, _RUNS), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        out = out.mapInArrow(run, schema)
        if k + 1 < len(parts):
            out = stage(out, "decontaminate")
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_words: int = GROUP_WORDS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items.

    Null text has no words.  Items with null ids or without words are left
    out; an item id that repeats counts once.  Ids of documents may be null or
    repeated: each row is judged by itself.  An empty benchmark hits nothing.
    """
    tagged = _tag(docs.select(id_col, text_col), benchmark, window, group_words, text_col, item_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column("__items").to_pylist()
            n_hit = [sum(r["end"] - r["start"] for r in x) for x in b.column("__hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("c0"), pa.array([len(words_of(t)) for t in b.column("__text").to_pylist()], pa.int64()),
                pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                pa.array([n > 0 for n in n_hit], pa.bool_()), b.column("__hits"), b.column("__items")], names=out)

    out = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"]
    return tagged.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, n_hit long, n_items long, "
                                  "items_sha256 string, contaminated boolean, hits array<struct<start:int,end:int>>, "
                                  "items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5,
                  group_words: int = GROUP_WORDS, text_col: str = "text", item_col: str = "item_id",
                  length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the spans that items cover; a document of which they cover more than
    ``max_coverage`` of the words goes altogether.

    A span reaches from the first to the last hit word of a run and is
    replaced by one blank.  Documents without a hit are unchanged (null text
    stays null); ``length_col`` follows the text.
    """
    names, types = docs.columns, [f.dataType for f in docs.schema.fields]
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None
    tagged = _tag(docs, benchmark, window, group_words, text_col, item_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hits = b.column("__hits").to_pylist()
            new, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
            length = b.column(length_at).to_pylist() if length_at is not None else None
            for i, (raw, runs) in enumerate(zip(b.column("__text").to_pylist(), hits)):
                if not runs:
                    continue
                where = [m.span() for m in _WORD.finditer(raw.lower())]
                keep[i] = sum(r["end"] - r["start"] for r in runs) <= max_coverage * len(where)
                out, done = [], 0
                for r in runs:
                    out += [raw[done:where[r["start"]][0]], b" "]
                    done = where[r["end"] - 1][1]
                new[i] = (b"".join(out) + raw[done:]).decode("utf-8", "replace")
                if length is not None:
                    length[i] = len(new[i])
            cols = list(b.columns[:len(names)])
            cols[at] = pa.array(new, cols[at].type)
            if length is not None:
                cols[length_at] = pa.array(length, cols[length_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(names))]).filter(pa.array(keep))

    return tagged.mapInArrow(run, StructType([StructField(f"c{i}", t, True) for i, t in enumerate(types)])).toDF(*names)
