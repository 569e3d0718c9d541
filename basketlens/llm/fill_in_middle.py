"""Fill-in-the-middle transformation over piece tables.

A document becomes a list of descriptors (buffer, start, length) over two
buffers that are never changed: its text and the sentinels.  Cutting splits
descriptors, an arrangement permutes them (sentinels among them), and the
inverse permutation restores the text.  Digests stream over the descriptors;
bytes are copied once, when the output is written.

The work is a map over documents: no shuffle, memory in proportion to a step
of texts (``common.STEP_BYTES``, or one longer text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketlens.llm.common import steps, text_bytes

SEED, RATE, SPM_SHARE = 42, 50, 80
SENTINELS = ("<P>", "<S>", "<M>")
TEXT, MARKS = 0, 1                              # the two buffers
#: Of each form, the parts (prefix, middle, suffix: 0, 1, 2) in output order with the sentinel before each.
ARRANGEMENTS = {"psm": ((0, 0), (1, 2), (2, 1)), "spm": ((1, 2), (0, 0), (2, 1))}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def cut(pieces: Sequence[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and from byte ``at`` of what they say; the one that holds it is split."""
    left, right = [], []
    for p in pieces:
        n = min(max(at, 0), p.length)
        if n:
            left.append(p._replace(length=n))
        if n < p.length:
            right.append(Piece(p.buffer, p.start + n, p.length - n))
        at -= p.length
    return left, right


def arrange(parts: Sequence[Sequence[Piece]], form: str, marks: Sequence[Piece]) -> list[Piece]:
    """Prefix, middle and suffix in the order of ``form``, a sentinel before each."""
    return [p for mark, part in ARRANGEMENTS[form] for p in (marks[mark], *parts[part])]


def parse(output: bytes, form: str, sentinels: Sequence[bytes]) -> list[Piece]:
    """Pieces of ``output`` in the original order: the inverse of the form's permutation."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    order = ARRANGEMENTS[form]
    first = sentinels[order[0][0]]
    if not output.startswith(first):
        raise ValueError(f"output of form {form} without its first sentinel")
    starts, ends = [len(first)], []
    for mark, _ in order[1:]:
        at = output.find(sentinels[mark], starts[-1])
        if at < 0:
            raise ValueError(f"output of form {form} without sentinel {sentinels[mark]!r}")
        ends.append(at)
        starts.append(at + len(sentinels[mark]))
    ends.append(len(output))
    inverse = np.argsort([part for _, part in order])
    return [Piece(TEXT, starts[k], ends[k] - starts[k]) for k in inverse]


def chunks(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> Iterator[memoryview]:
    for p in pieces:
        yield buffers[p.buffer][p.start:p.start + p.length]


def digest(pieces: Sequence[Piece], buffers: Sequence[memoryview]) -> str:
    h = hashlib.sha256()
    for c in chunks(pieces, buffers):
        h.update(c)
    return h.hexdigest()


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (byte positions) of all units ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` of the texts that
    lie one after the other in ``data``, and the index of each text's first end (one more at the end)."""
    space = _SPACE[data]
    flag = np.zeros(len(data), bool)
    flag[:-1] = ~space[:-1] & space[1:]                     # a word before white space
    filled = offsets[1:][np.diff(offsets) > 0]
    flag[filled - 1] = True                                 # a text's last byte ends a unit, word or white space
    ends = np.flatnonzero(flag) + 1
    return ends, np.searchsorted(ends, offsets, "right")


def draws(seed: int, id_: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document: the first 8-digit groups of the SHA-256 of "seed:id"."""
    d = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).digest()
    return tuple(int.from_bytes(d[k:k + 4], "big") for k in (0, 4, 8, 12))


def _chars(view: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(view, np.uint8) & 0xC0) != 0x80)) if len(view) else 0


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE,
                   sentinels: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars, pieces, output, output_sha256.

    ``rate`` of 100 texts are cut at two unit ends drawn from the id and ``seed``,
    ``spm_share`` of 100 of those come suffix first.  A text that is empty or
    holds a sentinel stays plain; its parts are null.  ``pieces`` are the
    descriptors of the output: buffer 0 is the text, 1 the sentinels in the order given.

    Null text is empty; a null id is drawn as an empty number.  Rows that repeat
    an id are each transformed, alike for like texts.  Other columns are not
    read.  An empty table gives an empty result.
    """
    marks_text = "".join(sentinels).encode()
    names = [s.encode() for s in sentinels]
    if any(len(s) < 2 or a != b and a in b for a in names for b in names for s in (a,)):
        raise ValueError("sentinels must have two characters or more and not hold one another")
    at = np.cumsum([0, *map(len, names)]).tolist()
    marks = [Piece(MARKS, at[k], len(names[k])) for k in range(3)]
    src = docs.select(docs[id_col].alias("__id"), text_bytes(text_col).alias("__text"))
    kind = dict(src.dtypes)["__id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark_view = memoryview(marks_text)
        for b in steps(batches, "__text"):
            col = b.column("__text").cast(pa.large_binary())
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
            raw = memoryview(col.buffers()[2] or b"")[offsets[0]:offsets[-1]]
            offsets = offsets - offsets[0]
            ends, first = unit_ends(np.frombuffer(raw, np.uint8), offsets)
            forms, prefix, middle, table, outputs, digests = [], [], [], [], [], []
            for i, id_ in enumerate(b.column("__id").to_pylist()):
                s, e, n = int(offsets[i]), int(offsets[i + 1]), int(first[i + 1] - first[i])
                views = (raw[s:e], mark_view)
                text = bytes(views[TEXT])
                h = draws(seed, id_)
                pieces = [Piece(TEXT, 0, e - s)] if e > s else []
                if not text or h[2] % 100 >= rate or any(m in text for m in names):
                    forms.append("plain")
                    prefix.append(None)
                    middle.append(None)
                else:
                    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    x, y = (int(ends[first[i] + k - 1]) - s if k else 0 for k in (lo, hi))
                    head, tail = cut(pieces, y)
                    head, mid = cut(head, x)
                    forms.append("spm" if h[3] % 100 < spm_share else "psm")
                    prefix.append(_chars(views[TEXT][:x]))
                    middle.append(_chars(views[TEXT][x:y]))
                    pieces = arrange((head, mid, tail), forms[-1], marks)
                table.append([p._asdict() for p in pieces])
                outputs.append(b"".join(chunks(pieces, views)))
                digests.append(digest(pieces, views))
            yield pa.RecordBatch.from_arrays([
                b.column("__id"), pa.array(np.diff(first), pa.int64()), pa.array(forms, pa.string()),
                pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(table, pa.list_(pa.struct([("buffer", pa.int8()), ("start", pa.int64()), ("length", pa.int64())]))),
                pa.array(outputs, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())], names=out)

    out = ["__id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
    return src.mapInArrow(run, f"__id {kind}, n long, form string, prefix_chars long, middle_chars long, "
                               "pieces array<struct<buffer: tinyint, start: bigint, length: bigint>>, output string, "
                               "output_sha256 string").withColumnRenamed("__id", id_col)


def restore(transformed: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Add ``restored`` and ``restored_sha256``, rebuilt from ``output`` and ``form`` alone.

    A null output is an empty one, a null form plain.  An output that lacks a
    sentinel of its form is an error.
    """
    names = [s.encode() for s in sentinels]
    cols = transformed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "output"):
            text, digests = [], []
            for out, form in zip(b.column("output").cast(pa.binary()).to_pylist(), b.column("form").to_pylist()):
                out = out or b""
                pieces, views = parse(out, form or "plain", names), (memoryview(out),)
                text.append(b"".join(chunks(pieces, views)))
                digests.append(digest(pieces, views))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(text, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                names=[*cols, "restored", "restored_sha256"])

    types = ", ".join(f"`{n}` {t}" for n, t in transformed.dtypes)
    return transformed.mapInArrow(run, f"{types}, restored string, restored_sha256 string")
