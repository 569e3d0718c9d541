"""Substring dedup by line or paragraph hashing.

Units (lines, or paragraphs between blank lines) are normalised (ASCII lower
case, white space runs to one blank, ends trimmed) and hashed to 128 bits.  Of
the units with one digest, in all documents, the one with the least (rank, id,
position) stays and the others are removed.  Original code-point offsets are
kept.  A unit is a row of a few numbers in every shuffle; a digest that a third
of all documents share is pre-aggregated, and its join is split by AQE.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import one_row_per_id, stage, steps, text_bytes

MIN_WORDS = 1
SEPARATORS = {"line": rb"\n", "paragraph": rb"\n[\x20\x09-\x0D]*\n"}


def units_of(text: bytes, unit: str) -> list[tuple[int, int]]:
    """Byte ranges of the units; separators are in none."""
    out, at = [], 0
    for m in re.finditer(SEPARATORS[unit], text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def _n_chars(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace"))


def digests(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(id, rank, pos, start, end, words, h1, h2) of the units with ``min_words`` words or more; start and end in code points."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            row, pos, start, end, size, digest = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ascii_ = text.isascii()
                chars, at = 0, 0
                for k, (s, e) in enumerate(units_of(text, unit)):
                    chars += (s - at) if ascii_ else _n_chars(text[at:s])
                    raw = text[s:e]
                    width = (e - s) if ascii_ else _n_chars(raw)
                    words = raw.lower().split()
                    if len(words) >= min_words:
                        row.append(i)
                        pos.append(k)
                        start.append(chars)
                        end.append(chars + width)
                        size.append(len(words))
                        digest.append(xxh3_128_digest(b" ".join(words)))
                    chars, at = chars + width, e
            h = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(take), b.column("rank").take(take), pa.array(pos, pa.int32()),
                pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(size, pa.int64()),
                pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                names=["id", "rank", "pos", "start", "end", "words", "h1", "h2"])

    return docs.mapInArrow(run, "id long, rank double, pos int, start long, end long, words long, h1 long, h2 long")


def repeated_units(docs: DataFrame, unit: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(units, the units that occur elsewhere, with ``gone``: not the first one) of documents (id, rank, text)."""
    units = stage(digests(docs, unit, min_words), "units")
    first = units.groupBy("h1", "h2").agg(F.min(F.struct("rank", "id", "pos")).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = units.join(first.drop("c"), ["h1", "h2"]).withColumn("gone", F.expr("struct(rank, id, pos) <> first"))
    return units, again


def _cut(text: bytes, unit: str, gone: set[int]) -> bytes:
    """The text without some units; each takes the separator after it along (the last one that before it)."""
    spans = units_of(text, unit)
    kept = [k for k in range(len(spans)) if k not in gone]
    out = b""
    for j, k in enumerate(kept):
        out += text[spans[k][0]:spans[k][1]]
        if j + 1 < len(kept):
            out += text[spans[k][1]:spans[k + 1][0]]
    return out


def unit_dedup(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, rank_col: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct non-null id: id, n_units, n_removed, removed ("start:end,..."), n_repeated (units that occur elsewhere,
    the first one too), longest_repeat (words of the longest of those), kept_text, kept_sha256.

    Units with fewer than ``min_words`` words are never removed and not
    counted.  ``rank_col`` (ascending, null last) comes before the id.  Null
    text is empty.  Rows with a null id are left out; of rows that repeat an
    id, the one with the smallest text counts.
    """
    rank = F.coalesce(docs[rank_col].cast("double"), F.lit(float("inf"))) if rank_col else F.lit(0.0)
    rows = one_row_per_id(docs.select(docs[id_col].cast("long").alias("id"), rank.alias("rank"), text_bytes(text_col).alias("text"))
                          .where("id is not null"))
    units, again = repeated_units(rows, unit, min_words)
    counts = units.groupBy("id").agg(F.count("*").alias("n_units"))
    spans = again.groupBy("id").agg(
        F.count("*").alias("n_repeated"), F.max("words").alias("longest_repeat"),
        F.sort_array(F.collect_list(F.when(F.col("gone"), F.struct("pos", "start", "end")))).alias("gone"))
    joined = rows.select("id", "text").join(counts, "id", "left").join(spans, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            kept, removed = [], []
            lists = b.column("gone").to_pylist()
            for text, g in zip(b.column("text").to_pylist(), lists):
                kept.append(_cut(text, unit, {x["pos"] for x in g}) if g else text)
                removed.append(",".join(f"{x['start']}:{x['end']}" for x in g or ()))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("n_units").fill_null(0), pa.array([len(g or ()) for g in lists], pa.int64()),
                pa.array(removed, pa.string()), b.column("n_repeated").fill_null(0), b.column("longest_repeat").fill_null(0),
                pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=names)

    names = [id_col, "n_units", "n_removed", "removed", "n_repeated", "longest_repeat", "kept_text", "kept_sha256"]
    return joined.mapInArrow(run, f"`{id_col}` long, n_units long, n_removed long, removed string, n_repeated long, "
                                  "longest_repeat long, kept_text string, kept_sha256 string")
