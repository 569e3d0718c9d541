"""Token ids in ORC: stripes with run-length encoded integers, row indexes and Bloom filters on the document id.

Documents are range-partitioned by id *before* they are encoded (text is
smaller than ids), sorted inside the partition and encoded while they are
written, so files, stripes and row groups hold ascending, disjoint id ranges.
A lookup by id reads footers, row indexes and Bloom filters and then only the
row groups that can match; a full read is split by stripe.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.bpe import default_vocabulary, encoder
from basketlens.llm.common import ragged, shared_path, steps, text_bytes

END_ID = 2
ORC_OPTIONS = {
    "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", options: dict[str, str] | None = None) -> None:
    """Encode ``docs`` and write ``doc_id, part, seq, local_start, n_tokens, ids`` as ORC below ``path``.

    ``part`` numbers the id ranges in ascending order, ``seq`` the rows of a
    part, ``local_start`` the ids of the part before the row.  Null text is
    empty (the end id only); null ids sort first; rows that repeat an id sort
    by a hash of their text.
    """
    vocab = vocabulary or default_vocabulary()
    src = docs.select(docs[id_col].alias("doc_id"), text_bytes(text_col).alias("text"))
    tie = F.xxhash64("text")
    src = src.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, start = encoder(vocab), TaskContext.get().partitionId(), 0, 0
        for b in steps(batches, "text"):
            ids, n = enc.encode(b.column("text"))
            rows = b.num_rows
            offsets = np.concatenate([[0], np.cumsum(n + 1)])
            out = np.full(offsets[-1], end_id, np.int32)
            out[ragged(offsets[:-1], n)] = ids
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(seq, seq + rows)),
                pa.array(start + offsets[:-1]), pa.array(n + 1),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))],
                names=["doc_id", "part", "seq", "local_start", "n_tokens", "ids"])
            seq, start = seq + rows, start + int(offsets[-1])

    out = src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, part int, seq long, local_start long, "
                              "n_tokens long, ids array<int>")
    out.write.options(**(options or ORC_OPTIONS)).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """The written rows; with ``ids``, only those documents (pushed down to row indexes and Bloom filters)."""
    df = spark.read.orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin(list(ids)))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    df = read_tokens(spark, path)
    totals = sorted(df.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())    # one row for each partition
    first, base = {}, 0
    for r in totals:
        first[r["part"]] = base
        base += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            part, local = b.column("part").to_pylist(), b.column("local_start").to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([first[p] + s for p, s in zip(part, local)], pa.int64()),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "part", "local_start", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a fresh folder in shared storage and return ``token_index`` of it."""
    path = shared_path(docs.sparkSession, "token_orc")
    write_tokens(docs, path, vocabulary, end_id)
    return token_index(docs.sparkSession, path)
