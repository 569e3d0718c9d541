"""Skew-safe ordered scans: per-key sequence numbers, running sums and lags.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task,
so a key that holds a third of the table (one huge customer, one huge order)
would run on one core and spill.  ``ordered_scan`` computes the same results
without that hot task:

1. ``repartitionByRange(keys + order)``: the range partitioner samples the sort
   keys, so a hot key is split over many partitions, each holding a contiguous
   slice of the global order;
2. ``sortWithinPartitions`` + ``mapInPandas``: one streaming pass per partition
   numbers rows / accumulates sums per key (vectorised numpy, carry between
   Arrow batches);
3. the scanned rows are written as a Parquet table in the shared
   ``spark.checkpoint.dir`` and read back: the partition layout (kept as a
   column) is fixed, lineage is cut, lost executors recompute nothing;
4. one partial aggregate gives, per partition, its first key and its last row
   (one row per partition: a table bounded by the partition count);
5. the carry of each partition (count/sums/last values of the key it continues)
   is derived from that small table and broadcast back - the broadcast size is
   bounded by the number of partitions, never by the data.

Why a Python pass: a JVM-only variant (``row_number`` over
``partitionBy(spark_partition_id(), key)``) would need a second full hash
shuffle, because a range layout does not satisfy that window's distribution;
the Arrow-batched pass stays inside the task that already holds the rows.

Result equals ``row_number()`` / ``sum() ... rowsBetween(unboundedPreceding,
currentRow)`` / ``lag()`` over ``partitionBy(keys).orderBy(order)`` provided
``keys + order`` is a total order (callers add a unique tie-break).  Null keys
form one group, like SQL windows.  Nulls in a summed column count as 0.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.session import ensure_checkpoint_dir

try:  # ship this module's per-partition code with the task (executors need not have the package installed)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to importing the package on workers
    pass

_PID = "__bl_pid"
_CONST = "__bl_all"


def _same_as_previous(cols) -> np.ndarray:
    """Row i has the same key tuple as row i-1 (nulls equal nulls)."""
    n = len(cols[0])
    same = np.ones(n, dtype=bool)
    for c in cols:
        if n < 2:
            break
        a, b = c.slice(1), c.slice(0, n - 1)
        if c.null_count == 0 and pa.types.is_integer(c.type):
            same[1:] &= a.to_numpy() == b.to_numpy()
        else:
            eq = pc.fill_null(pc.equal(a, b), False)
            same[1:] &= pc.or_(eq, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return same


def _keys_equal(a: tuple, b: tuple) -> bool:
    for x, y in zip(a, b):
        xn, yn = pd.isna(x), pd.isna(y)
        if xn or yn:
            if not (xn and yn):
                return False
        elif x != y:
            return False
    return True


def _local_scan(keys, counter, sums, lags):
    """Per-partition pass: numbers rows per key, running sums, lags.

    Vectorised on segment starts: a row's position is its index minus the
    index where its key's run began; integer running sums are prefix sums
    minus the prefix at the run start (exact in int64); floating sums use a
    per-run cumulative sum (no cancellation); lags are a shift masked at run
    starts.  State carries across the Arrow batches of one partition."""

    def run(batches):
        carry_key = None
        carry_n = 0
        carry_s = {o: 0 for o in sums}
        carry_l = {o: None for o in lags}
        for b in batches:
            if b.num_rows == 0:
                continue
            cols = [b.column(c) for c in keys]
            same = _same_as_previous(cols)
            same[0] = carry_key is not None and _keys_equal(tuple(c[0].as_py() for c in cols), carry_key)
            starts = ~same
            idx = np.arange(b.num_rows)
            run_start = np.maximum.accumulate(np.where(starts, idx, 0))
            cont = (run_start == 0) & bool(same[0])      # rows continuing the carried key
            number = (idx - run_start + 1 + np.where(cont, carry_n, 0)).astype("int64")
            new = [pa.array(number, pa.int64())]
            for out, src in sums.items():
                col = b.column(src)
                if pa.types.is_integer(col.type):
                    v = pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                    pre = np.cumsum(v)
                    res = pre - (pre[run_start] - v[run_start])
                else:
                    v = pc.fill_null(col.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                    res = pd.Series(v).groupby(np.cumsum(starts)).cumsum().to_numpy()
                res = res + np.where(cont, carry_s[out], 0)
                carry_s[out] = res[-1]
                new.append(pa.array(res))
            for out, src in lags.items():
                # the value of the row before, in Arrow: exact for every type
                col = b.column(src)
                before = pa.concat_arrays([pa.array([carry_l[out]], col.type), col.slice(0, len(col) - 1)])
                gone = starts.copy()
                gone[0] = not cont[0]
                new.append(pc.if_else(pa.array(gone), pa.scalar(None, col.type), before))
                carry_l[out] = col[-1].as_py()
            carry_key = tuple(c[-1].as_py() for c in cols)
            carry_n = int(number[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, counter, *sums, *lags])

    return run


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 counter: str = "seq", sums: Mapping[str, str] | None = None,
                 lags: Mapping[str, str] | None = None,
                 descending: bool = False) -> DataFrame:
    """Per-key ``row_number`` (``counter``), inclusive running ``sums`` and
    ``lags`` in ``order``; skew-safe (see module doc).

    ``keys`` may be empty: one global sequence.  ``descending=True`` orders by
    ``order`` descending (keys stay ascending).  Feed the narrowest frame you
    can: every column crosses the Arrow boundary once.
    """
    sums = dict(sums or {})
    lags = dict(lags or {})
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = list(keys)
    work = df
    if not keys:
        work = work.withColumn(_CONST, F.lit(0))
        keys_eff = [_CONST]
    else:
        keys_eff = keys
    sort_cols = [F.col(k).asc_nulls_first() for k in keys_eff] + [
        (F.col(o).desc_nulls_last() if descending else F.col(o).asc_nulls_first()) for o in order]
    ranged = (work.repartitionByRange(*sort_cols)
              .sortWithinPartitions(*sort_cols)
              .withColumn(_PID, F.spark_partition_id()))

    fields = list(ranged.schema.fields)
    by_name = {f.name: f for f in fields}
    out_fields = fields + [T.StructField(counter, T.LongType(), False)]
    for o, src in sums.items():
        t = by_name[src].dataType
        integral = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        out_fields.append(T.StructField(o, T.LongType() if integral else T.DoubleType(), True))
    for o, src in lags.items():
        out_fields.append(T.StructField(o, by_name[src].dataType, True))
    scanned = ranged.mapInArrow(_local_scan(keys_eff, counter, sums, lags), T.StructType(out_fields))
    # Fix the layout and cut lineage: a Parquet table in the shared checkpoint
    # folder (columnar and compressed, cheaper to write and re-read than an
    # RDD checkpoint of rows).
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scans/{uuid.uuid4().hex}"
    scanned.write.mode("overwrite").parquet(path)
    scanned = spark.read.schema(T.StructType(out_fields)).parquet(path)

    kstruct = F.struct(*[F.col(k) for k in keys_eff])
    last_parts = [kstruct.alias("k"), F.col(counter).alias("n")]
    last_parts += [F.col(o).alias(o) for o in sums]
    last_parts += [F.col(src).alias(o) for o, src in lags.items()]
    per_part = scanned.groupBy(_PID).agg(
        F.min(kstruct).alias("__first"),
        F.max(F.struct(*last_parts)).alias("__last"))
    # One row per non-empty partition: a window over it is bounded by the
    # partition count, not by the data.
    w_all = Window.orderBy(_PID)
    w_key = Window.partitionBy(F.col("__last.k")).orderBy(_PID).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carry = per_part.withColumn("__cum_n", F.sum("__last.n").over(w_key))
    for o in sums:
        carry = carry.withColumn(f"__cum_{o}", F.sum(f"__last.{o}").over(w_key))
    cont = F.lag("__last.k").over(w_all).eqNullSafe(F.col("__first"))
    sel = [F.col(_PID), F.col("__first"), cont.alias("__cont"),
           F.lag("__cum_n").over(w_all).alias("__off_n")]
    sel += [F.lag(f"__cum_{o}").over(w_all).alias(f"__off_{o}") for o in sums]
    sel += [F.lag(f"__last.{o}").over(w_all).alias(f"__prev_{o}") for o in lags]
    carry = carry.select(*sel).where(F.col("__cont"))

    joined = scanned.join(F.broadcast(carry), _PID, "left")
    is_cont = kstruct.eqNullSafe(F.col("__first")) & F.col("__cont")
    out = joined.withColumn(counter, F.when(is_cont, F.col(counter) + F.col("__off_n"))
                            .otherwise(F.col(counter)))
    for o in sums:
        out = out.withColumn(o, F.when(is_cont, F.col(o) + F.col(f"__off_{o}")).otherwise(F.col(o)))
    for o in lags:
        # only the partition's first row lacks its predecessor
        first_row = is_cont & (F.col(counter) == F.col("__off_n") + 1)
        out = out.withColumn(o, F.when(first_row, F.col(f"__prev_{o}")).otherwise(F.col(o)))
    drop = [_PID, "__first", "__cont", "__off_n"] + [f"__off_{o}" for o in sums] + [
        f"__prev_{o}" for o in lags]
    if not keys:
        drop.append(_CONST)
    return out.drop(*drop)
