"""Isolation forest outliers (Q17): random-split trees fitted on a bounded sample, every row scored.

The sample is a documented bound: the ``POOL`` rows of least hash of their id
(the whole table if it is smaller); each of ``TREES`` trees is grown on the
``SAMPLE`` rows of the pool of least hash of (tree, id).  A node splits a
feature drawn by hash of (tree, node) at a fraction of its range drawn
likewise, until it holds one distinct row or the depth is
log2(``SAMPLE``).  Everything follows from hashes of ids, so a forest is the
same on any cluster and in any SQL engine.

All trees grow at once: one aggregate a level gives the ranges of all open
nodes.  The finished trees are at most ``TREES`` * 2 * ``SAMPLE`` rows; they go
to the workers, which walk a batch of rows down a tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.staging import staged

TREES, SAMPLE, POOL = 50, 256, 4096
DEPTH = 8                               # log2(SAMPLE)
EULER = 0.5772156649015329


def unit(key: Column) -> Column:
    """A number from [0, 1) out of the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def unit_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among n rows: what a leaf that holds n rows adds to a path."""
    x = n.cast("double")
    return F.when(n > 2, 2 * (F.log(x - 1) + EULER) - 2 * (x - 1) / x).when(n == 2, 1.0).otherwise(0.0)


def average_path_sql(n: str) -> str:
    x = f"CAST({n} AS DOUBLE)"
    return f"(CASE WHEN {n} > 2 THEN 2 * (ln({x} - 1) + {EULER}) - 2 * ({x} - 1) / {x} WHEN {n} = 2 THEN 1.0 ELSE 0.0 END)"


def grow(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(tree, node, n, feature, threshold): all nodes of the forest; leaves have no feature.  The root is node 1, the
    children of node i are 2 i (value < threshold) and 2 i + 1.

    Null values count as 0; rows with a null key are not sampled.
    """
    id_ = F.col(key).cast("string")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(cols)),
                                                   unit(F.concat(F.lit("pool:"), id_)).alias("u"))
    pool = staged(rows.orderBy("u", "id").limit(POOL).drop("u"), "pool")
    trees = pool.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long"))))     # POOL * TREES rows
    w = Window.partitionBy("tree").orderBy("u", "id")
    open_ = staged(trees.withColumn("u", unit(F.concat_ws(":", F.col("tree"), F.col("id")))).withColumn("r", F.row_number().over(w))
                   .where(F.col("r") <= SAMPLE).withColumn("node", F.lit(1).cast("long")).drop("u", "r"), "sample")
    p, levels = len(cols), []
    for depth in range(DEPTH + 1):
        own = F.concat_ws(":", F.col("tree"), F.col("node"))
        ranges = open_.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), *(f(f"x{j}").alias(f"{s}{j}") for j in range(p) for s, f in (("lo", F.min), ("hi", F.max))))
        ranges = ranges.withColumn("f", F.floor(unit(F.concat(F.lit("feature:"), own)) * p).cast("int"))
        lo, hi = (reduce(lambda a, j: F.when(F.col("f") == j, F.col(f"{s}{j}")).otherwise(a), range(p), F.lit(None).cast("double")) for s in ("lo", "hi"))
        cut = lo + (hi - lo) * unit(F.concat(F.lit("cut:"), own))
        # a feature that does not vary here, or a cut that rounds to its least value, ends the branch
        splits = (cut > lo) & (F.lit(depth) < DEPTH)
        nodes = staged(ranges.select("tree", "node", "n", F.when(splits, F.col("f")).alias("feature"), F.when(splits, cut).alias("threshold")), "nodes")
        levels.append(nodes)
        if depth == DEPTH:
            break
        value = reduce(lambda a, j: F.when(F.col("feature") == j, F.col(f"x{j}")).otherwise(a), range(p), F.lit(None).cast("double"))
        open_ = staged(open_.join(F.broadcast(nodes.where("feature IS NOT NULL").drop("n")), ["tree", "node"])
                       .withColumn("node", 2 * F.col("node") + (value >= F.col("threshold")).cast("long")).drop("feature", "threshold"), "open")
    return reduce(DataFrame.unionByName, levels)


def isolation_scores(df: DataFrame, key: str, cols: Sequence[str], forest: DataFrame | None = None) -> DataFrame:
    """(key, mean_path, score) of every row: score 2^(-mean_path / c) nears 1 for rows that few random cuts isolate.

    Null values count as 0, rows with a null key are scored, too.
    """
    forest = forest if forest is not None else grow(df, key, cols)
    table = forest.withColumn("path", F.floor(F.log2(F.col("node").cast("double"))) + average_path(F.col("n"))).collect()   # bounded: see grow
    size = 2 ** (DEPTH + 1)
    trees = sorted({r["tree"] for r in table})
    at = {t: i for i, t in enumerate(trees)}
    feature, threshold, path = np.full((len(trees), size), -1), np.zeros((len(trees), size)), np.zeros((len(trees), size))
    for r in table:
        i, node = at[r["tree"]], r["node"]
        path[i, node] = r["path"]
        if r["feature"] is not None:
            feature[i, node], threshold[i, node] = r["feature"], r["threshold"]
    sample = max((r["n"] for r in table), default=0)
    x = float(sample)
    usual = 2 * (np.log(x - 1) + EULER) - 2 * (x - 1) / x if sample > 2 else 1.0
    shared = df.sparkSession.sparkContext.broadcast((feature, threshold, path))
    src = df.select(F.col(key).alias("__key"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(cols)))
    kind = dict(src.dtypes)["__key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, threshold, path = shared.value
        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1) if b.num_rows else np.zeros((0, len(b.columns) - 1))
            total, i = np.zeros(len(rows)), np.arange(len(rows))
            for f, t, h in zip(feature, threshold, path):
                node = np.ones(len(rows), np.int64)
                for _ in range(DEPTH):
                    split = f[node]
                    go = split >= 0
                    node = np.where(go, 2 * node + (rows[i, np.maximum(split, 0)] >= t[node]), node)
                total += h[node]
            mean = total / max(len(feature), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean), pa.array(2.0 ** (-mean / usual))], names=["__key", "mean_path", "score"])

    return src.mapInArrow(run, f"__key {kind}, mean_path double, score double").withColumnRenamed("__key", key)
