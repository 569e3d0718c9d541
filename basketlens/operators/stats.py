"""Exact order statistics and modes that never gather a group in one task.

Spark's ``percentile``/``mode`` aggregates keep a map of every distinct value of
a group in one buffer, and the final merge of a global aggregate runs in one
task.  Here values are first reduced to ``(group, value, count)`` with a
partial (map-side) aggregate, then ranked with the skew-safe ``ordered_scan``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.common import with_scalars
from basketlens.operators.ordered import ordered_scan


def exact_quantiles(df: DataFrame, col: str, qs: Mapping[str, float],
                    by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles (numpy / ``quantile_cont`` rule), wide.

    Returns ``by...`` plus one column per name in ``qs``.  Null values are
    ignored; a group with no values is absent.  ``weight``: a column that says
    how often a row counts.
    """
    by = list(by)
    user_by = list(by)
    if not by:  # one global group: a constant key keeps every step an equi-join
        df = df.withColumn("__g", F.lit(0))
        by = ["__g"]
    counts = (df.where(F.col(col).isNotNull())
              .groupBy(*by, col).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__c")))
    ranked = ordered_scan(counts, by, [col], counter="__r", sums={"__cum": "__c"})
    totals = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    qarr = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"))
                     for name, q in qs.items()])
    pos = (F.col("__q.q") * (F.col("__n") - 1))
    joined = (ranked.join(F.broadcast(totals), by, "inner") if user_by        # one row a group
              else with_scalars(ranked, totals.select("__n")))
    x = (joined
         .withColumn("__q", F.explode(qarr))
         .withColumn("__pos", pos)
         .withColumn("__lo", F.floor("__pos"))
         .withColumn("__hi", F.ceil("__pos"))
         .withColumn("__before", F.col("__cum") - F.col("__c")))
    has_lo = (F.col("__lo") >= F.col("__before")) & (F.col("__lo") < F.col("__cum"))
    has_hi = (F.col("__hi") >= F.col("__before")) & (F.col("__hi") < F.col("__cum"))
    picked = (x.where(has_lo | has_hi)
              .groupBy(*by, F.col("__q.name").alias("__name"))
              .agg(F.max(F.when(has_lo, F.col(col))).alias("__vlo"),
                   F.max(F.when(has_hi, F.col(col))).alias("__vhi"),
                   F.first(F.col("__pos") - F.col("__lo")).alias("__frac")))
    val = (F.col("__vlo").cast("double")
           + (F.col("__vhi").cast("double") - F.col("__vlo").cast("double")) * F.col("__frac"))
    long = picked.select(*by, "__name", val.alias("__v"))
    aggs = [F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in qs]
    return long.groupBy(*by).agg(*aggs).select(*user_by, *qs.keys())


def mode_by(df: DataFrame, by: Sequence[str], col: str, alias: str | None = None) -> DataFrame:
    """Most frequent value per group, ties -> smallest value (pandas
    ``mode().iloc[0]``).  Partial aggregate on (group, value), then one
    ``min_by`` per group: no group is ever collected."""
    by = list(by)
    counts = (df.where(F.col(col).isNotNull())
              .groupBy(*by, col).agg(F.count(F.lit(1)).alias("__c")))
    best = F.min_by(F.col(col), F.struct((-F.col("__c")).alias("nc"), F.col(col).alias("v")))
    return counts.groupBy(*by).agg(best.alias(alias or col))


def modes_by(df: DataFrame, by: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """``mode_by`` of several whole-number columns (alias -> column) in one
    pass: the columns are stacked to (which, value) rows, which are counted
    before the shuffle.  Groups without any value are absent."""
    by = list(by)
    kinds = {a: df.schema[c].dataType for a, c in cols.items()}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("w"), F.col(c).cast("long").alias("v")) for i, c in enumerate(cols.values()))))
    counts = (df.select(*by, each.alias("e")).where("e.v IS NOT NULL")
              .groupBy(*by, F.col("e.w").alias("__w"), F.col("e.v").alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    order = F.struct((-F.col("__c")).alias("nc"), F.col("__v").alias("v"))
    return counts.groupBy(*by).agg(*(
        F.min_by("__v", F.when(F.col("__w") == i, order)).cast(kinds[a]).alias(a) for i, a in enumerate(cols)))


def all_modes(df: DataFrame, col: str) -> DataFrame:
    """Every value that reaches the top frequency (pandas ``mode()``)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("__m"))
    return with_scalars(counts, top).where(F.col("n") == F.col("__m")).select(col, "n")
