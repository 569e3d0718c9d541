"""Attaching single-row aggregates without joins.

A one-row aggregate (a total, a min/max, a quantile edge) is attached as a
scalar subquery (``DataFrame.scalar()``): Spark runs it once (merging sibling
subqueries into one aggregate) and inlines the value - no join, and so no
nested-loop or cartesian plan, which an equi-join on a constant key becomes
after constant folding."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_scalars(df: DataFrame, single: DataFrame) -> DataFrame:
    """Every column of the one-row ``single`` added to every row of ``df``."""
    return df.select("*", *[single.select(c).scalar().alias(c) for c in single.columns])


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row made of several one-row aggregates."""
    out = frames[0]
    for f in frames[1:]:
        out = with_scalars(out, f)
    return out
