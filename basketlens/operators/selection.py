"""Feature selection scores (M6): mutual information, chi-squared, ANOVA F; the selected columns (M5, P20).

Mutual information of a continuous feature and a discrete label is the
nearest-neighbour estimate (Ross, PLoS ONE 2014): for each row the distance d
to its k-th nearest neighbour with the same label, and the number m of rows of
any label closer than d; then psi(N) + <psi(k)> - <psi(N_label)> - <psi(m)>.
Where d is 0, k and m are the numbers of equal rows with the label and of any
label (the correction of Gao et al., NeurIPS 2017, for values that repeat).

No pair of rows is ever formed.  Rows are first counted per distinct
(feature, label, value).  Those are range-partitioned and sorted; a window of k
rows on either side, inside a partition and over copies of the k rows beyond
its ends (halo rows), finds d.  m is the difference of two running counts,
looked up by sorting the interval's ends among the values.  Values are taken
at single precision, so that distances and interval ends are exact in double
precision and ties do not depend on rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.operators.ordered import ordered_scan
from basketlens.operators.staging import drop_staged, staged

NEIGHBOURS = 3


def psi(n: Column) -> Column:
    """Digamma of a whole number from 1: ten steps of the recurrence, then the asymptotic series."""
    x = n.cast("double") + 10
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return series - reduce(Column.__add__, [1 / (n.cast("double") + j) for j in range(10)])


def psi_sql(n: str) -> str:
    """``psi`` in SQL, with the same terms in the same order."""
    x = f"(CAST({n} AS DOUBLE) + 10)"
    steps = " + ".join(f"1 / (CAST({n} AS DOUBLE) + {j})" for j in range(10))
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8) - ({steps}))"


def value_counts(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, label, value, n) over the non-null values of ``cols`` at single precision, and non-null labels."""
    pairs = ", ".join(f"'{c}', CAST(CAST(`{c}` AS FLOAT) AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"`{label}` AS label", f"stack({len(cols)}, {pairs}) AS (feature, value)")
    return (long.where("value IS NOT NULL AND label IS NOT NULL")
            .groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n")))


def with_neighbours(counts: DataFrame, keys: Sequence[str], value: str, weight: str, k: int) -> DataFrame:
    """Add ``near``: of each row the up to k rows before and after it with the same ``keys``, as structs (d, m) of
    distance and ``weight``.  Rows are distinct in keys and value.

    The k rows beyond a partition's ends are copied to it.  What the driver sees are 2 k rows a partition.
    """
    spark = counts.sparkSession
    order = [*keys, value]
    rows = staged(counts.repartitionByRange(*order).sortWithinPartitions(*order).select(
        *counts.columns, F.spark_partition_id().alias("__pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "neighbours")
    size = rows.groupBy("__pid").agg((F.max("__at") + 1).alias("__n"))
    edges = (rows.join(F.broadcast(size), "__pid").where((F.col("__at") < k) | (F.col("__at") >= F.col("__n") - k))
             .select(*counts.columns, "__pid", "__at").orderBy("__pid", "__at").collect())
    halo = []
    for pid in sorted({r["__pid"] for r in edges}):
        before = [r for r in edges if r["__pid"] < pid][-k:]
        after = [r for r in edges if r["__pid"] > pid][:k]
        halo += [(*[r[c] for c in counts.columns], pid, -1) for r in (*before, *after)]
    if halo:
        rows = rows.unionAll(spark.createDataFrame(halo, rows.schema))
    w = Window.partitionBy("__pid").orderBy(*order)
    here = F.struct(*keys)
    near = []
    for j in range(1, k + 1):
        for step in (F.lag, F.lead):
            other = step(F.struct(F.struct(*keys).alias("k"), F.col(value).alias("v"), F.col(weight).alias("m")), j).over(w)
            near.append(F.when(other["k"] == here, F.struct(F.abs(F.col(value) - other["v"]).alias("d"), other["m"].alias("m"))))
    return (rows.withColumn("near", F.array_compact(F.array(*near))).where("__at >= 0").drop("__pid", "__at"))


def kth_distance(near: Column, own: Column, k: Column) -> Column:
    """Distance of the k-th of the points in ``near``, ``own`` of which lie at distance 0."""
    points = F.array_sort(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), own.alias("m"))), near))
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("d"))
    return F.aggregate(points, start, lambda a, p: F.when(a["c"] >= k, a).otherwise(
        F.struct((a["c"] + p["m"]).alias("c"), F.when(p["m"] > 0, p["d"]).otherwise(a["d"]).alias("d"))))["d"]


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, n, mutual_information) of each column that has a value.

    Null values and labels are not counted.  Labels with one row are left out
    (a row has no neighbour then); labels with k rows or fewer use fewer
    neighbours.  A negative estimate is 0.
    """
    counts = staged(value_counts(df, cols, label), "value_counts")
    labels = counts.groupBy("feature", "label").agg(F.sum("n").alias("n_label")).where("n_label > 1")
    # as many rows as features x labels: broadcast is bounded
    rows = counts.join(F.broadcast(labels), ["feature", "label"]).withColumn("k", F.least(F.lit(k).cast("long"), F.col("n_label") - 1))
    near = with_neighbours(rows, ["feature", "label"], "value", "n", k)
    point = staged(near.withColumn("d", kth_distance(F.col("near"), F.col("n") - 1, F.col("k"))).drop("near")
                   .withColumn("k", F.when(F.col("d") > 0, F.col("k")).otherwise(F.col("n"))), "distances")
    everywhere = rows.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    # an end sorts before the values equal to it (0) or after them (2): the running count is that of smaller values, or of those up to it
    apart, none = F.col("d") > 0, F.lit(0).cast("long")
    ends = point.select("feature", "label", F.col("value").alias("own"), F.col("n").alias("of"), "k", "n_label", F.explode(F.array(
        F.struct((F.col("value") - F.col("d")).alias("value"), F.when(apart, 2).otherwise(0).alias("side"), F.lit(-1).alias("sign")),
        F.struct((F.col("value") + F.col("d")).alias("value"), F.when(apart, 0).otherwise(2).alias("side"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("feature", "label", "own", "of", "k", "n_label", F.col("e.value").alias("value"), F.col("e.side").alias("side"),
                       F.col("e.sign").alias("sign"), none.alias("n"))
    values = everywhere.withColumn("side", F.lit(1))
    scan = ordered_scan(values.unionByName(ends, allowMissingColumns=True), ["feature"], ["value", "side"], sums={"cum": "n"})
    m = (scan.where("side <> 1").groupBy("feature", "label", "own", "of", "k", "n_label")
         .agg(F.sum(F.col("sign") * F.col("cum")).alias("m")))
    total = F.sum("of")
    estimate = psi(total) + (F.sum(F.col("of") * (psi(F.col("k")) - psi(F.col("n_label")) - psi(F.col("m"))))) / total
    out = staged(m.groupBy("feature").agg(total.alias("n"), F.greatest(F.lit(0.0), estimate).alias("mutual_information")), "information")
    drop_staged(counts)
    drop_staged(point)
    return out


def _per_label(df: DataFrame, cols: Sequence[str], label: str, **stats) -> DataFrame:
    """(feature, label, n, stats...) of one aggregate over the wide table, as many rows as features x labels."""
    wide = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        *(f(F.col(c).cast("double")).alias(f"{s}_{i}") for i, c in enumerate(cols) for s, f in {"n": F.count, **stats}.items()))
    names = ["n", *stats]
    pairs = ", ".join(f"'{c}', " + ", ".join(f"`{s}_{i}`" for s in names) for i, c in enumerate(cols))
    return wide.selectExpr("label", f"stack({len(cols)}, {pairs}) AS (feature, {', '.join(names)})").where("n > 0")


def chi2_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, score): chi-squared of each feature's sums per label against the label's share of the rows.

    Null where the feature has a negative value (the sums are no counts then)
    or is 0 throughout.
    """
    per = _per_label(df, cols, label, total=F.sum, least=F.min)
    all_ = per.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum("total").alias("grand"), F.min("least").alias("least"))
    x = per.select("feature", "n", "total").join(F.broadcast(all_), "feature")
    expected = F.col("n") / F.col("rows") * F.col("grand")
    score = F.sum((F.col("total") - expected) ** 2 / F.nullif(expected, F.lit(0.0)))
    return x.groupBy("feature").agg(F.when(F.first("least") >= 0, score).alias("score"))


def f_scores(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, score): ANOVA F of each feature over the labels; null for one label, or no variance inside the labels."""
    per = _per_label(df, cols, label, mean=F.avg, var=F.var_pop)
    all_ = per.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"),
                                      (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    x = per.join(F.broadcast(all_), "feature")
    between = F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2) / F.nullif(F.first("groups") - 1, F.lit(0))
    within = F.sum(F.col("n") * F.col("var")) / F.nullif(F.first("rows") - F.first("groups"), F.lit(0))
    return x.groupBy("feature").agg((between / F.nullif(within, F.lit(0.0))).alias("score"))


def univariate_scores(df: DataFrame, cols: Sequence[str], label: str, method: str = "mutual_info") -> DataFrame:
    """(feature, score) by "mutual_info", "chi2" or "f_classif"."""
    if method == "mutual_info":
        return mutual_information(df, cols, label).select("feature", F.col("mutual_information").alias("score"))
    if method == "chi2":
        return chi2_scores(df, cols, label)
    if method == "f_classif":
        return f_scores(df, cols, label)
    raise ValueError(f"unknown selection method {method!r}")


def select_best(scores: DataFrame, k: int) -> DataFrame:
    """(feature, score, position): the k best, from position 1; ties by name, null scores last."""
    best = scores.orderBy(F.desc_nulls_last("score"), F.asc("feature")).limit(k)
    w = Window.orderBy(F.desc_nulls_last("score"), F.asc("feature"))        # k rows
    return best.select("feature", "score", F.row_number().over(w).alias("position"))


def keep_features(df: DataFrame, selected: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The table without those of ``cols`` that ``selected`` (feature) does not name; order and other columns stay."""
    names = {r["feature"] for r in selected.select("feature").collect()}       # at most one row a column
    return df.select(*(c for c in df.columns if c not in cols or c in names))
