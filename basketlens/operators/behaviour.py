"""Shopping-time patterns, segments, retention and lifecycle (dashboards)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import scalar as S
from basketlens.operators.common import with_scalars
from basketlens.operators.kpi import basket_sizes, one_row
from basketlens.operators.ordered import ordered_scan
from basketlens.operators.staging import staged
from basketlens.operators.stats import exact_quantiles, mode_by


def segment_filter(orders: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """order_number within [lo, hi] (None = open)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col("order_number") >= lo)
    if hi is not None:
        cond = cond & (F.col("order_number") <= hi)
    return orders.where(cond)


def with_segments(orders: DataFrame, *cols: str) -> DataFrame:
    """(segment, cols...), a row for each of the (overlapping) segments that an order is in: one scan for all."""
    number = F.col("order_number")
    inside = [F.when((F.lit(True) if lo is None else number >= lo) & (F.lit(True) if hi is None else number <= hi), F.lit(name))
              for name, lo, hi in S.SEGMENTS]
    return orders.select(F.explode(F.array_compact(F.array(*inside))).alias("segment"), *cols)


def _every_segment(found: DataFrame, counts) -> DataFrame:
    """One row for each segment; ``counts`` of one without orders are 0."""
    names = found.sparkSession.createDataFrame([(n,) for n, *_ in S.SEGMENTS], "segment string")
    return names.join(F.broadcast(found), "segment", "left").na.fill(0, subset=list(counts))


def overview_kpis(orders: DataFrame, items: DataFrame, products: DataFrame,
                  departments: DataFrame) -> DataFrame:
    """A11 (13 KPIs).  repeat_order_pct = % orders with order_number > 1
    (the dashboard's "reorder rate", T4); retention = % users with any order
    number > 5; departments_count via the enriched catalogue (J3)."""
    sums = {"repeat": (F.col("order_number") > 1).cast("int"), "gap": F.col("days_since_prior_order"),
            "weekend": S.is_weekend(F.col("order_dow")), "peak": S.peak_hour(F.col("order_hour_of_day")).cast("int")}
    per_user = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("order_number") > S.RETENTION_ORDER_NUMBER).cast("int")).alias("ret"),
        *(f(c).alias(f"{k}_{n}") for k, c in sums.items() for n, f in (("s", F.sum), ("k", F.count))))
    mean = {k: F.sum(f"{k}_s") / F.nullif(F.sum(f"{k}_k"), F.lit(0)) for k in sums}
    bought = items.select("product_id").distinct()
    detail = (bought.join(products.select("product_id", "department_id"), "product_id", "left")
              .join(departments, "department_id", "left"))
    return one_row(
        per_user.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"), F.count("user_id").alias("active_users"),
                     (mean["repeat"] * 100).alias("repeat_order_pct"), mean["gap"].alias("avg_days_between_orders"),
                     (mean["weekend"] * 100).alias("weekend_orders_pct"), (mean["peak"] * 100).alias("peak_hours_pct"),
                     F.avg("n").alias("orders_per_user"), (F.avg("ret") * 100).alias("user_retention_rate")),
        basket_sizes(items).agg(F.coalesce(F.sum("basket_size"), F.lit(0)).alias("total_products_sold"),
                                F.avg("basket_size").alias("avg_basket_size")),
        detail.agg(F.countDistinct("product_id").alias("unique_products"),
                   F.countDistinct("department").alias("departments_count")))


def segment_sizes(orders: DataFrame) -> DataFrame:
    """Orders and users per (overlapping) segment."""
    per_user = with_segments(orders, "user_id").groupBy("segment", "user_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = per_user.groupBy("segment").agg(F.sum("n").alias("orders"), F.count("user_id").alias("users"))
    return _every_segment(sizes, ["orders", "users"])


def time_headline(orders: DataFrame) -> DataFrame:
    """A26 per segment: peak hour, peak dow (first mode), mean order number,
    active users.  One scan counts (segment, hour, dow) cells, at most 168 a
    segment; another one the users."""
    cells = with_segments(orders, "order_hour_of_day", "order_dow", "order_number").groupBy(
        "segment", "order_hour_of_day", "order_dow").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_number").alias("s"), F.count("order_number").alias("k"))
    cells = staged(cells, "segment_cells")

    def peak(col: str, out: str) -> DataFrame:
        per = cells.where(F.col(col).isNotNull()).groupBy("segment", col).agg(F.sum("n").alias("n"))
        return per.groupBy("segment").agg(F.min_by(col, F.struct((-F.col("n")).alias("n"), F.col(col).alias("v"))).alias(out))

    users = with_segments(orders, "user_id").select("segment", "user_id").distinct().groupBy("segment").agg(
        F.count("user_id").alias("active_users"))
    found = (cells.groupBy("segment").agg((F.sum("s") / F.sum("k")).alias("avg_order_number"))
             .join(peak("order_hour_of_day", "peak_hour"), "segment", "left").join(peak("order_dow", "peak_dow"), "segment", "left")
             .join(users, "segment", "left"))
    return _every_segment(found, ["active_users"])


def dow_stats(orders: DataFrame) -> DataFrame:
    """A24."""
    return (orders.groupBy("order_dow")
            .agg(F.count(F.lit(1)).alias("total_orders"), F.countDistinct("user_id").alias("unique_users"),
                 F.avg("order_number").alias("avg_order_number"))
            .withColumn("orders_per_user", F.col("total_orders") / F.col("unique_users"))
            .withColumn("day_name", S.day_name(F.col("order_dow"))))


def peak_counts(orders: DataFrame) -> DataFrame:
    """Four overlapping rows, one aggregate + ``stack``."""
    ph = S.peak_hour(F.col("order_hour_of_day"))
    pd_ = S.peak_day(F.col("order_dow"))
    agg = orders.agg(F.count_if(ph).alias("a"), F.count_if(~ph).alias("b"),
                     F.count_if(pd_).alias("c"), F.count_if(~pd_).alias("d"))
    l0, l1, l2, l3 = S.PEAK_LABELS
    return agg.selectExpr(f"stack(4, '{l0}', a, '{l1}', b, '{l2}', c, '{l3}', d) AS (category, orders)")


def order_number_distribution(orders: DataFrame) -> DataFrame:
    """A27."""
    return orders.groupBy("order_number").agg(F.count(F.lit(1)).alias("orders"))


def user_max_order(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id").agg(F.max("order_number").alias("max_order_number"))


def journey_stages(orders: DataFrame) -> DataFrame:
    """A28 + P17."""
    return (user_max_order(orders).withColumn("stage", S.journey_stage(F.col("max_order_number")))
            .groupBy("stage").agg(F.count(F.lit(1)).alias("users")))


def retention_curve(orders: DataFrame) -> DataFrame:
    """100 - cumulative % of users by their max order number.  The running
    sum is the skew-safe ordered scan over the per-number counts."""
    counts = user_max_order(orders).groupBy("max_order_number").agg(F.count(F.lit(1)).alias("users"))
    cum = ordered_scan(counts, [], ["max_order_number"], counter="__r", sums={"__cum": "users"})
    total = counts.agg(F.sum("users").alias("__t"))
    return (one_row_join(cum, total)
            .select("max_order_number", "users",
                    (F.lit(100.0) - F.col("__cum") * 100.0 / F.col("__t")).alias("retention_pct")))


def one_row_join(df: DataFrame, single: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row (scalar subqueries)."""
    return with_scalars(df, single)


def user_metrics(orders: DataFrame) -> DataFrame:
    """A29 base."""
    return orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"), F.max("order_number").alias("max_order_num"),
        F.avg("days_since_prior_order").alias("avg_days_between"))


def lifecycle_metrics(orders: DataFrame) -> DataFrame:
    """A29 + A30."""
    return user_metrics(orders).agg(
        F.avg("total_orders").alias("avg_orders"), F.avg("max_order_num").alias("avg_lifetime"),
        F.avg("avg_days_between").alias("avg_frequency"),
        (F.avg((F.col("total_orders") >= S.LOYAL_MIN_ORDERS).cast("int")) * 100).alias("loyalty_rate"),
        F.count_if(F.col("total_orders") >= S.LOYAL_MIN_ORDERS).alias("loyal_customers"))


def histogram(df: DataFrame, col: str, bins: int, by=()) -> DataFrame:
    """Fixed-width histogram with numpy's edges (last bin closed; a
    constant column uses [v-0.5, v+0.5]), optionally per group ``by`` with
    the group's own edges (one ``hist`` call per group) and a density
    column.  Every bin is returned, empty ones with 0; only the per-group
    min/max travel to the rows."""
    by = list(by)
    vals = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__x"))
    rng = vals.groupBy(*by).agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"),
                                F.count(F.lit(1)).alias("__n"))
    rng = rng.where(F.col("__n") > 0).select(*by, "__n",
                     F.when(F.col("__mn") == F.col("__mx"), F.col("__mn") - 0.5).otherwise(F.col("__mn")).alias("__lo"),
                     F.when(F.col("__mn") == F.col("__mx"), F.col("__mx") + 0.5).otherwise(F.col("__mx")).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    idx = F.least(F.floor((F.col("__x") - F.col("__lo")) * F.lit(float(bins))
                          / (F.col("__hi") - F.col("__lo"))), F.lit(bins - 1)).cast("int")
    placed = vals.join(rng, by, "inner") if by else one_row_join(vals, rng)
    counts = placed.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "__lo", "__hi", "__n")
    out = (grid.join(counts, [*by, "bin"], "left")
           .select(*by, "bin", (F.col("__lo") + F.col("bin") * width).alias("bin_start"),
                   (F.col("__lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                   F.coalesce(F.col("count"), F.lit(0)).alias("count"), "__n"))
    if by:
        out = out.withColumn("density", F.col("count") / (F.col("__n") * (F.col("bin_end") - F.col("bin_start"))))
    return out.drop("__n")


def gap_box_by_order_group(orders: DataFrame) -> DataFrame:
    """min/q1/median/q3/max of the gap per P14 order group."""
    g = (orders.where(F.col("days_since_prior_order").isNotNull())
         .withColumn("order_group", S.order_group(F.col("order_number")))
         .where(F.col("order_group").isNotNull()))
    q = exact_quantiles(g, "days_since_prior_order", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["order_group"])
    mm = g.groupBy("order_group").agg(F.min("days_since_prior_order").alias("min"),
                                      F.max("days_since_prior_order").alias("max"))
    return mm.join(q, "order_group", "inner")


def frequency_bins(orders: DataFrame) -> DataFrame:
    """A34 + P15: users per order-frequency bin (null bin kept)."""
    return (user_max_order(orders).withColumn("frequency_bin", S.frequency_bin(F.col("max_order_number")))
            .groupBy("frequency_bin").agg(F.count(F.lit(1)).alias("users")))


def user_profiles(orders: DataFrame) -> DataFrame:
    """A23 for every user: counts, mean gap, preferred dow/hour (first mode),
    reorder_ratio = orders with number > 1 / orders."""
    base = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"), F.max("order_number").alias("max_order_number"),
        F.avg("days_since_prior_order").alias("avg_days_between"),
        (F.count_if(F.col("order_number") > 1) / F.count(F.lit(1))).alias("reorder_ratio"))
    return (base.join(mode_by(orders, ["user_id"], "order_dow", "preferred_dow"), "user_id", "left")
            .join(mode_by(orders, ["user_id"], "order_hour_of_day", "preferred_hour"), "user_id", "left"))


def user_order_count(orders: DataFrame, user_id: int) -> DataFrame:
    """A37."""
    return orders.where(F.col("user_id") == user_id).agg(F.count(F.lit(1)).alias("orders"))


def dow_hour_heatmap(orders: DataFrame) -> DataFrame:
    """G1: dow x hour counts, the 24 hour columns fixed, empty cells 0."""
    return (orders.groupBy("order_dow").pivot("order_hour_of_day", list(range(24)))
            .agg(F.count(F.lit(1))).na.fill(0))


QUARTILES = {"e0": 0.0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1.0}


def quartile_label(col: str, edges, labels: list[str]):
    """Right-closed bins, the lowest one closed; equal edges raise as
    ``qcut`` does (T8)."""
    vals = [edges[k] for k in QUARTILES]
    if len(set(vals)) < len(vals):
        raise ValueError(f"quartile edges of {col} are not unique: {vals}")
    x, e = F.col(col), [F.lit(v) for v in vals]
    return (F.when((x >= e[0]) & (x <= e[1]), labels[0]).when(x <= e[2], labels[1])
            .when(x <= e[3], labels[2]).when(x <= e[4], labels[3]))


def quartile_scores(df: DataFrame, col: str, labels: list[str], out: str) -> DataFrame:
    """W8 (pandas ``qcut(q=4)``): exact quartile edges of one column."""
    return df.withColumn(out, quartile_label(col, exact_quantiles(df, col, QUARTILES).first(), labels))


def recency_frequency_scores(orders: DataFrame) -> DataFrame:
    """Per-user recency (mean gap, null -> 30) and frequency quartiles.
    The per-user table is built once; one scan gives both columns' edges."""
    um = staged(user_metrics(orders).select("user_id", "total_orders", F.coalesce(
        F.col("avg_days_between"), F.lit(S.RECENCY_FILL)).alias("avg_days_filled")), "user_metrics")
    cols = {"avg_days_filled": (S.RECENCY_LABELS, "recency_score"), "total_orders": (S.FREQUENCY_LABELS, "frequency_score")}
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    edges = {r["c"]: r for r in exact_quantiles(um.selectExpr(f"stack({len(cols)}, {pairs}) AS (c, v)"), "v", QUARTILES, ["c"]).collect()}
    if not edges:
        raise ValueError("no users to score")
    for c, (labels, out) in cols.items():
        um = um.withColumn(out, quartile_label(c, edges[c], labels))
    return um.select("user_id", "total_orders", "avg_days_filled", "recency_score", "frequency_score")


def frequency_recency_crosstab(orders: DataFrame) -> DataFrame:
    """Crosstab with margins as a cube; grouped-out levels read 'Total'."""
    scores = recency_frequency_scores(orders)
    cubed = scores.cube("frequency_score", "recency_score").agg(
        F.count(F.lit(1)).alias("users"), F.grouping("frequency_score").alias("__gf"),
        F.grouping("recency_score").alias("__gr"))
    return cubed.select(
        F.when(F.col("__gf") == 1, F.lit("Total")).otherwise(F.col("frequency_score")).alias("frequency_score"),
        F.when(F.col("__gr") == 1, F.lit("Total")).otherwise(F.col("recency_score")).alias("recency_score"),
        "users")


def eval_split_counts(orders: DataFrame) -> DataFrame:
    """P10: prior orders feed training features, train/test orders the
    evaluation side; orders and users per side."""
    side = F.when(F.col("eval_set") == "prior", "train").when(F.col("eval_set").isin("train", "test"), "test")
    return (orders.withColumn("side", side).groupBy("side")
            .agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("user_id").alias("users")))


def recency_bands(orders_raw: DataFrame) -> DataFrame:
    """Users by days since their last order (relative to the latest
    order date in the data): 0-90, 91-180, 181-365, >365."""
    last = orders_raw.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("__last"))
    latest = orders_raw.agg(F.max("o_orderdate").alias("__max"))
    days = F.datediff("__max", "__last")
    return (one_row_join(last, latest).withColumn("band", S.recency_band(days))
            .groupBy("band").agg(F.count(F.lit(1)).alias("users")))
