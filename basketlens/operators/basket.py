"""Declared business analytics (D1-D6), negative candidates (J13) and the
order-sequence features (W10-W13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import scalar as S
from basketlens.operators.common import with_scalars
from basketlens.operators.ordered import ordered_scan
from basketlens.operators.staging import staged


def ntiles(df: DataFrame, key: str, n: int, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    """SQL ``NTILE(n) OVER (ORDER BY col, key)`` of several columns at once
    (score -> column, descending; the key breaks ties in the same direction)
    without a single-partition window: the columns are stacked, one skew-safe
    ordered scan ranks each, then the NTILE rule (the first ``rows mod n``
    buckets get one extra row) gives the buckets, which are joined back."""
    value = lambda c, down: -F.col(c).cast("double") if down else F.col(c).cast("double")
    parts = F.array(*(F.struct(F.lit(s).alias("s"), value(c, down).alias("v"), (-F.col(key) if down else F.col(key)).alias("t"))
                      for s, (c, down) in scores.items()))
    ranked = ordered_scan(df.select(key, F.explode(parts).alias("p")).select(key, "p.*"), ["s"], ["v", "t"], counter="__rank")
    x = with_scalars(ranked, df.agg(F.count(F.lit(1)).alias("__n")))
    q = F.floor(F.col("__n") / n)
    r = F.col("__n") % n
    big = r * (q + 1)
    bucket = F.when(F.col("__rank") <= big, F.floor((F.col("__rank") - 1) / (q + 1)) + 1) \
        .otherwise(r + F.floor((F.col("__rank") - big - 1) / q) + 1).cast("int")
    wide = x.groupBy(key).agg(*(F.max(F.when(F.col("s") == s, bucket)).alias(s) for s in scores))
    return df.join(wide, key)


def rfm(orders_raw: DataFrame) -> DataFrame:
    """Recency (days from the user's last order to the latest order in
    the data), frequency (orders), monetary (sum of order totals); scores 1-5
    by quintile (5 = most recent / frequent / valuable) and a segment."""
    per = orders_raw.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_orderdate").alias("__last"), F.count(F.lit(1)).alias("frequency"),
        F.sum("o_totalprice").alias("monetary"))
    latest = orders_raw.agg(F.max("o_orderdate").alias("__max"))
    per = staged(with_scalars(per, latest)
                 .withColumn("recency", F.datediff("__max", "__last")).drop("__max", "__last"), "rfm")
    per = ntiles(per, "user_id", 5, {"r_score": ("recency", True), "f_score": ("frequency", False), "m_score": ("monetary", False)})
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    seg = (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
           .when((r <= 1) & ((f >= 4) | (m >= 4)), "Can't Lose Them")
           .when(f >= 3, "Loyal Customers")
           .when(r >= 3, "Potential Loyalists")
           .otherwise("At Risk"))
    return per.withColumn("segment", seg)


def rfm_segments(rfm_table: DataFrame) -> DataFrame:
    """D1 summary: users and revenue share per segment."""
    per = rfm_table.groupBy("segment").agg(F.count(F.lit(1)).alias("users"), F.sum("monetary").alias("revenue"))
    tot = per.agg(F.sum("users").alias("__u"), F.sum("revenue").alias("__r"))
    return (with_scalars(per, tot)
            .select("segment", "users", "revenue", S.safe_div(F.col("users") * 100.0, F.col("__u")).alias("user_pct"),
                    S.safe_div(F.col("revenue") * 100.0, F.col("__r")).alias("revenue_pct")))


def pair_rules(transactions: DataFrame, item: str, min_support: float, min_confidence: float) -> DataFrame:
    """Pair rules a -> b with support, confidence, lift.

    Apriori pruning makes it exact and bounded: a pair can only be frequent
    if both items are, and at most (mean basket size / min_support) items
    reach ``min_support``.  The order self-join therefore sees only frequent
    items - a bounded number of rows per order, however large the order -
    instead of all pairs of the basket."""
    tx = transactions.select("order_id", item).distinct()
    n = tx.agg(F.countDistinct("order_id").alias("__n"))
    sup = (with_scalars(tx.groupBy(item).agg(F.count(F.lit(1)).alias("__cnt")), n)
           .withColumn("support", F.col("__cnt") / F.col("__n")))
    freq = sup.where(F.col("support") >= min_support).select(item, "support")
    ftx = tx.join(freq.select(item), item, "left_semi")
    a = ftx.select("order_id", F.col(item).alias("a"))
    b = ftx.select("order_id", F.col(item).alias("b"))
    both = a.join(b, "order_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("__both"))
    pairs = both.select(F.explode(F.array(       # counted in one direction, mirrored after the aggregate
        F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent")),
        F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent")))).alias("p"), "__both").select("p.*", "__both")
    pairs = (with_scalars(pairs, n)
             .withColumn("support", F.col("__both") / F.col("__n"))
             .where(F.col("support") >= min_support))
    fa = freq.select(F.col(item).alias("antecedent"), F.col("support").alias("__sa"))
    fb = freq.select(F.col(item).alias("consequent"), F.col("support").alias("__sb"))
    rules = (pairs.join(fa, "antecedent").join(fb, "consequent")
             .withColumn("confidence", F.col("support") / F.col("__sa"))
             .withColumn("lift", F.col("confidence") / F.col("__sb")))
    return (rules.where(F.col("confidence") >= min_confidence)
            .select("antecedent", "consequent", F.col("__both").alias("orders"), "support", "confidence", "lift"))


def category_copurchase(user_categories: DataFrame, category: str) -> DataFrame:
    """D3: share of buyers of category A who also bought B, for any number of
    categories.  Each user's distinct categories meet in one direction (a < b)
    and the counts are mirrored, so a user adds at most half the square of the
    categories that they bought."""
    uc = user_categories.select("user_id", F.col(category).alias("c")).distinct()
    buyers = uc.groupBy("c").agg(F.count(F.lit(1)).alias("buyers_a"))
    pairs = (uc.withColumnRenamed("c", "a").join(uc.withColumnRenamed("c", "b"), "user_id").where("a < b")
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("category_a"), F.col("b").alias("category_b"), F.col("n").alias("buyers_both")),
        F.struct(F.col("b").alias("category_a"), F.col("a").alias("category_b"), F.col("n").alias("buyers_both")))).alias("p")).select("p.*")
    return (both.join(buyers.withColumnRenamed("c", "category_a"), "category_a")
            .select("category_a", "category_b", "buyers_both", "buyers_a", (F.col("buyers_both") / F.col("buyers_a")).alias("share")))


def spend_by_country(orders_raw: DataFrame, users: DataFrame) -> DataFrame:
    """Orders and revenue per country."""
    return (orders_raw.join(users, F.col("o_custkey") == F.col("user_id"), "left")
            .groupBy("country").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue")))


def top_spenders(orders_raw: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """The n users with the highest total spend (ties by user id)."""
    spend = orders_raw.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.sum("o_totalprice").alias("total_spend"), F.count(F.lit(1)).alias("orders"))
    return spend.orderBy(F.desc("total_spend"), F.asc("user_id")).limit(n).join(users, "user_id", "left")


def spend_metrics(orders_raw: DataFrame, users: DataFrame) -> DataFrame:
    """AOV, average historic spend per user and revenue per segment."""
    per_user = orders_raw.groupBy(F.col("o_custkey").alias("user_id")).agg(F.sum("o_totalprice").alias("spend"))
    seg = (per_user.join(users, "user_id", "left").groupBy("segment")
           .agg(F.count(F.lit(1)).alias("users"), F.sum("spend").alias("revenue"), F.avg("spend").alias("avg_spend")))
    aov = orders_raw.agg(F.avg("o_totalprice").alias("aov"))
    clv = per_user.agg(F.avg("spend").alias("avg_customer_value"))
    return with_scalars(with_scalars(seg, aov), clv)


def user_time_counts(orders: DataFrame) -> DataFrame:
    """Weekend and morning order counts per user."""
    return orders.groupBy("user_id").agg(
        F.count_if(S.is_weekend(F.col("order_dow")) == 1).alias("user_weekend_orders"),
        F.count_if(S.hour_bucket(F.col("order_hour_of_day")) == "morning").alias("user_morning_orders"))


def product_time_counts(basket: DataFrame) -> DataFrame:
    """Weekend / morning lines and mean gap per product (all lines)."""
    return basket.groupBy("product_id").agg(
        F.count_if(S.is_weekend(F.col("order_dow")) == 1).alias("product_weekend_orders"),
        F.count_if(S.hour_bucket(F.col("order_hour_of_day")) == "morning").alias("product_morning_orders"),
        F.avg("days_since_prior_order").alias("product_avg_days_since_prior"))


def negative_candidates(basket: DataFrame, products: DataFrame, n: int = 20) -> DataFrame:
    """J13 over all departments that a user buys from: the n most popular
    products (prior lines, ties by product id) that the user never bought.

    Exact without user x catalogue: a user who owns m products of a department
    has at least n never-bought ones among its first n + m, or all there are.
    So each (user, department) asks for ranks 1 .. n + m, an equi-join on
    (department, rank) with rows in proportion to the history."""
    dept = products.select("product_id", "department_id").where("product_id is not null and department_id is not null")
    sold = basket.where(F.col("eval_set") == "prior").groupBy("product_id").agg(F.count(F.lit(1)).alias("__n"))
    pop = dept.join(sold, "product_id", "left").withColumn("__order", -F.coalesce(F.col("__n"), F.lit(0))).drop("__n")
    ranked = ordered_scan(pop, ["department_id"], ["__order", "product_id"], counter="__r")
    sizes = dept.groupBy("department_id").agg(F.count(F.lit(1)).alias("__size"))
    hist = basket.select("user_id", "product_id").distinct()
    owned = hist.join(dept, "product_id").groupBy("user_id", "department_id").agg(F.count(F.lit(1)).alias("__m"))
    asked = owned.join(sizes, "department_id").select(
        "user_id", "department_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("__m") + n, F.col("__size")))).alias("__r"))
    open_ = (asked.join(ranked.withColumn("__r", F.col("__r").cast("long")), ["department_id", "__r"])
             .join(hist, ["user_id", "product_id"], "left_anti"))
    w = Window.partitionBy("user_id").orderBy("__order", "product_id")
    return (open_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("user_id", "product_id", "department_id", "rank"))


def order_sequence_features(orders: DataFrame, basket: DataFrame) -> DataFrame:
    """W10 + W13: per order, the previous order's gap and basket size (lags)
    and the tenure (running sum of gaps), in one skew-safe ordered scan."""
    sizes = basket.groupBy("order_id").agg(F.count(F.lit(1)).alias("basket_size"))
    o = (orders.select("order_id", "user_id", "order_number", "days_since_prior_order")
         .join(sizes, "order_id", "left").withColumn("basket_size", F.coalesce(F.col("basket_size"), F.lit(0))))
    scanned = ordered_scan(o, ["user_id"], ["order_number"], counter="__r",
                           sums={"days_since_first_order": "days_since_prior_order"},
                           lags={"prev_gap": "days_since_prior_order", "prev_basket_size": "basket_size"})
    return scanned.drop("__r")


def user_recency(orders: DataFrame) -> DataFrame:
    """Tenure (days from first to last order), recency (gap before the
    latest order), order frequency per 30 days of tenure."""
    per = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum("days_since_prior_order"), F.lit(0.0)).alias("tenure_days"),
        F.max_by("days_since_prior_order", "order_number").alias("recency_days"))
    return per.withColumn("order_frequency", F.when(F.col("tenure_days") > 0,
                                                    (F.col("orders") - 1) * 30.0 / F.col("tenure_days")))


def product_streaks(basket: DataFrame, orders: DataFrame) -> DataFrame:
    """Per (user, product) over prior orders, the length of the run of
    consecutive orders with the product that ends at the user's latest prior
    order (0 if absent there) and the days since the last purchase
    (gaps-and-islands: order_number - position within the pair)."""
    pb = basket.where(F.col("eval_set") == "prior").select("user_id", "product_id", "order_number")
    seq = ordered_scan(pb, ["user_id", "product_id"], ["order_number"], counter="__pos")
    islands = (seq.withColumn("__island", F.col("order_number") - F.col("__pos"))
               .groupBy("user_id", "product_id", "__island")
               .agg(F.count(F.lit(1)).alias("__len"), F.max("order_number").alias("__end")))
    prior = orders.where(F.col("eval_set") == "prior")
    tenure = ordered_scan(prior.select("user_id", "order_number", "days_since_prior_order"), ["user_id"],
                          ["order_number"], counter="__r", sums={"__t": "days_since_prior_order"})
    last = tenure.groupBy("user_id").agg(F.max("order_number").alias("__max"), F.max("__t").alias("__tmax"))
    per_pair = islands.groupBy("user_id", "product_id").agg(
        F.max("__end").alias("__last"), F.max_by("__len", "__end").alias("__last_len"))
    x = (per_pair.join(last, "user_id", "inner")
         .join(tenure.select("user_id", F.col("order_number").alias("__last"), F.col("__t").alias("__tlast")),
               ["user_id", "__last"], "inner"))
    return x.select("user_id", "product_id",
                    F.when(F.col("__last") == F.col("__max"), F.col("__last_len")).otherwise(F.lit(0))
                     .cast("long").alias("streak_length"),
                    (F.col("__tmax") - F.col("__tlast")).alias("last_order_days_ago"))
