"""Business KPIs and product / department / aisle statistics (EDA)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import scalar as S
from basketlens.operators.common import side_by_side, with_scalars
from basketlens.operators.staging import staged
from basketlens.operators.stats import exact_quantiles, mode_by

def one_row(*frames: DataFrame) -> DataFrame:
    """Several single-row aggregates side by side (scalar subqueries)."""
    return side_by_side(*frames)


def all_items(prior: DataFrame, train: DataFrame) -> DataFrame:
    """Prior + train lines, duplicates kept."""
    return prior.unionByName(train)


def basket_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.count(F.lit(1)).alias("basket_size"))


def eda_kpis(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders, users, items, mean/median basket, item reorder rate,
    mean/max orders per user."""
    # one pass over the lines: orders by their size, as many rows as there are sizes
    per_order = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("size"), F.sum("reordered").alias("r"), F.count("reordered").alias("k"))
    sizes = staged(per_order.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.sum("k").alias("k")), "sizes")
    per_user = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    lines = F.sum(F.col("size") * F.col("n"))
    return one_row(
        per_user.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"), F.count("user_id").alias("total_users"),
                     F.avg("n").alias("avg_orders_per_user"), F.max("n").alias("max_orders_per_user")),
        sizes.agg(F.coalesce(lines, F.lit(0)).alias("total_items"), (F.sum("r") / F.nullif(F.sum("k"), F.lit(0))).alias("item_reorder_rate"),
                  (lines / F.sum("n")).alias("avg_basket_size")),
        exact_quantiles(sizes, "size", {"median_basket_size": 0.5}, weight="n"))


def prior_kpis(orders: DataFrame, prior: DataFrame) -> DataFrame:
    """A10: prior-only basket size, reorder rate, orders per user."""
    prior_orders = orders.where(F.col("eval_set") == "prior")
    per_user = prior_orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return one_row(
        basket_sizes(prior).agg(F.avg("basket_size").alias("avg_basket_size")),
        prior.agg(F.avg("reordered").alias("item_reorder_rate")),
        per_user.agg(F.avg("n").alias("avg_orders_per_user"), F.max("n").alias("max_orders_per_user"),
                     F.min("n").alias("min_orders_per_user")))


def basket_size_stats(items: DataFrame) -> DataFrame:
    """Min, max, q25, median, q75 of items per order (exact quantiles)."""
    sizes = basket_sizes(items)
    return one_row(
        sizes.agg(F.min("basket_size").alias("min_basket"), F.max("basket_size").alias("max_basket")),
        exact_quantiles(sizes, "basket_size", {"q25": 0.25, "median": 0.5, "q75": 0.75}))


def top_products(items: DataFrame, products: DataFrame, n: int = S.TOP_PRODUCTS) -> DataFrame:
    """A13 + J8: most purchased products, then the name lookup of the n winners."""
    counts = items.groupBy("product_id").agg(F.count(F.lit(1)).alias("purchases"))
    top = counts.orderBy(F.desc("purchases"), F.asc("product_id")).limit(n)
    return top.join(products.select("product_id", "product_name"), "product_id", "left")


def department_popularity(items: DataFrame, products: DataFrame, departments: DataFrame,
                          n: int = S.TOP_DEPARTMENTS) -> DataFrame:
    """Purchases per department (items x products), top n, with names."""
    counts = (items.join(products.select("product_id", "department_id"), "product_id", "inner")
              .groupBy("department_id").agg(F.count(F.lit(1)).alias("purchases")))
    top = counts.orderBy(F.desc("purchases"), F.asc("department_id")).limit(n)
    return top.join(departments, "department_id", "left")


def orders_by_dow(orders: DataFrame) -> DataFrame:
    """A15 + P12."""
    return (orders.groupBy("order_dow").agg(F.count(F.lit(1)).alias("orders"))
            .withColumn("day_name", S.day_name(F.col("order_dow"))))


def orders_by_hour(orders: DataFrame) -> DataFrame:
    """A16."""
    return orders.groupBy("order_hour_of_day").agg(F.count(F.lit(1)).alias("orders"))


def customer_orders(orders: DataFrame) -> DataFrame:
    """A17 base: per user count, max order number, mean gap (nulls skipped)."""
    return orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.max("order_number").alias("max_order_number"),
        F.avg("days_since_prior_order").alias("avg_days_between_orders"))


def customer_tiers(orders: DataFrame) -> DataFrame:
    """A17 + P16 + W9: tier distribution with share of customers in %."""
    per_user = customer_orders(orders).withColumn("customer_type", S.customer_tier(F.col("total_orders")))
    dist = per_user.groupBy("customer_type").agg(F.count(F.lit(1)).alias("customers"))
    total = dist.agg(F.sum("customers").alias("__t"))
    return with_scalars(dist, total).select("customer_type", "customers",
                                            (F.col("customers") * 100.0 / F.col("__t")).alias("pct"))


def gap_stats(orders: DataFrame) -> DataFrame:
    """Mean, median and first mode of the gap (first orders excluded)."""
    gaps = orders.where(F.col("days_since_prior_order").isNotNull())
    return one_row(
        gaps.agg(F.avg("days_since_prior_order").alias("mean_gap")),
        exact_quantiles(gaps, "days_since_prior_order", {"median_gap": 0.5}),
        mode_by(gaps, [], "days_since_prior_order", "mode_gap"))


def customer_reorder_table(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per user the number of lines, of reorders and the rate (rounded half-even to 3 as the reference)."""
    return (items.join(orders.select("order_id", "user_id"), "order_id", "inner").groupBy("user_id")
            .agg(F.count("reordered").alias("total_products"),
                 F.sum("reordered").cast("long").alias("reordered_products"),
                 F.bround(F.avg("reordered"), S.RATE_DECIMALS).alias("reorder_rate")))


def customer_reorder_stats(orders: DataFrame, items: DataFrame) -> DataFrame:
    """A19 headline: mean of the users' reorder rates and counts above 0.8 / below 0.3."""
    rate = F.col("reorder_rate")
    return customer_reorder_table(orders, items).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(rate).alias("avg_reorder_rate"),
        F.count_if(rate > S.HIGH_REORDER_RATE).alias("customers_high"),
        F.count_if(rate < S.LOW_REORDER_RATE).alias("customers_low"))


def product_stats(items: DataFrame, products: DataFrame) -> DataFrame:
    """Per ordered product counts and reorder rate + catalogue fields."""
    agg = items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count("reordered").alias("total_products"),
        F.sum("reordered").cast("long").alias("reordered_count"),
        F.avg("reordered").alias("reorder_rate"))
    return agg.join(products.select("product_id", "product_name", "aisle_id", "department_id"),
                    "product_id", "left")


def _group_stats(pstats: DataFrame, key: str, names: DataFrame, total_col: str) -> DataFrame:
    agg = pstats.groupBy(key).agg(
        F.sum("total_orders").cast("long").alias(total_col),
        F.avg("total_orders").alias("avg_orders_per_product"),
        F.avg("reorder_rate").alias("avg_reorder_rate"),
        F.count("product_id").alias("product_count"))
    return agg.join(names, key, "left")


def department_stats(pstats: DataFrame, departments: DataFrame) -> DataFrame:
    """Two-level aggregate over A20."""
    return _group_stats(pstats, "department_id", departments, "total_dept_orders")


def aisle_stats(pstats: DataFrame, aisles: DataFrame) -> DataFrame:
    """A22."""
    return _group_stats(pstats, "aisle_id", aisles, "total_aisle_orders")


def top_by_orders(pstats: DataFrame, n: int = S.TOP_PRODUCTS) -> DataFrame:
    """Nlargest total_orders (ties: product id)."""
    return pstats.orderBy(F.desc("total_orders"), F.asc("product_id")).limit(n)


def top_reorder_rate(pstats: DataFrame, min_orders: int = S.MIN_ORDERS_FOR_RATE,
                     n: int = S.TOP_PRODUCTS) -> DataFrame:
    """HAVING total_orders >= min_orders, nlargest reorder_rate."""
    return (pstats.where(F.col("total_orders") >= min_orders)
            .orderBy(F.desc("reorder_rate"), F.asc("product_id")).limit(n))
