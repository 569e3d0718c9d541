"""Cleaning and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import scalar as S


def clean_orders(orders: DataFrame) -> DataFrame:
    """Narrow dow/hour, first-order gap -> 0, weekend flag, hour and
    gap buckets (the ETL transform)."""
    return (orders
            .withColumn("order_dow", F.col("order_dow").cast("tinyint"))
            .withColumn("order_hour_of_day", F.col("order_hour_of_day").cast("tinyint"))
            .withColumn("days_since_prior_order", F.coalesce(F.col("days_since_prior_order"), F.lit(0.0)))
            .withColumn("is_weekend", S.is_weekend(F.col("order_dow")).cast("tinyint"))
            .withColumn("hour_bucket", S.hour_bucket(F.col("order_hour_of_day")))
            .withColumn("days_bucket", S.days_bucket(F.col("days_since_prior_order"))))


def orders_calendar(orders: DataFrame) -> DataFrame:
    """Day name, peak flags, order-number group, synthetic date."""
    return (orders
            .withColumn("day_name", S.day_name(F.col("order_dow")))
            .withColumn("is_peak_hour", S.peak_hour(F.col("order_hour_of_day")))
            .withColumn("is_peak_day", S.peak_day(F.col("order_dow")))
            .withColumn("order_group", S.order_group(F.col("order_number")))
            .withColumn("order_date", S.synthetic_order_date(F.col("order_id"))))


def dedup_items(items: DataFrame, keys=("order_id", "product_id"), order_col: str = "add_to_cart_order",
                tie_cols=()) -> DataFrame:
    """Keep the first line per key by ``order_col`` (then ``tie_cols``).
    A ``min(struct)`` aggregate is partial on the map side, so a key with
    millions of copies never lands whole in one task (unlike a row_number
    window)."""
    keys = list(keys)
    rest = [c for c in items.columns if c not in keys and c != order_col and c not in tie_cols]
    best = F.min(F.struct(order_col, *tie_cols, *rest)).alias("__b")
    return items.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.{c}").alias(c)
                                                         for c in [order_col, *tie_cols, *rest]])


def cluster_items(items: DataFrame) -> DataFrame:
    """Lines sorted by (order_id, add_to_cart_order) for the staging
    write.  Range partitioning on both columns keeps an order's lines
    contiguous and in cart order across the output, and splits a very large
    order over neighbouring tasks instead of one (hash on order_id would)."""
    return (items.repartitionByRange("order_id", "add_to_cart_order")
            .sortWithinPartitions("order_id", "add_to_cart_order"))


def clean_products(products: DataFrame) -> DataFrame:
    """Trimmed product name, null -> 'Unknown Product'."""
    return products.withColumn("product_name", S.clean_name(F.col("product_name")))


def clean_names(df: DataFrame, col: str) -> DataFrame:
    """Trimmed, capitalised aisle / department names."""
    return df.withColumn(col, S.title_case(F.col(col)))


def enrich_products(products: DataFrame, aisles: DataFrame, departments: DataFrame) -> DataFrame:
    """J3 + P8: catalogue with aisle and department names and the
    'department > aisle' path.  The dimension sides are small; AQE turns the
    joins into broadcasts from their measured size, so no unchecked hint."""
    return (clean_products(products)
            .join(clean_names(aisles, "aisle"), "aisle_id", "left")
            .join(clean_names(departments, "department"), "department_id", "left")
            .withColumn("product_hierarchy", F.concat(F.col("department"), F.lit(" > "), F.col("aisle"))))
