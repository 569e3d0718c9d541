"""Bins, tiers and labels on the hand-made edge cases (FIXTURES section 6)."""

from pyspark.sql import functions as F

from basketlens.functions import scalar as S


def _one(spark, expr, values, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_order_group_outside_bins_is_null(spark):
    assert _one(spark, S.order_group, [0, 5, 6, 20, 21, 100, 101], "int") == \
        [None, "1-5", "6-10", "11-20", "20+", "20+", None]


def test_frequency_bins_left_closed_and_100_null(spark):
    assert _one(spark, S.frequency_bin, [1, 4, 5, 49, 50, 99, 100], "int") == \
        ["1-4", "1-4", "5-9", "20-49", "50+", "50+", None]


def test_hour_and_days_buckets(spark):
    assert _one(spark, S.hour_bucket, [0, 6, 7, 12, 18, 19, 23], "int") == \
        ["night", "night", "morning", "morning", "afternoon", "evening", "evening"]
    assert _one(spark, S.days_bucket, [0.0, 0.5, 7.0, 14.0, 30.0, 31.0]) == \
        ["first_order", "week", "week", "two_weeks", "month", "long_time"]


def test_tiers_journey_confidence(spark):
    assert _one(spark, S.customer_tier, [5, 6, 10, 11], "int") == \
        ["Light Users", "Medium Users", "Medium Users", "Heavy Users"]
    assert _one(spark, S.journey_stage, [1, 2, 5, 15, 16], "int") == \
        ["One-time Buyer", "New Customer", "New Customer", "Regular Customer", "Loyal Customer"]
    assert _one(spark, S.confidence_band, [0.81, 0.8, 0.61, 0.6]) == ["high", "medium", "medium", "low"]


def test_names_and_hierarchy(spark):
    from basketlens.operators.clean import enrich_products
    products = spark.createDataFrame([(1, "  Milk ", 1, 1), (2, None, 1, 9), (3, "Tea", 99, 1)],
                                     "product_id long, product_name string, aisle_id int, department_id int")
    aisles = spark.createDataFrame([(1, " fresh fruits ")], "aisle_id int, aisle string")
    depts = spark.createDataFrame([(1, "produce")], "department_id int, department string")
    got = {r["product_id"]: r for r in enrich_products(products, aisles, depts).collect()}
    assert got[1]["product_name"] == "Milk" and got[1]["product_hierarchy"] == "Produce > Fresh Fruits"
    assert got[2]["product_name"] == "Unknown Product" and got[2]["product_hierarchy"] is None
    assert got[3]["aisle"] is None   # orphan aisle id survives the left join


def test_key_hash_is_overflow_safe(spark):
    big = 9_000_000_000_000_000_000 // 4
    df = spark.createDataFrame([(7,), (big,)], "k long")
    got = [r[0] for r in df.select(S.key_hash(F.col("k"), 42)).collect()]
    assert got == [((7 + 42) * S.HASH_MULTIPLIER) % S.HASH_MODULUS,
                   ((big + 42) * S.HASH_MULTIPLIER) % S.HASH_MODULUS]


def test_dedup_keeps_first_cart_position(spark):
    from basketlens.operators.clean import dedup_items
    df = spark.createDataFrame([(1, 10, 3, 0), (1, 10, 1, 1), (1, 11, 2, 0)],
                               "order_id long, product_id long, add_to_cart_order int, reordered int")
    got = sorted(tuple(r) for r in dedup_items(df).collect())
    assert got == [(1, 10, 1, 1), (1, 11, 2, 0)]
