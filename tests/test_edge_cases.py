"""Hand-made edge cases (FIXTURES section 6) through the operators."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import behaviour as B
from basketlens.operators import features as FT
from basketlens.operators import models as M
from basketlens.operators import quality as Q

ORDERS = "order_id long, user_id long, eval_set string, order_number int, order_dow int, " \
         "order_hour_of_day int, days_since_prior_order double"
BASKET = "order_id long, product_id long, add_to_cart_order int, reordered int, eval_set string, user_id long, " \
         "order_number int, order_dow int, order_hour_of_day int, days_since_prior_order double"


@pytest.fixture(scope="module")
def tiny(spark):
    orders = spark.createDataFrame([
        (1, 10, "prior", 1, 0, 9, None),          # user 10: one prior order only
        (2, 20, "prior", 1, 1, 9, None), (3, 20, "prior", 2, 1, 10, 7.0), (4, 20, "train", 3, 2, 10, 3.0),
        (5, 30, "prior", 20, 6, 23, 30.0),        # order number 20 sits in two segments
    ], ORDERS)
    basket = spark.createDataFrame([
        (1, 100, 1, 0, "prior", 10, 1, 0, 9, None),
        (2, 100, 1, 0, "prior", 20, 1, 1, 9, None), (2, 101, 2, 0, "prior", 20, 1, 1, 9, None),
        (3, 100, 1, 1, "prior", 20, 2, 1, 10, 7.0), (4, 100, 1, 1, "train", 20, 3, 2, 10, 3.0),
    ], BASKET)
    products = spark.createDataFrame([(100, "milk", 1, 1), (101, None, 1, 2), (102, " tea ", 3, 9)],
                                     "product_id long, product_name string, aisle_id int, department_id int")
    return orders, basket, products


def test_single_order_user_gets_zero_std(tiny):
    orders, basket, _ = tiny
    uf = {r["user_id"]: r for r in FT.user_features(orders, basket).collect()}
    assert uf[10]["user_std_days_between_orders"] == 0.0
    assert uf[10]["user_avg_days_between_orders"] == 0.0
    assert uf[20]["user_total_orders"] == 2


def test_tied_modes_take_smallest_value(tiny):
    orders, basket, _ = tiny
    uf = {r["user_id"]: r for r in FT.user_features(orders, basket).collect()}
    assert uf[20]["user_preferred_hour"] == 9      # hours 9 and 10 tie once each in prior -> 9


def test_segments_overlap_at_twenty(tiny):
    orders, _, _ = tiny
    seg = {r["segment"]: r["orders"] for r in B.segment_sizes(orders).collect()}
    assert seg["Regular Users (6-20 orders)"] == 1 and seg["Heavy Users (20+ orders)"] == 1
    assert seg["All Users"] == 5


def test_orphans_are_counted(spark, tiny):
    _, basket, products = tiny
    aisles = spark.createDataFrame([(1, "a")], "aisle_id int, aisle string")
    depts = spark.createDataFrame([(1, "d"), (2, "e")], "department_id int, department string")
    items = basket.union(basket.limit(1).withColumn("product_id", F.lit(999).cast("long")))
    got = {r["check"]: r["missing"] for r in Q.fk_checks([
        ("product", items, "product_id", products, "product_id"),
        ("aisle", products, "aisle_id", aisles, "aisle_id"),
        ("department", products, "department_id", depts, "department_id")]).collect()}
    assert got == {"product": 1, "aisle": 1, "department": 1}
    assert Q.missing_count(products, "product_name").first()[0] == 1


def test_duplicate_pairs_and_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5)], "a long, b long")
    assert Q.duplicate_pairs(df, "a", "b").first()[0] == 1
    assert Q.duplicate_report("t", df).first()["duplicate_rows"] == 1


def test_constant_feature(spark):
    df = spark.createDataFrame([(1, 1, 1, 5.0, 0.1), (1, 2, 0, 5.0, 0.7), (2, 3, 1, 5.0, 0.4)],
                               "user_id long, product_id long, reordered int, c double, x double")
    corr = {r["feature"]: r["correlation"] for r in M.target_correlation(df, ["c", "x"]).collect()}
    assert corr["c"] is None and corr["x"] is not None
    params = {r["feature"]: r for r in M.scaler_params(df, ["c", "x"]).collect()}
    assert params["c"]["std"] == 1.0
