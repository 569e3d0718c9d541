"""User, product and user x product feature tables and training sets
(A1-A8e, P20-P23, J4-J7, J9).

``basket`` is the persisted lines-x-orders table (J1 done once); every table
here is a partial (map-side) aggregate keyed by user, product or the pair,
so a hot user or product is pre-reduced before any shuffle.  Modes use the
(key, value, count) reduction in ``stats.mode_by``; group means mapped back
to rows (J9) are a group-by plus join, not a window, so a hot department is
never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions import fixed as FX
from basketlens.operators.staging import staged
from basketlens.operators.stats import mode_by, modes_by

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def fill_numeric(df: DataFrame, value=0, cols=None) -> DataFrame:
    """Fill nulls of numeric columns only (strings keep nulls)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    ints = [f.name for f in df.schema.fields if f.name in cols and isinstance(
        f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
    fracs = [c for c in cols if c not in ints]
    out = df
    if ints:
        out = out.na.fill(int(value), subset=ints)
    if fracs:
        out = out.na.fill(float(value), subset=fracs)
    return out


def prior_basket(basket: DataFrame) -> DataFrame:
    return basket.where(F.col("eval_set") == "prior")


# --------------------------------------------------------------- src variant
def user_order_stats(orders_clean: DataFrame) -> DataFrame:
    """A1 on cleaned orders (first-order gap already 0, T3)."""
    prior = orders_clean.where(F.col("eval_set") == "prior")
    base = prior.groupBy("user_id").agg(
        F.count("order_number").alias("total_orders"), F.max("order_number").alias("max_order_number"),
        F.avg("days_since_prior_order").alias("avg_days_between_orders"),
        F.stddev_samp("days_since_prior_order").alias("std_days_between_orders"),
        F.max("days_since_prior_order").alias("max_days_between_orders"))
    return (base.join(mode_by(prior, ["user_id"], "order_dow", "favorite_dow"), "user_id", "left")
            .join(mode_by(prior, ["user_id"], "order_hour_of_day", "favorite_hour"), "user_id", "left"))


def user_basket_stats(basket: DataFrame) -> DataFrame:
    """A2 over prior lines."""
    return prior_basket(basket).groupBy("user_id").agg(
        F.countDistinct("product_id").alias("unique_products"),
        F.avg("add_to_cart_order").alias("avg_basket_position"),
        F.stddev_samp("add_to_cart_order").alias("std_basket_position"),
        F.avg("reordered").alias("reorder_ratio"),
        F.sum("reordered").cast("long").alias("total_reorders"))


def user_diversity(basket: DataFrame, products: DataFrame) -> DataFrame:
    """A3: distinct departments and aisles per user, counted on the
    (user, product) pairs so the two distinct aggregates expand the pair
    table, not the lines."""
    pairs = prior_basket(basket).select("user_id", "product_id").distinct()
    return (pairs.join(products.select("product_id", "department_id", "aisle_id"), "product_id", "inner")
            .groupBy("user_id").agg(F.countDistinct("department_id").alias("unique_departments"),
                                    F.countDistinct("aisle_id").alias("unique_aisles")))


def user_features_src(orders_clean: DataFrame, basket: DataFrame, products: DataFrame) -> DataFrame:
    """A1 + A2 + A3 (J4 left joins) + P22 + A4 derived columns."""
    out = (user_order_stats(orders_clean)
           .join(user_basket_stats(basket), "user_id", "left")
           .join(user_diversity(basket, products), "user_id", "left"))
    out = fill_numeric(out, 0)
    return (out.withColumn("avg_basket_size",
                           (F.col("total_reorders") + (F.col("unique_products") - F.col("total_reorders")))
                           / F.col("total_orders"))
            .withColumn("customer_loyalty", F.col("reorder_ratio") * F.col("total_orders")))


def product_features_src(basket: DataFrame, products_enriched: DataFrame) -> DataFrame:
    """A5 + A6 + A7: per-product stats over prior lines, kept for the whole
    catalogue (J5), numeric nulls -> 0, popularity and group popularity."""
    pb = prior_basket(basket)
    stats = pb.groupBy("product_id").agg(
        F.countDistinct("user_id").alias("unique_users"), F.count("order_id").alias("total_orders"),
        F.avg("add_to_cart_order").alias("avg_cart_position"),
        F.stddev_samp("add_to_cart_order").alias("std_cart_position"),
        F.avg("reordered").alias("reorder_probability"), F.sum("reordered").cast("long").alias("total_reorders"),
        F.count("reordered").alias("total_purchases"))
    stats = (stats.join(mode_by(pb, ["product_id"], "order_dow", "popular_dow"), "product_id", "left")
             .join(mode_by(pb, ["product_id"], "order_hour_of_day", "popular_hour"), "product_id", "left"))
    cat = products_enriched.select("product_id", "product_name", "aisle_id", "department_id", "aisle", "department")
    out = fill_numeric(cat.join(stats, "product_id", "left"), 0)
    out = out.withColumn("popularity_score", F.col("unique_users") * F.col("reorder_probability"))
    dept = out.groupBy("department_id").agg(F.avg("unique_users").alias("department_popularity"))
    aisle = out.groupBy("aisle_id").agg(F.avg("unique_users").alias("aisle_popularity"))
    return out.join(dept, "department_id", "left").join(aisle, "aisle_id", "left")


def final_dataset_src(basket: DataFrame, orders: DataFrame, user_feats: DataFrame,
                      product_feats: DataFrame) -> DataFrame:
    """A8e: the train lines (user-item rows with their order) with user
    features, a product-feature subset and the order context (J7), numeric
    nulls -> 0."""
    ui = (basket.where(F.col("eval_set") == "train")
          .select("user_id", "product_id", "order_id", "add_to_cart_order", "reordered"))
    pf = product_feats.select("product_id", "popularity_score", "reorder_probability", "avg_cart_position",
                              "department_popularity", "aisle_popularity")
    ctx = orders.select("order_id", "order_dow", "order_hour_of_day", "days_since_prior_order")
    out = (ui.join(user_feats, "user_id", "left").join(pf, "product_id", "left")
           .join(ctx, "order_id", "left"))
    return fill_numeric(out, 0)


# ----------------------------------------------------------- notebook variant
def pair_table(basket: DataFrame, next_lines: bool = False) -> DataFrame:
    """Prior lines per (user, product), staged: what the user, product and
    pair features are rolled up from, so the lines are read once for them.
    ``next_lines`` adds how many train lines the pair has (``next``)."""
    if not next_lines:
        return staged(_pair_rollup(prior_basket(basket)), "pairs")
    known = F.col("user_id").isNotNull() & F.col("product_id").isNotNull()      # as in a join, null is no key
    rows = _pair_rollup(basket.where(F.col("eval_set").isin("prior", "train")),
                        F.count(F.when((F.col("eval_set") == "train") & known, F.lit(1))).alias("next"))
    return staged(rows.where(F.col("n") > 0), "pairs")


def _pair_rollup(lines: DataFrame, *more) -> DataFrame:
    """The pair columns over the prior ones of ``lines``, and ``more`` aggregates, in one shuffle."""
    prior = F.col("eval_set") == "prior"
    of = lambda c: F.when(prior, F.col(c))
    return lines.groupBy("user_id", "product_id").agg(
        F.count(F.when(prior, F.lit(1))).alias("n"), F.sum(of("reordered")).cast("long").alias("reorders"),
        F.count(of("reordered")).alias("labelled"), F.sum(of("add_to_cart_order")).cast("long").alias("cart"),
        F.count(of("add_to_cart_order")).alias("placed"), F.max(of("order_number")).alias("last"), *more)


def user_features(orders: DataFrame, basket: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The 11 ``user_*`` features over prior orders (raw gaps: first
    orders skipped, T3), numeric nulls -> 0."""
    prior = orders.where(F.col("eval_set") == "prior")
    pairs = pair_table(basket) if pairs is None else pairs
    base = prior.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_total_orders"),
        F.avg("days_since_prior_order").alias("user_avg_days_between_orders"),
        F.min("days_since_prior_order").alias("user_min_days_between_orders"),
        F.max("days_since_prior_order").alias("user_max_days_between_orders"),
        F.stddev_samp("days_since_prior_order").alias("user_std_days_between_orders"))
    with_lines = (prior_basket(basket).select("user_id", "order_id").distinct()
                  .groupBy("user_id").agg(F.count("order_id").alias("__orders")))
    items = pairs.groupBy("user_id").agg(
        F.sum("n").alias("user_total_products"), F.count("product_id").alias("user_unique_products"),
        (F.sum("reorders") / F.nullif(F.sum("labelled"), F.lit(0))).alias("user_reorder_rate"))
    modes = modes_by(prior, ["user_id"], {"user_preferred_hour": "order_hour_of_day", "user_preferred_dow": "order_dow"})
    out = (base.join(modes, "user_id", "left").join(items, "user_id", "left").join(with_lines, "user_id", "left")
           .withColumn("user_avg_basket_size", F.col("user_total_products") / F.col("__orders")))
    return fill_numeric(out.select("user_id", *(c for c in FX.MODEL_FEATURES if c in out.columns), "user_total_orders"), 0)


def product_features(basket: DataFrame, products: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The 10 ``product_*`` features for the whole catalogue; the
    per-product user lookup is a count of pairs."""
    pairs = pair_table(basket) if pairs is None else pairs
    stats = pairs.groupBy("product_id").agg(
        F.sum("n").alias("product_total_orders"),
        (F.sum("reorders") / F.nullif(F.sum("labelled"), F.lit(0))).alias("product_reorder_rate"),
        F.sum("reorders").alias("product_reorder_count"), F.sum("labelled").alias("product_total_purchases"),
        (F.sum("cart") / F.nullif(F.sum("placed"), F.lit(0))).alias("product_avg_cart_position"),
        F.count("user_id").alias("product_unique_users"))
    modes = modes_by(prior_basket(basket), ["product_id"], {"product_preferred_hour": "order_hour_of_day", "product_preferred_dow": "order_dow"})
    out = (products.select("product_id", "aisle_id", "department_id")
           .join(stats, "product_id", "left").join(modes, "product_id", "left"))
    return fill_numeric(out, 0)


def user_product_features(orders: DataFrame, basket: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pair history over prior lines; ``up_days_since_last_purchase``
    counts orders (user max order number - last order number with it)."""
    pairs = pair_table(basket) if pairs is None else pairs
    prior = orders.where(F.col("eval_set") == "prior")
    per_user = prior.groupBy("user_id").agg(F.max("order_number").alias("user_max_order_number"),
                                            F.count(F.lit(1)).alias("user_total_orders"))
    return _pair_rates(_pair_history(pairs).join(per_user, "user_id", "inner"))


def _pair_history(pairs: DataFrame, *more) -> DataFrame:
    return pairs.select(
        "user_id", "product_id", F.col("n").alias("up_orders_count"), F.col("reorders").alias("up_reorder_count"),
        (F.col("cart") / F.nullif(F.col("placed"), F.lit(0))).alias("up_avg_cart_position"), F.col("last").alias("up_last_order_number"), *more)


def _pair_rates(hist: DataFrame) -> DataFrame:
    return (hist.withColumn("up_days_since_last_purchase", F.col("user_max_order_number") - F.col("up_last_order_number"))
            .withColumn("up_order_rate", F.col("up_orders_count") / F.col("user_total_orders"))
            .withColumn("up_reorder_rate", F.coalesce(F.col("up_reorder_count") / F.col("up_orders_count"),
                                                      F.lit(0.0))))


UP_FILLS = {"up_orders_count": 0, "up_reorder_count": 0, "up_avg_cart_position": 0.0,
            "up_last_order_number": 0, "user_max_order_number": 0, "up_days_since_last_purchase": FX.NEVER_BOUGHT_DAYS,
            "user_total_orders_y": 0, "up_order_rate": 0.0, "up_reorder_rate": 0.0}
KEYS = ["user_id", "product_id"]
LABEL = "reordered"
#: The pair columns, in table order.
UP_COLS = ["up_orders_count", "up_reorder_count", "up_avg_cart_position", "up_last_order_number", "user_max_order_number",
           "user_total_orders_y", "up_days_since_last_purchase", "up_order_rate", "up_reorder_rate"]


def training_set(orders: DataFrame, basket: DataFrame, products: DataFrame) -> DataFrame:
    """A8d: train lines (label = the line's ``reordered``) with user, product
    and pair features; the two ``user_total_orders`` copies become ``_x``
    (user table) and ``_y`` (pair table) (P23); P21 fills by name."""
    samples = basket.where(F.col("eval_set") == "train").select("user_id", "product_id", LABEL)
    pairs = pair_table(basket)
    pf = product_features(basket, products, pairs)
    users = _user_table(orders, basket, pairs).withColumn("__user", F.lit(True))
    # the pairs, the large side, are dealt out once: by pair, to the lines
    hist = _pair_history(pairs).withColumn("__hist", F.lit(True))
    out = _pair_rates(samples.join(hist, KEYS, "left").join(users, "user_id", "left")).withColumnRenamed("user_total_orders", "user_total_orders_y")
    known = F.col("__hist") & F.col("__user")       # without both, there are no pair features
    uf_cols = [c for c in users.columns if c not in ("user_id", "user_max_order_number", "user_total_orders", "__user")]
    out = (out.select("user_id", "product_id", LABEL, *uf_cols, *(F.when(known, F.col(c)).alias(c) for c in UP_COLS))
           .join(pf, "product_id", "left"))
    out = out.select(*KEYS, LABEL, *uf_cols, *(c for c in pf.columns if c != "product_id"), *UP_COLS)
    out = out.na.fill({k: v for k, v in UP_FILLS.items()})
    return fill_numeric(out, 0)


def _user_table(orders: DataFrame, basket: DataFrame, pairs: DataFrame) -> DataFrame:
    """All that the pair rows need of a user: the ``user_*`` features, the two copies of the order count, the last order."""
    last = (orders.where(F.col("eval_set") == "prior").groupBy("user_id")
            .agg(F.max("order_number").alias("user_max_order_number")))
    uf = user_features(orders, basket, pairs)
    return (uf.withColumnRenamed("user_total_orders", "user_total_orders_x")
            .join(last.join(uf.select("user_id", "user_total_orders"), "user_id", "inner"), "user_id", "inner"))


def _with_features(hist: DataFrame, users: DataFrame, pf: DataFrame) -> DataFrame:
    """Pair histories with the 30 features, nulls -> 0.  The pair rows are the large side: they are dealt out twice only,
    by user while they are narrow, then by product."""
    rows = _pair_rates(hist.join(users, "user_id", "inner")).withColumnRenamed("user_total_orders", "user_total_orders_y")
    first = ["product_id", "user_id", *UP_COLS, *(c for c in (LABEL,) if c in rows.columns)]
    return fill_numeric(rows.select(*first, *(c for c in rows.columns if c not in first)).join(pf, "product_id", "left"), 0)


def candidate_set(orders: DataFrame, basket: DataFrame, products: DataFrame) -> DataFrame:
    """Scoring candidates: every prior (user, product) pair of every user,
    with the 30 features and no label."""
    pairs = pair_table(basket)
    return _with_features(_pair_history(pairs), _user_table(orders, basket, pairs), product_features(basket, products, pairs))


def candidate_training_set(orders: DataFrame, basket: DataFrame, products: DataFrame) -> DataFrame:
    """Leakage-free variant (our default for models): every prior (user,
    product) pair of a user who has a train order; label 1 when the product
    is in that next order (a pair is a row for each such line).  Same 30
    features as ``training_set``."""
    train_users = basket.where(F.col("eval_set") == "train").select("user_id").distinct()
    pairs = pair_table(basket, next_lines=True)
    per_line = pairs.where(F.col("next") > 1).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("next").cast("int")))).drop("__i")
    label = (F.col("next") > 0).cast("int")
    hist = _pair_history(pairs.where(F.col("next") <= 1).unionByName(per_line), label.alias(LABEL))
    users = _user_table(orders, basket, pairs).join(train_users, "user_id", "left_semi")  # J11
    return _with_features(hist, users, product_features(basket, products, pairs))


def dataset_cardinality(df: DataFrame) -> DataFrame:
    """Q14: users, products, rows, positive rate."""
    return df.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("product_id").alias("products"),
                  F.count(F.lit(1)).alias("rows"), F.avg(LABEL).alias("positive_rate"))
