"""Shuffles that grow with the input, few and narrow exchanges of the pair rows."""

from pyspark.sql import Row

from basketlens import session
from basketlens.operators import features as FT
from basketlens.operators import models as M
from basketlens.sources import adapter

KEY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tables(spark):
    orders = [Row(order_id=u * 10 + n, user_id=u, eval_set="train" if n == 3 else "prior", order_number=n, order_dow=n, order_hour_of_day=u,
                  days_since_prior_order=None if n == 1 else float(n)) for u in (1, 2) for n in (1, 2, 3) if (u, n) != (2, 3)]
    bought = {11: [1, 2], 12: [1, None], 13: [1, 1, 3, None], 21: [1], 22: [2]}
    lines = [(o, p) for o, ps in bought.items() for p in ps]
    o = spark.createDataFrame(orders)
    basket = spark.createDataFrame([(x, p, 1, 0) for x, p in lines], "order_id long, product_id long, add_to_cart_order int, reordered int").join(o, "order_id")
    return o, basket, spark.createDataFrame([(p, p, 1) for p in (1, 2, 3)], "product_id long, aisle_id int, department_id int")


def test_shuffle_partitions_grow_with_the_input(spark, tmp_path):
    before, base = spark.conf.get(KEY, None), int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        (tmp_path / "orders.parquet").write_bytes(b"x" * 1000)
        assert session.stored_bytes(spark, [f"file://{tmp_path}/orders.parquet", f"file://{tmp_path}/absent"]) == 1000
        session.spread_shuffles(spark, 0)
        assert int(spark.conf.get(KEY)) >= base
        session.spread_shuffles(spark, (base + 500) * session.PARTITION_BYTES)
        assert int(spark.conf.get(KEY)) == base + 500
        session.spread_shuffles(spark, 0)
        assert int(spark.conf.get(KEY)) == base + 500
    finally:
        spark.conf.unset(KEY)
        if before:
            spark.conf.set(KEY, before)


def test_a_pair_is_a_row_per_train_line_and_null_is_no_key(spark):
    out = FT.candidate_training_set(*tables(spark))
    got = sorted(((r.user_id, r.product_id, r.reordered, r.up_orders_count) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, 0, 1), (1, 1, 1, 2), (1, 1, 1, 2), (1, 2, 0, 1)], key=str)     # a null number becomes 0
    assert out.columns[:2] == ["product_id", "user_id"] and set(M.FX.MODEL_FEATURES) | {"reordered"} == set(out.columns[2:])


def test_pairs_are_not_dealt_out_by_pair_for_candidates(spark):
    for build in (FT.candidate_training_set, FT.candidate_set):
        plan = build(*tables(spark))._jdf.queryExecution().sparkPlan().toString()
        joins = [ln for ln in plan.splitlines() if "Join [user_id" in ln]
        assert joins and not [ln for ln in joins if "product_id" in ln.split("]")[0]]


def test_a_correlation_matrix_aggregates_a_pair_once(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 2.0) for i in range(5)], "a double, b double, c double")
    out = M.correlation_matrix(df, ["a", "b", "c"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("covar_pop") == 6
    r = {(x.feature_a, x.feature_b): x.r for x in out.collect()}
    assert len(r) == 9 and r["a", "b"] == r["b", "a"] and abs(r["a", "b"] - df.corr("a", "b")) < 1e-12 and r["a", "c"] is None


def test_forests_keep_each_rows_node():
    assert M.classifier("random_forest", 3).getCacheNodeIds()


def test_lines_are_reduced_by_a_hash_aggregate_of_their_numbers(spark):
    rows = [(1, 5, 3, 7), (1, 5, 2, 9), (1, 6, 1, 1), (2, 5, None, 1), (2, 5, 1, 2), (2, None, 4, 1), (None, 5, 1, 1)]
    lines = spark.createDataFrame([(o, p, n, s, float(s), None) for o, p, n, s in rows],
                                  "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_shipdate timestamp")
    seen = []
    scan, adapter.ordered_scan = adapter.ordered_scan, lambda df, *a, **k: seen.append(df) or scan(df, *a, **k)
    try:
        got = {tuple(r) for r in adapter.derive_lines(lines).collect()}
    finally:
        adapter.ordered_scan = scan
    assert got == {(1, 6, 1), (1, 5, 2), (2, 5, 1), (2, None, 2), (None, 5, 1)}
    assert {(r["order_id"], r["product_id"]): r["l_linenumber"] for r in seen[0].collect()}[2, 5] is None     # null is the least
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
