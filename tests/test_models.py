"""Scorer contract on the 3-row fixture (FIXTURES section 2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import evaluate as E
from basketlens.operators import models as M

COLS = ["user_total_orders", "user_avg_days_between_orders", "product_total_orders", "product_reorder_rate",
        "user_product_orders", "days_since_last_order", "hour_of_day", "day_of_week", "add_to_cart_order",
        "aisle_id", "department_id"]
ROWS = [(10, 7.5, 1000, 0.3, 2, 5, 14, 1, 1, 24, 4), (15, 10.2, 500, 0.2, 1, 8, 10, 5, 2, 15, 2),
        (8, 5.1, 800, 0.4, 3, 3, 18, 2, 1, 30, 6)]
LABELS = [1, 0, 1]


@pytest.fixture(scope="module")
def fixture_df(spark):
    data = [(1, 101 + i, LABELS[i], *[float(v) for v in r]) for i, r in enumerate(ROWS)]
    schema = "user_id long, product_id long, reordered int, " + ", ".join(f"{c} double" for c in COLS)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def fitted(fixture_df):
    scaler = M.scaling_stage(M.scaler_params(fixture_df, COLS), COLS)
    return M.fit("logistic", fixture_df, COLS, scaler)


def test_scores_in_unit_interval(fixture_df, fitted):
    out = M.score(fitted, fixture_df, COLS).toPandas()
    assert len(out) == 3
    assert out["reorder_probability"].between(0, 1).all()
    assert set(out["reorder_prediction"]) <= {0, 1}


def test_top_k_recommendations(fixture_df, fitted):
    recs = E.recommend(M.as_eval(M.score(fitted, fixture_df, COLS)), 2).toPandas()
    assert list(recs.columns[:4]) == ["user_id", "product_id", "reorder_probability", "reorder_prediction"]
    assert len(recs) == 2
    assert (np.diff(recs.sort_values("rank")["reorder_probability"].to_numpy()) <= 0).all()


def test_missing_feature_is_an_error(fixture_df, fitted):
    with pytest.raises(ValueError):
        M.score(fitted, fixture_df.drop("user_total_orders"), COLS)


def test_columns_are_reordered(fixture_df, fitted):
    shuffled = fixture_df.select(*reversed(fixture_df.columns))
    a = M.score(fitted, shuffled, COLS).orderBy("product_id").toPandas()
    b = M.score(fitted, fixture_df, COLS).orderBy("product_id").toPandas()
    assert np.allclose(a["reorder_probability"], b["reorder_probability"])


def test_persist_and_missing_model(spark, fixture_df, fitted, tmp_path):
    path = str(tmp_path / "m")
    M.save(fitted, path)
    again = M.load(path)
    a = M.score(again, fixture_df, COLS).orderBy("product_id").toPandas()
    b = M.score(fitted, fixture_df, COLS).orderBy("product_id").toPandas()
    assert np.allclose(a["reorder_probability"], b["reorder_probability"])
    with pytest.raises(FileNotFoundError):
        M.load(str(tmp_path / "absent"))


def test_works_without_scaler(fixture_df):
    identity = M.scaling_stage(fixture_df.selectExpr(
        "stack(11, " + ", ".join(f"'{c}', 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0" for c in COLS)
        + ") AS (feature, mean, std, min, max, q1, median, q3)"), COLS)
    model = M.fit("logistic", fixture_df, COLS, identity)
    assert M.score(model, fixture_df, COLS).count() == 3


def test_class_weights_and_split(spark):
    df = spark.createDataFrame([(u, u % 4 == 0) for u in range(400)], "user_id long, flag boolean") \
        .withColumn("reordered", F.col("flag").cast("int"))
    w = {r["reordered"]: r["weight"] for r in M.class_weights(df).collect()}
    assert w[1] == pytest.approx(400 / (2 * 100)) and w[0] == pytest.approx(400 / (2 * 300))
    sp = M.user_split(df).groupBy("user_id").agg(F.countDistinct("split").alias("n"))
    assert sp.where("n > 1").count() == 0


def test_score_batches_keeps_arity(fixture_df, fitted):
    parts = [fixture_df.where(f"product_id = {p}") for p in (101, 102, 103)]
    out = M.score_batches(fitted, parts, COLS)
    assert [o.count() for o in out] == [1, 1, 1]


def test_recommend_for_one_user(fixture_df, fitted):
    recs = E.recommend_for_user(M.as_eval(M.score(fitted, fixture_df, COLS)), 1, 2).toPandas()
    assert set(recs["user_id"]) == {1} and len(recs) == 2
    assert E.recommend_for_user(M.as_eval(M.score(fitted, fixture_df, COLS)), 999, 2).count() == 0
