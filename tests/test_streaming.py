"""R1 on a tiny request stream: every request gets at most k products."""

import pandas as pd

from basketlens.operators import models as M
from basketlens.streaming.scoring import run_scoring

COLS = ["f1", "f2"]


def test_stream_scoring(spark, tmp_path):
    src = tmp_path / "src"
    ev = pd.DataFrame({"event_id": [1, 2, 3, 4], "ts": pd.to_datetime(["2024-01-01"] * 4),
                       "user_id": [1, 1, 2, 99], "event_type": ["view"] * 4, "value": [1.0] * 4, "props": ["{}"] * 4})
    spark.createDataFrame(ev).write.parquet(str(src / "part"))
    feats = spark.createDataFrame([(1, 10, 0.1, 1.0, 1), (1, 11, 0.9, 0.0, 0), (1, 12, 0.5, 0.5, 1),
                                   (2, 20, 0.3, 0.2, 0), (2, 21, 0.8, 0.1, 1)],
                                  "user_id long, product_id long, f1 double, f2 double, reordered int")
    model = M.fit("logistic", feats, COLS, M.scaling_stage(M.scaler_params(feats, COLS), COLS))
    sink = run_scoring(spark, str(src / "part"), feats.drop("reordered"), model, COLS, k=2, pattern="*.parquet")
    out = spark.read.parquet(sink).toPandas()
    sizes = out.groupby("event_id").size().to_dict()
    assert sizes == {1: 2, 2: 2, 3: 2, 4: 1}           # a user without candidates gets an explicit empty answer
    answered = out[out["answered"]]
    assert set(answered["event_id"]) == {1, 2, 3} and out[~out["answered"]]["product_id"].isna().all()
    assert answered["reorder_probability"].between(0, 1).all()


def test_stream_restart_does_not_duplicate(spark, tmp_path):
    src = tmp_path / "src2"
    ev = pd.DataFrame({"event_id": [7, 8], "ts": pd.to_datetime(["2024-01-02"] * 2), "user_id": [1, 2],
                       "event_type": ["view"] * 2, "value": [1.0] * 2, "props": ["{}"] * 2})
    spark.createDataFrame(ev).write.parquet(str(src / "part"))
    feats = spark.createDataFrame([(1, 10, 0.1, 1.0, 1), (1, 11, 0.9, 0.0, 0), (2, 20, 0.3, 0.2, 0),
                                   (2, 21, 0.8, 0.1, 1)],
                                  "user_id long, product_id long, f1 double, f2 double, reordered int")
    model = M.fit("logistic", feats, COLS, M.scaling_stage(M.scaler_params(feats, COLS), COLS))
    root = str(tmp_path / "stream")
    sink = run_scoring(spark, str(src / "part"), feats.drop("reordered"), model, COLS, k=1, pattern="*.parquet",
                       root=root)
    first = spark.read.parquet(sink).count()
    run_scoring(spark, str(src / "part"), feats.drop("reordered"), model, COLS, k=1, pattern="*.parquet", root=root)
    assert spark.read.parquet(sink).count() == first == 2
