"""The network's distributed passes (M14): gradient, agreement with MLlib's solver, number of jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from basketlens.operators import models as M
from basketlens.operators import network as NW

LAYERS = [3, 5, 4, 2]


def _rows(n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] > 0).astype(int)
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(int(b), Vectors.dense(a)) for a, b in zip(x, y)], ["reordered", "features"]).repartition(3).persist()


def _loss(model, df):
    p = vector_to_array(F.col("probability"))[F.col("reordered")]
    return model.transform(df).agg(-F.avg(F.log(p))).first()[0]


def test_gradient_is_that_of_the_loss():
    x, y = _rows(30)
    w = np.random.default_rng(1).normal(size=sum((a + 1) * b for a, b in zip(LAYERS, LAYERS[1:])))
    loss, grad = NW.loss_and_gradient(x, y, w, LAYERS)
    for i in range(0, len(w), 7):
        e = np.zeros(len(w))
        e[i] = 1e-5
        diff = (NW.loss_and_gradient(x, y, w + e, LAYERS)[0] - NW.loss_and_gradient(x, y, w - e, LAYERS)[0]) / 2e-5
        assert grad[i] == pytest.approx(diff, rel=1e-5, abs=1e-6)


def test_network_is_mllibs_model_at_mllibs_loss(spark):
    x, y = _rows()
    df = _frame(spark, x, y).coalesce(1).persist()
    clf = MultilayerPerceptronClassifier(layers=LAYERS, labelCol="reordered", maxIter=10, seed=1, blockSize=len(x))
    mine, theirs = NW.fit(clf, df.repartition(3)), clf.fit(df)      # one block there: a mean over rows, as here
    assert type(mine) is type(theirs) and mine.weights.size == theirs.weights.size
    # the loss of the numpy pass at these weights is that of MLlib's model
    assert _loss(mine, df) == pytest.approx(NW.loss_and_gradient(x, y, mine.weights.toArray(), LAYERS)[0] / len(x), rel=1e-9)
    assert _loss(mine, df) == pytest.approx(_loss(theirs, df), rel=0.02)


def test_models_fit_takes_the_numpy_passes(spark, monkeypatch):
    rows = [(u, p, int((u * p) % 3 == 0), float(u), float(p % 7)) for u in range(20) for p in range(10)]
    train = spark.createDataFrame(rows, "user_id long, product_id long, reordered int, a double, b double")
    calls, real = [], NW.minimise
    monkeypatch.setattr(NW, "minimise", lambda at, start, n, tol: calls.append(n) or real(at, start, 2, tol))
    model = M.fit("mlp", train, ["a", "b"], M.scaling_stage(M.feature_moments(train, ["a", "b"]), ["a", "b"]))
    assert calls == [50]
    assert M.score(model, train, ["a", "b"]).where("reorder_probability BETWEEN 0 AND 1").count() == len(rows)
