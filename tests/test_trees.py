"""Boosted trees by histograms against MLlib's."""

from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from basketlens.operators import models as M
from basketlens.operators import newton as N
from basketlens.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=(3000, 4)).round(2), rng.integers(0, 3, 3000)])
    y = rng.random(3000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * x[:, 2] + x[:, 4] - 3)))
    weights = {0: 0.5 / float(1 - y.mean()), 1: 0.5 / float(y.mean())}
    df = spark.createDataFrame([(v, int(c), weights[int(c)]) for v, c in zip(x.tolist(), y)], "x array<double>, reordered int, weight double")
    return df.select(array_to_vector("x").alias("features"), "reordered", "weight").repartition(4).cache(), weights


def _p(model, df):
    return np.array([r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()])


def _classifier(n_trees):
    return GBTClassifier(labelCol="reordered", weightCol="weight", maxIter=n_trees, maxDepth=5, stepSize=0.1, seed=42)


@pytest.mark.parametrize("alone", [T.ALONE, 0])         # in one task; as a job for each level
def test_boosted_trees_are_mllibs(rows, alone, monkeypatch):
    df, weights = rows
    monkeypatch.setattr(T, "ALONE", alone)
    monkeypatch.setattr(T, "KEPT", 3)       # a checkpoint lies between
    monkeypatch.setattr(T, "BLOCK", 500)
    clf = _classifier(7)
    want, got = clf.fit(df), T.fit_boosted(clf, df, df, weights)
    assert np.allclose(_p(got, df), _p(want, df), atol=1e-9)
    assert got.getNumTrees == 7 and got.treeWeights == want.treeWeights and got.getMaxIter() == 7
    assert [t.numNodes for t in got.trees] == [t.numNodes for t in want.trees]
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)


def test_many_bins_are_one_to_a_code(rows, monkeypatch):
    df, weights = rows
    monkeypatch.setattr(T, "PAIRED", 8)
    clf = _classifier(2)
    assert np.allclose(_p(T.fit_boosted(clf, df, df, weights), df), _p(clf.fit(df), df), atol=1e-9)


def test_one_class_is_one_leaf_a_tree(spark):
    df = spark.createDataFrame([([float(i), 1.0], 0, 1.0) for i in range(20)], "x array<double>, reordered int, weight double")
    df = df.select(array_to_vector("x").alias("features"), "reordered", "weight")
    clf = _classifier(3)
    got = T.fit_boosted(clf, df, df, {0: 1.0})
    assert [t.numNodes for t in got.trees] == [1, 1, 1]
    assert np.allclose(_p(got, df), _p(clf.fit(df), df))


def test_models_fit_adds_up_histograms(spark, monkeypatch):
    """MLlib's own fit only sees the one row that its model's files are made with."""
    seen = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: (seen.append(df.count()), fit(self, df, *a))[1])
    monkeypatch.setattr(M.FX, "GBT_TREES", 3)
    df = spark.createDataFrame([(i, i, int(i % 3 == 0), float(i % 7), float(i % 5)) for i in range(200)],
                               "user_id long, product_id long, reordered int, a double, b double")
    model = M.fit("gbt", df, ["a", "b"], M.scaling_stage(M.feature_moments(df, ["a", "b"]), ["a", "b"]))
    assert seen == [1] and model.stages[-1].getNumTrees == 3
    assert M.score(model, df, ["a", "b"]).where(F.col("reorder_probability").isNull()).count() == 0


def _forest(n_trees, **more):
    return RandomForestClassifier(labelCol="reordered", weightCol="weight", numTrees=n_trees, seed=42, **more)


@pytest.mark.parametrize("shared", [T.SHARED, 0])       # whole trees in a task; as a job for each level
def test_a_tree_of_all_rows_and_features_is_mllibs(rows, shared, monkeypatch):
    df, weights = rows
    monkeypatch.setattr(T, "SHARED", shared)
    monkeypatch.setattr(T, "KEPT", 3)
    monkeypatch.setattr(T, "BLOCK", 500)
    monkeypatch.setattr(T, "PASS_BYTES", 1 << 16)       # several passes for the nodes of a level
    clf = _forest(1, maxDepth=5, featureSubsetStrategy="all", bootstrap=False)     # deeper ones have splits of equal gain
    want, got = clf.fit(df), T.fit_forest(clf, df, df, weights)
    assert got.trees[0].numNodes == want.trees[0].numNodes
    assert np.allclose(_p(got, df), _p(want, df), atol=1e-9)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.01)      # equal gains: either feature


def test_a_forest_is_like_mllibs_and_the_same_however_it_grows(rows, monkeypatch):
    df, weights = rows
    clf = _forest(30, maxDepth=12, featureSubsetStrategy="sqrt")
    want, got = clf.fit(df), T.fit_forest(clf, df, df, weights)
    monkeypatch.setattr(T, "SHARED", 0)
    again = T.fit_forest(clf, df, df, weights)
    assert np.allclose(_p(got, df), _p(again, df), atol=1e-12)
    assert got.getNumTrees == 30 and len(got.trees) == 30 and got.numClasses == 2
    assert 0.9 < np.mean([t.numNodes for t in got.trees]) / np.mean([t.numNodes for t in want.trees]) < 1.1
    assert np.abs(_p(got, df) - _p(want, df)).mean() < 0.05
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=0.05)


def test_of_equal_gains_the_first_split_is_taken():
    """Rounding must not choose: sums that differ in the last digits, as other orders of rows give."""
    counts = np.array([[[30.0, 20], [30, 20], [30, 20]], [[5, 45], [5, 45], [5, 45]]])
    sums = np.array([[-25.0, 25.0], [-25.0 * (1 + 1e-15), 25.0 * (1 + 1e-15)], [-25.0 * (1 + 4e-15), 25.0 * (1 + 4e-15)]])
    assert T.best_split(counts, sums, [np.zeros(1)] * 3, np.ones(2))[1:] == (0, 0)
    forest = T.Forest(T.Layout(3, 2, 2), np.array([1.0, 1.1]), 3, 3, False, 1)
    gain, tried, at = forest.splits(counts[:, None], np.array([[2, 0, 1]]), np.ones(3))
    assert gain[0] > 0 and (tried[0], at[0]) == (0, 0)


def test_many_rows_of_a_logistic_fit_are_cached_once(spark, monkeypatch):
    """By MLlib, in blocks; the certificate's single pass writes no table either."""
    df = spark.createDataFrame([(i, i, int((i * 7) % 5 < 2), float(i % 7), float(i % 11)) for i in range(600)],
                               "user_id long, product_id long, reordered int, a double, b double").repartition(32, "user_id").cache()
    scaler = M.scaling_stage(M.feature_moments(df, ["a", "b"]), ["a", "b"])
    want = M.fit("logistic", df, ["a", "b"], scaler).stages[-1]
    kept = []
    persist = type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: (kept.append(1), persist(self, *a))[1])
    monkeypatch.setattr(M, "SPREAD_ROWS", 0)
    got = M.fit("logistic", df, ["a", "b"], scaler).stages[-1]
    assert not kept and np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), atol=1e-4)
    params = {"a": (3.0, 2.0), "b": (5.0, 3.0)}
    monkeypatch.setattr(N, "staged", lambda *a: kept.append(2))
    rows = N.vector_rows(df, ["a", "b"], "reordered", params)
    assert N.certificate(rows, [0.0, 0.0, 0.0], 0.1)["weight"] == 600 and not kept


def test_spread_fits_run_in_threads(rows, monkeypatch):
    """As out-of-fold fits do: a plain thread has no active session."""
    df, weights = rows
    monkeypatch.setattr(T, "ALONE", 0)
    monkeypatch.setattr(T, "KEPT", 2)
    with ThreadPool(2) as pool:
        a, b = pool.map(lambda n: T.fit_boosted(_classifier(n), df, df, weights), [3, 4], 1)
    assert (a.getNumTrees, b.getNumTrees) == (3, 4)
