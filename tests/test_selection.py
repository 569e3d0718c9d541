"""Selection scores against brute force: mutual information on rows with ties, chi-squared, F, kept columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.operators import models as M
from basketlens.operators import selection as SEL


def psi(n):
    return sum(1 / j for j in range(1, n)) - 0.5772156649015329


def brute_mutual_information(x, y, k=3):
    rows = [(np.float64(np.float32(a)), b) for a, b in zip(x, y) if a is not None and b is not None]
    labels = {b: sum(1 for _, c in rows if c == b) for _, b in rows}
    rows = [r for r in rows if labels[r[1]] > 1]
    if not rows:
        return None
    v, lab = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    total = 0.0
    for i in range(len(v)):
        same = np.sort(np.abs(v[(lab == lab[i]) & (np.arange(len(v)) != i)] - v[i]))
        kk = min(k, len(same))
        d = same[kk - 1]
        m = int((np.abs(v - v[i]) < d).sum()) if d > 0 else int((v == v[i]).sum())
        kk = kk if d > 0 else int(((v == v[i]) & (lab == lab[i])).sum())
        total += psi(kk) - psi(labels[lab[i]]) - psi(m)
    return max(0.0, psi(len(v)) + total / len(v))


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        out.append((i, y, rng.gauss(y, 1), float(rng.randint(0, 3) + y), rng.random(), 5.0, None if rng.random() < 0.2 else rng.gauss(-y, 2)))
    return out


COLS = ["far", "ties", "noise", "constant", "holes"]


@pytest.mark.parametrize("n", [2000, 40, 5])
def test_mutual_information_equals_brute_force(spark, n):
    data = rows(n, n)
    df = spark.createDataFrame(data, "id long, y int, " + ", ".join(f"{c} double" for c in COLS))
    got = {r["feature"]: r["mutual_information"] for r in SEL.mutual_information(df, COLS, "y").collect()}
    for j, c in enumerate(COLS):
        want = brute_mutual_information([r[2 + j] for r in data], [r[1] for r in data])
        assert (c not in got) if want is None else math.isclose(got[c], want, rel_tol=1e-9, abs_tol=1e-10), (c, got.get(c), want)
    if n == 2000:
        assert got["far"] > got["noise"] and got["ties"] > got["noise"]


def test_neighbours_cross_partitions(spark):
    """Partitions with fewer rows than neighbours: the halo reaches over several of them."""
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        vals = [float(v) for v in (0, 1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66, 78, 91)]
        df = spark.createDataFrame([(v, i % 3 + 1, "ab"[i % 2]) for i, v in enumerate(vals)], "value double, n long, g string")
        for r in SEL.with_neighbours(df, ["g"], "value", "n", 3).collect():
            of = [(v, i % 3 + 1) for i, v in enumerate(vals) if "ab"[i % 2] == r["g"]]
            at = [v for v, _ in of].index(r["value"])
            want = sorted((abs(v - r["value"]), m) for j, (v, m) in enumerate(of) if j != at and abs(j - at) <= 3)
            assert sorted((p["d"], p["m"]) for p in r["near"]) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep[0])
        spark.conf.set("spark.sql.shuffle.partitions", keep[1])


def test_one_label_and_single_rows(spark):
    one = spark.createDataFrame([(float(i), 1) for i in range(30)], "x double, y int")
    assert SEL.mutual_information(one, ["x"], "y").first()["mutual_information"] == pytest.approx(0, abs=0.4)
    lone = one.unionAll(spark.createDataFrame([(3.0, 0), (None, None)], "x double, y int"))      # label 0 has one row: left out
    assert SEL.mutual_information(lone, ["x"], "y").first()["n"] == 30
    assert SEL.mutual_information(one.limit(0), ["x"], "y").count() == 0


def test_chi2_and_f(spark):
    data = rows(11, 300)
    df = spark.createDataFrame(data, "id long, y int, " + ", ".join(f"{c} double" for c in COLS))
    chi = {r["feature"]: r["score"] for r in SEL.univariate_scores(df, COLS, "y", "chi2").collect()}
    fs = {r["feature"]: r["score"] for r in SEL.univariate_scores(df, COLS, "y", "f_classif").collect()}
    y = np.array([r[1] for r in data])
    for j, c in enumerate(COLS):
        ok = np.array([r[2 + j] is not None for r in data])
        x, lab = np.array([r[2 + j] or 0.0 for r in data])[ok], y[ok]
        if x.min() < 0:
            assert chi[c] is None
        else:
            obs = np.array([x[lab == v].sum() for v in (0, 1)])
            exp = np.array([(lab == v).mean() * x.sum() for v in (0, 1)])
            assert chi[c] == pytest.approx(((obs - exp) ** 2 / exp).sum(), abs=1e-9)
        groups = [x[lab == v] for v in (0, 1)]
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - 2)
        between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
        assert fs[c] is None if within == 0 else fs[c] == pytest.approx(between / within)
    with pytest.raises(ValueError):
        SEL.univariate_scores(df, COLS, "y", "unknown")


def test_select_and_keep(spark):
    scores = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 1.0)], "feature string, score double")
    best = SEL.select_best(scores, 2)
    assert [(r["feature"], r["position"]) for r in best.orderBy("position").collect()] == [("a", 1), ("b", 2)]
    df = spark.createDataFrame([(1, 1, 2, 3, 4)], "key int, d int, c int, b int, a int")
    assert SEL.keep_features(df, best, ["a", "b", "c", "d"]).columns == ["key", "b", "a"]


def test_impute_applies_fitted_values(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "x"), (3.0, None), (10.0, "y")], "v double, s string")
    fills = M.fitted_fills(M.imputation_values(df, ["v"], ["s"]))
    assert fills == {"v": 3.0, "s": "x"}
    got = M.impute(df, fills)
    assert got.where("v IS NULL OR s IS NULL").count() == 0 and got.agg(F.sum("v")).first()[0] == 17.0


@pytest.mark.parametrize("kind", ["minmax", "robust"])
def test_other_scalers(spark, kind):
    df = spark.createDataFrame([(float(i), 7.0) for i in (0, 1, 2, 4, 100)], "a double, b double")
    out = M.scaling_stage(M.scaler_params(df, ["a", "b"]), ["a", "b"], kind).transform(df).collect()
    want = {"minmax": lambda x: x / 100, "robust": lambda x: (x - 2) / 3}[kind]
    assert [r["s_a"] for r in out] == pytest.approx([want(r["a"]) for r in out]) and {r["s_b"] for r in out} == {0.0}


def test_contract_by_schema(spark):
    df = spark.createDataFrame([(1, 2, 1, 0.5, "t", 3)], "user_id long, product_id long, reordered int, f2 double, name string, f1 int")
    assert M.contract_features(df, ["f1", "f2"]) == ["f1", "f2"]
    for lacking in (["f1", "f3"], ["name"]):
        with pytest.raises(ValueError):
            M.contract_features(df, lacking)
