"""Ranking / classification metrics against a brute-force numpy version of
the reference definitions, on a fixture with tied scores at the k boundary,
k larger than a user's rows and a user without positives."""

import math

import numpy as np
import pandas as pd
import pytest

from basketlens.operators import evaluate as E


def _fixture():
    rows = []
    # user 1: ties at the k=5 boundary (0.5 x3 around rank 4-6)
    for i, (lab, sc) in enumerate([(1, .9), (0, .8), (1, .7), (0, .5), (1, .5), (0, .5), (1, .2), (0, .1)]):
        rows.append((1, 100 + i, lab, sc))
    # user 2: fewer rows than every k
    rows += [(2, 200, 1, .3), (2, 201, 0, .6)]
    # user 3: no positives
    rows += [(3, 300, 0, .9), (3, 301, 0, .4)]
    # user 4: all positives
    rows += [(4, 400, 1, .55), (4, 401, 1, .45)]
    return pd.DataFrame(rows, columns=["user_id", "item_id", "label", "score"])


def _order(g):
    # score desc, ties by item id (our tie rule)
    return g.sort_values(["score", "item_id"], ascending=[False, True])


def _ap(y, s):
    P = y.sum()
    if P == 0:
        return 0.0
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        sel = s >= t
        ap += (y[s == t].sum() / P) * (y[sel].sum() / sel.sum())
    return ap


def _auc(y, s):
    P, N = y.sum(), len(y) - y.sum()
    if P == 0 or N == 0:
        return None
    ranks = pd.Series(s).rank(method="average").to_numpy()
    return (ranks[y == 1].sum() - P * (P + 1) / 2) / (P * N)


def _brute(g, k):
    o = _order(g)
    y = o["label"].to_numpy()
    top = y[:k]
    hits = top.sum()
    P = g["label"].sum()
    prec = hits / k
    rec = hits / P if P else 0.0
    dcg = sum(v / math.log2(i + 2) for i, v in enumerate(top))
    idcg = sum(1 / math.log2(i + 2) for i in range(min(k, P)))
    return {"precision": prec, "recall": rec, "f1": 0.0 if prec + rec == 0 else 2 * prec * rec / (prec + rec),
            "ndcg": dcg / idcg if idcg > 0 else 0.0, "hit_rate": 1.0 if hits > 0 else 0.0}


def test_per_user_metrics_match_bruteforce(spark):
    pdf = _fixture()
    got = E.evaluate(spark.createDataFrame(pdf)).toPandas().set_index("user_id")
    for u, g in pdf.groupby("user_id"):
        y, s = g["label"].to_numpy(), g["score"].to_numpy()
        for k in E.KS:
            b = _brute(g, k)
            for m, v in b.items():
                assert got.loc[u, f"{m}_at_{k}"] == pytest.approx(v), (u, m, k)
        assert got.loc[u, "mean_average_precision"] == pytest.approx(_ap(y, s))
        auc = _auc(y, s)
        if auc is None:
            assert pd.isna(got.loc[u, "auc_roc"]) and pd.isna(got.loc[u, "log_loss"])
        else:
            assert got.loc[u, "auc_roc"] == pytest.approx(auc)
            p = np.clip(s, E.EPS, 1 - E.EPS)
            assert got.loc[u, "log_loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        pred = (s >= 0.5).astype(int)
        assert got.loc[u, "accuracy"] == pytest.approx((pred == y).mean())


def test_global_evaluation_and_top_k(spark):
    pdf = _fixture()
    ev = E.global_evaluation(spark.createDataFrame(pdf)).first()
    y, s = pdf["label"].to_numpy(), pdf["score"].to_numpy()
    assert ev["auc_roc"] == pytest.approx(_auc(y, s))
    assert ev["mean_average_precision"] == pytest.approx(_ap(y, s))
    o = pdf.sort_values(["score", "user_id", "item_id"], ascending=[False, True, True])
    assert ev["precision_at_5"] == pytest.approx(o["label"].to_numpy()[:5].sum() / 5)
    assert ev["total_samples"] == len(pdf) and ev["positive_samples"] == y.sum()


def test_recommend_is_sorted_and_bounded(spark):
    recs = E.recommend(spark.createDataFrame(_fixture()), 3).toPandas()
    for _, g in recs.groupby("user_id"):
        assert len(g) <= 3
        p = g.sort_values("rank")["reorder_probability"].to_numpy()
        assert (np.diff(p) <= 0).all()
        assert g["reorder_probability"].between(0, 1).all()


def test_average_rank_ties(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", None)], "m string, v double")
    got = {r["m"]: r["v_rank"] for r in E.average_rank_desc(df, "v", "v_rank").collect()}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": None}


def test_pair_rules_match_bruteforce(spark):
    from itertools import permutations
    from basketlens.operators.basket import pair_rules
    tx = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "d"), (4, "b"), (4, "c")]
    got = {(r["antecedent"], r["consequent"]): r for r in
           pair_rules(spark.createDataFrame(tx, "order_id long, item string"), "item", 0.3, 0.0).collect()}
    orders = {}
    for o, i in tx:
        orders.setdefault(o, set()).add(i)
    n = len(orders)
    sup = {i: sum(i in s for s in orders.values()) / n for i in "abcd"}
    exp = {}
    for a, b in permutations("abcd", 2):
        both = sum(a in s and b in s for s in orders.values()) / n
        if sup[a] >= 0.3 and sup[b] >= 0.3 and both >= 0.3:
            exp[(a, b)] = (both, both / sup[a], both / sup[a] / sup[b])
    assert set(got) == set(exp)
    for key, (s, c, lift) in exp.items():
        assert got[key]["support"] == pytest.approx(s) and got[key]["confidence"] == pytest.approx(c)
        assert got[key]["lift"] == pytest.approx(lift)
