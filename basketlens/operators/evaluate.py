"""Ranking and classification evaluation on the long score table
``(user_id, item_id, label, score)`` (E1-E17, W4, W7, A35, A36).

* top-k metrics: ``row_number() <= kmax`` per user; Spark plans a partial
  WindowGroupLimit before the shuffle, so at most kmax rows per user and map
  task move, whatever the size of a user;
* AP and ROC-AUC are tie-exact: rows are reduced to (user, score) groups
  (partial aggregate), then the skew-safe ``ordered_scan`` accumulates counts
  in descending score order.  AP = sum_g (p_g / P) * (cum_p / cum_n);
  AUC = (sum of average ranks of positives - P(P+1)/2) / (P N);
* ties in top-k are broken by item id (the reference's argsort order is
  arbitrary), coverage counts item ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions import fixed as FX
from basketlens.functions import scalar as S
from basketlens.operators.common import side_by_side, with_scalars
from basketlens.operators.features import user_product_features
from basketlens.operators.kpi import one_row
from basketlens.operators.ordered import ordered_scan

KS = FX.RANKING_KS
THRESHOLD = FX.THRESHOLD
EPS = 2.220446049250313e-16       # float64 machine epsilon: log-loss clipping


def _div0(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (sklearn ``zero_division=0``)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def idcg(m: Column) -> Column:
    """sum_{i < m} 1 / log2(i + 2): the ideal DCG of m relevant items."""
    return F.when(m <= 0, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(0), m.cast("int") - 1), F.lit(0.0),
                    lambda acc, i: acc + F.lit(1.0) / F.log2(i + 2)))


def topk_metrics(scores: DataFrame, keys=("user_id",), ks=KS) -> DataFrame:
    """E1-E3, E5, E6 per key for every k (k larger than the group is fine)."""
    keys = list(keys)
    kmax = max(ks)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("item_id"))
    top = scores.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= kmax)
    aggs = []
    for k in ks:
        aggs.append(F.sum(F.when(F.col("__rn") <= k, F.col("label")).otherwise(0)).alias(f"__h{k}"))
        aggs.append(F.sum(F.when(F.col("__rn") <= k, F.col("label") / F.log2(F.col("__rn") + 1))
                          .otherwise(0.0)).alias(f"__d{k}"))
    hits = top.groupBy(*keys).agg(*aggs)
    pos = scores.groupBy(*keys).agg(F.sum("label").alias("__P"))
    x = pos.join(hits, keys, "left")
    cols = []
    for k in ks:
        h = F.coalesce(F.col(f"__h{k}"), F.lit(0))
        p_at = h / F.lit(float(k))
        r_at = _div0(h, F.col("__P"))
        ideal = idcg(F.least(F.lit(k), F.col("__P")))
        cols += [p_at.alias(f"precision_at_{k}"), r_at.alias(f"recall_at_{k}"),
                 F.when(p_at + r_at == 0, F.lit(0.0)).otherwise(2 * p_at * r_at / (p_at + r_at)).alias(f"f1_at_{k}"),
                 F.when(ideal > 0, F.coalesce(F.col(f"__d{k}"), F.lit(0.0)) / ideal).otherwise(F.lit(0.0))
                  .alias(f"ndcg_at_{k}"),
                 F.when(h > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"hit_rate_at_{k}")]
    return x.select(*keys, *cols)


def rank_stats(scores: DataFrame, keys=("user_id",)) -> DataFrame:
    """E4 + E8 per key: rows, positives, average precision (0 without
    positives), ROC-AUC with tie-averaged ranks (null with one class)."""
    keys = list(keys)
    groups = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("__c"),
                                                F.sum("label").cast("long").alias("__p"))
    scanned = ordered_scan(groups, keys, ["score"], counter="__g", descending=True,
                           sums={"__cc": "__c", "__cp": "__p"})
    tot = groups.groupBy(*keys).agg(F.sum("__c").alias("n_rows"), F.sum("__p").alias("n_pos"))
    # per key: join the key totals; globally (no key): attach the one-row totals
    j = scanned.join(tot, keys, "inner") if keys else with_scalars(scanned, tot)
    per = j.groupBy(*keys).agg(
        F.first("n_rows").alias("n_rows"), F.first("n_pos").alias("n_pos"),
        F.sum(F.try_divide(F.col("__p").cast("double"), F.col("n_pos").cast("double"))
              * (F.col("__cp") / F.col("__cc"))).alias("__ap"),
        F.sum(F.col("__p") * (F.col("n_rows") - F.col("__cc") + (F.col("__c") + 1) / 2.0)).alias("__rsum"))
    neg = F.col("n_rows") - F.col("n_pos")
    auc = F.when((F.col("n_pos") == 0) | (neg == 0), F.lit(None).cast("double")).otherwise(
        (F.col("__rsum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * neg))
    return per.select(*keys, "n_rows", "n_pos",
                      F.when(F.col("n_pos") > 0, F.col("__ap")).otherwise(F.lit(0.0)).alias("average_precision"),
                      auc.alias("auc_roc"))


def classification(scores: DataFrame, keys=("user_id",), threshold: float = THRESHOLD) -> DataFrame:
    """E7 + log-loss per key (prediction = score >= threshold)."""
    keys = list(keys)
    pred = (F.col("score") >= threshold).cast("int")
    p = F.least(F.greatest(F.col("score"), F.lit(EPS)), F.lit(1.0 - EPS))
    ll = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))
    agg = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(pred * F.col("label")).alias("tp"), F.sum(pred * (1 - F.col("label"))).alias("fp"),
        F.sum((1 - pred) * F.col("label")).alias("fn"), F.sum((1 - pred) * (1 - F.col("label"))).alias("tn"),
        F.avg(ll).alias("__ll"))
    return agg.select(*keys, "tp", "fp", "fn", "tn",
                      ((F.col("tp") + F.col("tn")) / F.col("__n")).alias("accuracy"),
                      _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      _div0(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                      _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                      F.col("__ll").alias("log_loss"))


def evaluate(scores: DataFrame, keys=("user_id",), ks=KS) -> DataFrame:
    """E10 (per user) / any key: classification + probabilistic + ranking.
    AUC, AUC-PR and log-loss are null when the key has one class (the
    reference skips all three then)."""
    keys = list(keys)
    rs = rank_stats(scores, keys)
    cl = classification(scores, keys)
    tk = topk_metrics(scores, keys, ks)
    one_class = F.col("auc_roc").isNull()
    out = rs.join(cl, keys, "inner").join(tk, keys, "inner")
    return (out.withColumn("auc_pr", F.when(one_class, F.lit(None).cast("double")).otherwise(F.col("average_precision")))
            .withColumn("log_loss", F.when(one_class, F.lit(None).cast("double")).otherwise(F.col("log_loss")))
            .withColumnRenamed("average_precision", "mean_average_precision")
            .drop("tp", "fp", "fn", "tn"))


def global_evaluation(scores: DataFrame, ks=KS) -> DataFrame:
    """One row: sample counts, positive rate, classification, AUC/AP/
    log-loss and the global ranking metrics at every k."""
    rs = rank_stats(scores, [])
    cl = classification(scores, [])
    kmax = max(ks)
    # per-partition top-kmax, then a window over at most kmax rows
    top = (scores.orderBy(F.desc("score"), F.asc("user_id"), F.asc("item_id")).limit(kmax)
           .withColumn("__rn", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("user_id"),
                                                                   F.asc("item_id")))))
    aggs = []
    for k in ks:
        aggs.append(F.sum(F.when(F.col("__rn") <= k, F.col("label")).otherwise(0)).alias(f"__h{k}"))
        aggs.append(F.sum(F.when(F.col("__rn") <= k, F.col("label") / F.log2(F.col("__rn") + 1))
                          .otherwise(0.0)).alias(f"__d{k}"))
    hits = top.agg(*aggs)
    x = side_by_side(rs, cl, hits)
    cols = []
    P = F.col("n_pos")
    for k in ks:
        h = F.coalesce(F.col(f"__h{k}"), F.lit(0))
        p_at = h / F.lit(float(k))
        r_at = _div0(h, P)
        ideal = idcg(F.least(F.lit(k), P))
        cols += [p_at.alias(f"precision_at_{k}"), r_at.alias(f"recall_at_{k}"),
                 F.when(p_at + r_at == 0, F.lit(0.0)).otherwise(2 * p_at * r_at / (p_at + r_at)).alias(f"f1_at_{k}"),
                 F.when(ideal > 0, F.coalesce(F.col(f"__d{k}"), F.lit(0.0)) / ideal).otherwise(F.lit(0.0))
                  .alias(f"ndcg_at_{k}"),
                 F.when(h > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"hit_rate_at_{k}")]
    return x.select(
        F.col("n_rows").alias("total_samples"), F.col("n_pos").alias("positive_samples"),
        (F.col("n_rows") - F.col("n_pos")).alias("negative_samples"),
        (F.col("n_pos") / F.col("n_rows")).alias("positive_rate"),
        "accuracy", "precision", "recall", "f1", "auc_roc",
        F.when(F.col("auc_roc").isNull(), F.lit(None).cast("double")).otherwise(F.col("average_precision"))
         .alias("auc_pr"),
        F.when(F.col("auc_roc").isNull(), F.lit(None).cast("double")).otherwise(F.col("log_loss")).alias("log_loss"),
        F.col("average_precision").alias("mean_average_precision"), *cols)


def global_precision_recall_at_k(scores: DataFrame, ks=FX.GLOBAL_KS) -> DataFrame:
    """precision@k / recall@k over all rows, only for k <= rows."""
    ev = global_evaluation(scores, ks)
    parts = [ev.where(F.col("total_samples") >= k)
             .select(F.lit(k).alias("k"), F.col(f"precision_at_{k}").alias("precision"),
                     F.col(f"recall_at_{k}").alias("recall")) for k in ks]
    return reduce(DataFrame.unionByName, parts)


def coverage_at_k(scores: DataFrame, catalogue: DataFrame, ks=KS) -> DataFrame:
    """Distinct recommended item ids over all users' top-k, divided
    by the catalogue size."""
    kmax = max(ks)
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    top = scores.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= kmax)
    total = catalogue.agg(F.count(F.lit(1)).alias("__t"))
    parts = [top.where(F.col("__rn") <= k).agg(F.countDistinct("item_id").alias("items"))
             .withColumn("k", F.lit(k)) for k in ks]
    cov = reduce(DataFrame.unionByName, parts)
    return with_scalars(cov, total).select("k", "items", S.safe_div(F.col("items"), F.col("__t")).alias("coverage"))


def recommend(scores: DataFrame, k: int = FX.RECOMMEND_K) -> DataFrame:
    """W7 / M19 output: at most k products per user by descending
    probability (ties by product id), with the 0.5 prediction and P18 band."""
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("user_id", F.col("item_id").alias("product_id"), F.col("score").alias("reorder_probability"),
                    (F.col("score") >= THRESHOLD).cast("int").alias("reorder_prediction"),
                    S.confidence_band(F.col("score")).alias("confidence"), "rank"))


def recommend_for_user(scores: DataFrame, user_id: int, k: int = FX.RECOMMEND_K) -> DataFrame:
    """W7 for one user (``predict_user_next_products``): the filter is pushed
    below the ranking, so only that user's rows are scored and ranked."""
    return recommend(scores.where(F.col("user_id") == user_id), k)


def recommendations_per_department(recs: DataFrame, products: DataFrame, departments: DataFrame) -> DataFrame:
    """A35."""
    joined = (recs.join(products.select("product_id", "department_id"), "product_id", "left")
              .join(departments, "department_id", "left"))
    label = S.first_present(joined.columns, ["department", "department_x"], "Unknown")
    return joined.groupBy(label.alias("department")).agg(F.count(F.lit(1)).alias("recommendations"))


def average_rank_desc(df: DataFrame, col: str, out: str) -> DataFrame:
    """Pandas ``rank(ascending=False)`` (average of tied positions, nulls
    stay null).  Runs on the model-comparison table (one row per model), so
    the unpartitioned window is bounded by the number of models."""
    w = Window.orderBy(F.desc_nulls_last(col))
    ties = Window.partitionBy(col)
    r = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return df.withColumn(out, F.when(F.col(col).isNull(), F.lit(None).cast("double")).otherwise(r.cast("double")))


def compare_models(reports: dict[str, DataFrame]) -> DataFrame:
    """One row per model from its global evaluation, W4 ranks on f1,
    auc_roc and precision_at_10, and the best model by f1."""
    rows = [ev.select(F.lit(name).alias("model_name"), "total_samples", "positive_rate", "accuracy", "precision",
                      "recall", "f1", "auc_roc", "auc_pr", *[f"precision_at_{k}" for k in KS])
            for name, ev in reports.items()]
    cmp = reduce(DataFrame.unionByName, rows)
    for m in ("f1", "auc_roc", "precision_at_10"):
        cmp = average_rank_desc(cmp, m, f"{m}_rank")
    best = Window.orderBy(F.desc_nulls_last("f1"), F.asc("model_name"))
    return cmp.withColumn("is_best", F.row_number().over(best) == 1)


def business_metrics(predictions: DataFrame, actuals: DataFrame, values: DataFrame) -> DataFrame:
    """Revenue capture, order coverage, basket sizes."""
    pred_rev = predictions.join(values, "product_id", "inner").agg(F.sum("value").alias("predicted_revenue"))
    act_rev = actuals.join(values, "product_id", "inner").agg(F.sum("value").alias("actual_revenue"))
    pred_o = predictions.groupBy("order_id").agg(F.count(F.lit(1)).alias("__n"))
    act_o = actuals.groupBy("order_id").agg(F.count(F.lit(1)).alias("__n"))
    out = one_row(pred_rev, act_rev,
                  pred_o.agg(F.count(F.lit(1)).alias("__po"), F.avg("__n").alias("avg_predicted_basket_size")),
                  act_o.agg(F.count(F.lit(1)).alias("__ao"), F.avg("__n").alias("avg_actual_basket_size")))
    return out.select("predicted_revenue", "actual_revenue",
                      _div0(F.col("predicted_revenue"), F.col("actual_revenue")).alias("revenue_capture_rate"),
                      _div0(F.col("__po"), F.col("__ao")).alias("order_coverage"),
                      "avg_predicted_basket_size", "avg_actual_basket_size")


def confusion_and_drift(scores: DataFrame, group_col: str, expected: str, actual: str,
                        bins: int = 10) -> DataFrame:
    """Confusion counts at 0.5 and the population stability index of
    the score between two groups over ``bins`` equal bins on [0, 1]
    (empty-bin shares floored at 1e-6)."""
    cl = classification(scores, []).select("tp", "fp", "fn", "tn")
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = scores.groupBy(b.alias("bin")).agg(
        F.count_if(F.col(group_col) == expected).alias("__e"), F.count_if(F.col(group_col) == actual).alias("__a"))
    tot = counts.agg(F.sum("__e").alias("__te"), F.sum("__a").alias("__ta"))
    shares = with_scalars(counts, tot)
    e = F.greatest(S.safe_div(F.col("__e"), F.col("__te")), F.lit(1e-6))
    a = F.greatest(S.safe_div(F.col("__a"), F.col("__ta")), F.lit(1e-6))
    psi = shares.agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return side_by_side(cl, psi)


def history_scores(orders: DataFrame, basket: DataFrame) -> DataFrame:
    """(user_id, item_id, score) of every prior pair of every user: the share
    of the user's prior orders that hold the product."""
    return user_product_features(orders, basket).select(
        "user_id", F.col("product_id").alias("item_id"), F.col("up_order_rate").alias("score"))


def labelled_scores(orders: DataFrame, basket: DataFrame) -> DataFrame:
    """Evaluation rows: the scored pairs of users with a train order; label 1
    when the product is in that order."""
    train = basket.where(F.col("eval_set") == "train").select("user_id", F.col("product_id").alias("item_id"))
    pairs = history_scores(orders, basket).join(train.select("user_id").distinct(), "user_id", "left_semi")
    return (pairs.join(train.distinct().withColumn("label", F.lit(1)), ["user_id", "item_id"], "left")
            .withColumn("label", F.coalesce(F.col("label"), F.lit(0))))
