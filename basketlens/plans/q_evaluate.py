"""Evaluation: E1-E14, E16, E17, W4, W7, A35, A36, M20 (scores: up_order_rate)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import scalar as S
from basketlens.operators import evaluate as E
from basketlens.operators import features as FT
from basketlens.operators import models as M
from basketlens.plans import q_features
from basketlens.plans.registry import query
from basketlens.plans.evaluate_helpers import demo_predictions, demo_summary
from basketlens.streaming.scoring import run_requests

KS = E.KS

#: Scores of all users with a history (hs) and of the evaluation pairs with their label (sc).
SCORES = """
trl AS (SELECT DISTINCT user_id, product_id FROM c_basket WHERE eval_set = 'train'),
hs AS (SELECT h.user_id, h.product_id AS item_id, h.n / t.n AS score
       FROM (SELECT user_id, product_id, count(order_id) AS n FROM c_basket WHERE eval_set = 'prior' GROUP BY ALL) h
       JOIN (SELECT user_id, count(*) AS n FROM c_orders WHERE eval_set = 'prior' GROUP BY user_id) t
         ON h.user_id = t.user_id),
sc AS (SELECT h.user_id, h.item_id, CASE WHEN t.product_id IS NULL THEN 0 ELSE 1 END AS label, h.score
       FROM hs h LEFT JOIN trl t ON h.user_id = t.user_id AND h.item_id = t.product_id
       WHERE h.user_id IN (SELECT user_id FROM trl))"""


def eval_ctes(src: str, key: str, tag: str) -> str:
    """CTEs computing ``evaluate()`` of ``src`` grouped by ``key`` into ``{tag}``."""
    hk = ",\n".join(f"sum(CASE WHEN rn <= {k} THEN label ELSE 0 END) AS h{k}, "
                    f"sum(CASE WHEN rn <= {k} THEN label / log2(rn + 1) ELSE 0.0 END) AS d{k}" for k in KS)
    topk = ",\n".join(
        f"h{k} / {float(k)} AS precision_at_{k}, "
        f"CASE WHEN P = 0 THEN 0.0 ELSE h{k} / P END AS recall_at_{k}, "
        f"CASE WHEN h{k} / {float(k)} + CASE WHEN P = 0 THEN 0.0 ELSE h{k} / P END = 0 THEN 0.0 ELSE "
        f"2 * (h{k} / {float(k)}) * (CASE WHEN P = 0 THEN 0.0 ELSE h{k} / P END) / "
        f"(h{k} / {float(k)} + CASE WHEN P = 0 THEN 0.0 ELSE h{k} / P END) END AS f1_at_{k}, "
        f"CASE WHEN least({k}, P) > 0 THEN d{k} / list_sum(list_transform(range(CAST(least({k}, P) AS BIGINT)), "
        f"lambda i: 1.0 / log2(i + 2))) ELSE 0.0 END AS ndcg_at_{k}, "
        f"CAST(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hit_rate_at_{k}" for k in KS)
    return f"""
{tag}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, item_id) AS rn FROM {src}),
{tag}_tk AS (SELECT {key}, sum(label) AS P, {hk} FROM {tag}_r GROUP BY {key}),
{tag}_g AS (SELECT {key}, score, count(*) AS c, sum(label) AS p FROM {src} GROUP BY {key}, score),
{tag}_gc AS (SELECT *, sum(c) OVER w AS cc, sum(p) OVER w AS cp FROM {tag}_g
             WINDOW w AS (PARTITION BY {key} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{tag}_t AS (SELECT {key}, CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(p) AS BIGINT) AS n_pos
            FROM {tag}_g GROUP BY {key}),
{tag}_rk AS (SELECT gc.{key}, t.n_rows, t.n_pos,
                    sum(CASE WHEN t.n_pos > 0 THEN gc.p / t.n_pos * (gc.cp / gc.cc) END) AS ap,
                    sum(gc.p * (t.n_rows - gc.cc + (gc.c + 1) / 2.0)) AS rsum
             FROM {tag}_gc gc JOIN {tag}_t t ON gc.{key} = t.{key} GROUP BY gc.{key}, t.n_rows, t.n_pos),
{tag}_cl AS (SELECT {key}, count(*) AS n, sum(pred * label) AS tp, sum(pred * (1 - label)) AS fp,
                    sum((1 - pred) * label) AS fn, sum((1 - pred) * (1 - label)) AS tn,
                    avg(-(label * ln(pp) + (1 - label) * ln(1 - pp))) AS ll
             FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred,
                          least(greatest(score, 2.220446049250313e-16), 1.0 - 2.220446049250313e-16) AS pp
                   FROM {src}) GROUP BY {key}),
{tag} AS (
  SELECT rk.{key}, rk.n_rows, rk.n_pos,
         CASE WHEN rk.n_pos > 0 THEN rk.ap ELSE 0.0 END AS mean_average_precision,
         CASE WHEN rk.n_pos = 0 OR rk.n_rows = rk.n_pos THEN NULL
              ELSE (rk.rsum - rk.n_pos * (rk.n_pos + 1) / 2.0) / (rk.n_pos * (rk.n_rows - rk.n_pos)) END AS auc_roc,
         (cl.tp + cl.tn) / cl.n AS accuracy,
         CASE WHEN cl.tp + cl.fp = 0 THEN 0.0 ELSE cl.tp / (cl.tp + cl.fp) END AS precision,
         CASE WHEN cl.tp + cl.fn = 0 THEN 0.0 ELSE cl.tp / (cl.tp + cl.fn) END AS recall,
         CASE WHEN 2 * cl.tp + cl.fp + cl.fn = 0 THEN 0.0 ELSE 2 * cl.tp / (2 * cl.tp + cl.fp + cl.fn) END AS f1,
         CASE WHEN rk.n_pos = 0 OR rk.n_rows = rk.n_pos THEN NULL ELSE cl.ll END AS log_loss,
         CASE WHEN rk.n_pos = 0 OR rk.n_rows = rk.n_pos THEN NULL ELSE rk.ap END AS auc_pr,
         {topk}
  FROM {tag}_rk rk JOIN {tag}_cl cl ON rk.{key} = cl.{key} JOIN {tag}_tk tk ON rk.{key} = tk.{key})"""


@query("eval_scores", "E10 input", ctes=SCORES, sql="SELECT * FROM sc")
def _scores(c):
    return E.labelled_scores(c.orders, c.basket)


@query("per_user_evaluation", "E1-E8,E10", ctes=SCORES + "," + eval_ctes("sc", "user_id", "ev"),
       sql="SELECT * FROM ev")
def _per_user(c):
    return E.evaluate(E.labelled_scores(c.orders, c.basket), ["user_id"])


def _global_select(tag: str) -> str:
    topk = ", ".join(f"{m}_at_{k}" for k in KS for m in ("precision", "recall", "f1", "ndcg", "hit_rate"))
    return f"""
SELECT n_rows AS total_samples, n_pos AS positive_samples, n_rows - n_pos AS negative_samples,
       n_pos / n_rows AS positive_rate, accuracy, precision, recall, f1, auc_roc, auc_pr, log_loss,
       mean_average_precision, {topk} FROM {tag}"""


GLOBAL = SCORES + """,
scg AS (SELECT 0 AS g, user_id, score, label,
               row_number() OVER (ORDER BY score DESC, user_id, item_id) AS item_id FROM sc)""" + "," + \
    eval_ctes("scg", "g", "gl")


@query("global_evaluation", "E11", ctes=GLOBAL, sql=_global_select("gl"))
def _global(c):
    return E.global_evaluation(E.labelled_scores(c.orders, c.basket))


HOLDOUT = SCORES + f""",
ho AS (SELECT * FROM sc WHERE NOT {S.key_hash_sql('user_id', M.SPLIT_SEED)} < {M.TRAIN_FRACTION} * {S.HASH_MODULUS}),
scg AS (SELECT 0 AS g, user_id, score, label, row_number() OVER (ORDER BY score DESC, user_id, item_id) AS item_id FROM ho)""" + "," + \
    eval_ctes("scg", "g", "gl")


@query("holdout_rate_validation", "E15,E11,M2", ctes=HOLDOUT, sql=_global_select("gl"))
def _holdout_rates(c):
    """The held-out users' metrics of the order-rate scorer, which needs no training."""
    held = M.user_split(E.labelled_scores(c.orders, c.basket)).where(F.col("split") == "test")
    return E.global_evaluation(held.drop("split"))


@query("global_precision_recall_at_k", "E12", ctes=GLOBAL, sql=" UNION ALL ".join(
    f"SELECT {k} AS k, precision_at_{k} AS precision, recall_at_{k} AS recall FROM gl WHERE n_rows >= {k}"
    for k in (10, 20, 50)))
def _global_pr(c):
    return E.global_precision_recall_at_k(E.labelled_scores(c.orders, c.basket))


@query("coverage_at_k", "E9,U4,T10", ctes=SCORES + """,
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rn FROM sc)""",
       sql=" UNION ALL ".join(
           f"SELECT {k} AS k, count(DISTINCT item_id) AS items, "
           f"count(DISTINCT item_id) / (SELECT count(*) FROM c_products) AS coverage FROM r WHERE rn <= {k}"
           for k in KS))
def _coverage(c):
    return E.coverage_at_k(E.labelled_scores(c.orders, c.basket), c.products)


RECS = SCORES + """,
recs AS (SELECT user_id, item_id AS product_id, score AS reorder_probability,
                CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS reorder_prediction,
                CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'medium' ELSE 'low' END AS confidence,
                CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
         FROM hs QUALIFY rank <= 10)"""


@query("recommendations", "W7,P18,M19,T10", ctes=RECS, sql="SELECT * FROM recs")
def _recs(c):
    return E.recommend(E.history_scores(c.orders, c.basket), 10)


@query("stream_rate_answers", "R1,W7,M19", ctes=RECS, sql="""
SELECT e.event_id, e.user_id, r.product_id, r.reorder_probability, r.rank, r.product_id IS NOT NULL AS answered
FROM events e LEFT JOIN (SELECT * FROM recs WHERE rank <= 5) r ON r.user_id = e.user_id""")
def _stream_rates(c):
    """Every event answered by the stream with the five best products of its user by order rate."""
    top = E.recommend(E.history_scores(c.orders, c.basket), 5)
    return c.spark.read.parquet(run_requests(c.spark, c.sf_dir, top)).select(
        "event_id", "user_id", "product_id", "reorder_probability", "rank", "answered")


@query("recommendations_per_department", "A35,P24", ctes=RECS, sql="""
SELECT coalesce(d.department, 'Unknown') AS department, count(*) AS recommendations FROM recs r
LEFT JOIN c_products p ON r.product_id = p.product_id
LEFT JOIN c_departments d ON p.department_id = d.department_id GROUP BY 1""")
def _recs_dept(c):
    return E.recommendations_per_department(E.recommend(E.history_scores(c.orders, c.basket), 10), c.products, c.departments)


@query("business_metrics", "E14,J12", ctes=RECS + """,
pred AS (SELECT o.order_id, r.product_id FROM recs r
         JOIN (SELECT DISTINCT user_id, order_id FROM c_basket WHERE eval_set = 'train') o ON r.user_id = o.user_id),
act AS (SELECT order_id, product_id FROM c_basket WHERE eval_set = 'train'),
pv AS (SELECT sum(v.value) AS s FROM pred JOIN c_values v ON pred.product_id = v.product_id),
av AS (SELECT sum(v.value) AS s FROM act JOIN c_values v ON act.product_id = v.product_id)""", sql="""
SELECT (SELECT s FROM pv) AS predicted_revenue, (SELECT s FROM av) AS actual_revenue,
       CASE WHEN (SELECT s FROM av) = 0 THEN 0.0 ELSE (SELECT s FROM pv) / (SELECT s FROM av) END
         AS revenue_capture_rate,
       (SELECT count(DISTINCT order_id) FROM pred) / (SELECT count(DISTINCT order_id) FROM act) AS order_coverage,
       (SELECT avg(n) FROM (SELECT order_id, count(*) AS n FROM pred GROUP BY order_id)) AS avg_predicted_basket_size,
       (SELECT avg(n) FROM (SELECT order_id, count(*) AS n FROM act GROUP BY order_id)) AS avg_actual_basket_size""")
def _business(c):
    recs = E.recommend(E.history_scores(c.orders, c.basket), 10)
    train = c.basket.where(F.col("eval_set") == "train")
    orders = train.select("user_id", "order_id").distinct()
    pred = recs.join(orders, "user_id", "inner").select("order_id", "product_id")
    return E.business_metrics(pred, train.select("order_id", "product_id"), c.product_values)


def _segmented(c) -> DataFrame:
    s = E.labelled_scores(c.orders, c.basket)
    prior_orders = c.orders.where(F.col("eval_set") == "prior").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("__n"))
    train_orders = c.orders.where(F.col("eval_set") == "train").select("user_id", "order_dow")
    by_count = (s.join(prior_orders, "user_id", "left")
                .withColumn("segment", F.when(F.col("__n") < 5, "new (<5 orders)")
                            .when(F.col("__n") <= 20, "regular (5-20)").otherwise("power (>20)"))
                .drop("__n"))
    by_day = (s.join(train_orders, "user_id", "left")
              .withColumn("segment", F.when(F.col("order_dow").isin(0, 6), "weekend").otherwise("weekday"))
              .drop("order_dow"))
    return by_count.unionByName(by_day)


SEGMENTED = SCORES + """,
po AS (SELECT user_id, count(*) AS n FROM c_orders WHERE eval_set = 'prior' GROUP BY user_id),
tro AS (SELECT user_id, order_dow FROM c_orders WHERE eval_set = 'train'),
seg AS (
  SELECT sc.*, CASE WHEN po.n < 5 THEN 'new (<5 orders)' WHEN po.n <= 20 THEN 'regular (5-20)'
                    ELSE 'power (>20)' END AS segment FROM sc LEFT JOIN po ON sc.user_id = po.user_id
  UNION ALL
  SELECT sc.*, CASE WHEN tro.order_dow IN (0, 6) THEN 'weekend' ELSE 'weekday' END
  FROM sc LEFT JOIN tro ON sc.user_id = tro.user_id)"""


@query("segment_metrics", "E16", ctes=SEGMENTED + "," + eval_ctes("seg", "segment", "sg"), sql="""
SELECT segment, n_rows, n_pos, accuracy, auc_roc FROM sg""")
def _segments(c):
    s = _segmented(c)
    return (E.rank_stats(s, ["segment"]).join(E.classification(s, ["segment"]), "segment")
            .select("segment", "n_rows", "n_pos", "accuracy", "auc_roc"))


@query("error_breakdown", "E17", ctes=SCORES + f""",
grp AS (SELECT *, CASE WHEN {S.key_hash_sql('user_id', 7)} < 0.8 * 4294967296
                       THEN 'train' ELSE 'test' END AS split FROM sc),
b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin,
             count(*) FILTER (WHERE split = 'train') AS e, count(*) FILTER (WHERE split = 'test') AS a
      FROM grp GROUP BY bin),
sh AS (SELECT greatest(e / (SELECT sum(e) FROM b), 1e-6) AS e, greatest(a / (SELECT sum(a) FROM b), 1e-6) AS a FROM b)""",
       sql="""
SELECT CAST(sum(pred * label) AS BIGINT) AS tp, CAST(sum(pred * (1 - label)) AS BIGINT) AS fp,
       CAST(sum((1 - pred) * label) AS BIGINT) AS fn, CAST(sum((1 - pred) * (1 - label)) AS BIGINT) AS tn, (SELECT sum((a - e) * ln(a / e)) FROM sh) AS psi
FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc)""")
def _errors(c):
    s = E.labelled_scores(c.orders, c.basket).withColumn(
        "split", F.when(S.key_hash(F.col("user_id"), 7) < 0.8 * S.HASH_MODULUS, "train").otherwise("test"))
    return E.confusion_and_drift(s, "split", "train", "test")


DEMO = SCORES + f""",
demo AS (SELECT user_id, item_id AS product_id, label AS actual_reordered,
                CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted_reordered, score AS reorder_probability,
                CASE WHEN (CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = label THEN 1 ELSE 0 END AS prediction_correct
         FROM sc ORDER BY {S.key_hash_sql('user_id * 100003 + item_id', 42)}, user_id * 100003 + item_id
         LIMIT 10000)"""


@query("demo_predictions", "M20,S13", ctes=DEMO, sql="SELECT * FROM demo")
def _demo(c):
    return demo_predictions(E.labelled_scores(c.orders, c.basket))


@query("demo_prediction_summary", "A36", ctes=DEMO, sql="""
SELECT count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS products,
       avg(prediction_correct) AS accuracy FROM demo""")
def _demo_summary(c):
    return demo_summary(demo_predictions(E.labelled_scores(c.orders, c.basket)))


SCORERS = {"pair_reorder_rate": "x.up_reorder_rate", "pair_order_rate": "x.up_order_rate",
            "product_reorder_rate": "x.product_reorder_rate"}


def _scorer_frames(c) -> dict[str, DataFrame]:
    cands = FT.candidate_training_set(c.orders, c.basket, c.products)
    base = cands.select("user_id", F.col("product_id").alias("item_id"), F.col("reordered").alias("label"),
                        "up_reorder_rate", "up_order_rate", "product_reorder_rate")
    return {"pair_reorder_rate": base.withColumn("score", F.col("up_reorder_rate")),
            "pair_order_rate": base.withColumn("score", F.col("up_order_rate")),
            "product_reorder_rate": base.withColumn("score", F.col("product_reorder_rate"))}


_cand_body = q_features.CANDIDATES_SQL
_model_ctes = q_features.NB + ",\ncand AS (" + _cand_body + ")"
for _name, _expr in SCORERS.items():
    _model_ctes += (f",\nsc_{_name} AS (SELECT x.user_id, x.product_id AS item_id, x.reordered AS label, "
                    f"{_expr} AS score FROM cand x)")
    _model_ctes += ",\nscg_" + _name + " AS (SELECT 0 AS g, user_id, score, label, row_number() OVER " \
        "(ORDER BY score DESC, user_id, item_id) AS item_id FROM sc_" + _name + ")," + \
        eval_ctes("scg_" + _name, "g", "m_" + _name)

_cmp_rows = " UNION ALL ".join(
    f"SELECT '{n}' AS model_name, n_rows AS total_samples, n_pos / n_rows AS positive_rate, accuracy, precision, "
    f"recall, f1, auc_roc, auc_pr, {', '.join(f'precision_at_{k}' for k in KS)} FROM m_{n}" for n in SCORERS)


def _avg_rank(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE CAST(rank() OVER (ORDER BY {col} DESC NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY {col}) - 1) / 2.0 AS DOUBLE) END AS {col}_rank")


@query("model_comparison", "E13,W4", ctes=_model_ctes, sql=f"""
SELECT *, {_avg_rank('f1')}, {_avg_rank('auc_roc')}, {_avg_rank('precision_at_10')},
       row_number() OVER (ORDER BY f1 DESC NULLS LAST, model_name) = 1 AS is_best
FROM ({_cmp_rows})""")
def _compare(c):
    return E.compare_models({n: E.global_evaluation(df) for n, df in _scorer_frames(c).items()})


