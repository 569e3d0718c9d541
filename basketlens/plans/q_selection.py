"""Feature selection, imputation and scaling applied to the model's training side (M1, M4, M5, M6, P20)."""

from pyspark.sql import functions as F

from basketlens.functions import fixed as FX
from basketlens.operators import models as M
from basketlens.operators import selection as SEL
from basketlens.plans import q_models as QM
from basketlens.plans.registry import query

TRAIN_LF = QM.CANDS + """,
tr AS (SELECT feature, reordered AS label, value FROM lf WHERE split = 'train')"""

_SIDES = ", ".join(f"{{'d': abs(v - {f}(v, {j}) OVER w), 'm': {f}(n, {j}) OVER w}}" for j in range(1, SEL.NEIGHBOURS + 1) for f in ("lag", "lead"))

MUTUAL = TRAIN_LF + f""",
mc AS (SELECT feature, label, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v, count(*) AS n FROM tr GROUP BY 1, 2, 3),
ml AS (SELECT feature, label, sum(n)::BIGINT AS nl FROM mc GROUP BY 1, 2 HAVING sum(n) > 1),
mr AS (SELECT mc.*, nl, least({SEL.NEIGHBOURS}, nl - 1) AS k FROM mc JOIN ml ON mc.feature = ml.feature AND mc.label = ml.label),
nb AS (SELECT *, [{{'d': 0.0, 'm': n - 1}}, {_SIDES}] AS near FROM mr WINDOW w AS (PARTITION BY feature, label ORDER BY v)),
pt AS (SELECT feature, label, v, n, nl, k, unnest(near) AS p FROM nb),
cu AS (SELECT feature, label, v, n, nl, k, p.d AS d, sum(p.m) OVER (PARTITION BY feature, label, v ORDER BY p.d ROWS UNBOUNDED PRECEDING) AS c
       FROM pt WHERE p.d IS NOT NULL),
dk AS (SELECT feature, label, v, n, nl, k, min(d) FILTER (c >= k) AS d FROM cu GROUP BY ALL),
al AS (SELECT feature, v, sum(n)::BIGINT AS t FROM mr GROUP BY 1, 2),
cm AS (SELECT *, sum(t) OVER (PARTITION BY feature ORDER BY v) AS c FROM al),
mm AS (
  SELECT q.feature, q.n, q.nl, q.k, h.c - coalesce(l.c, 0) AS m
  FROM (SELECT *, v - d AS lo, v + d AS hi FROM dk WHERE d > 0) q
  ASOF JOIN cm h ON q.feature = h.feature AND q.hi > h.v
  ASOF LEFT JOIN cm l ON q.feature = l.feature AND q.lo >= l.v
  UNION ALL
  SELECT q.feature, q.n, q.nl, q.n, al.t FROM dk q JOIN al ON al.feature = q.feature AND al.v = q.v WHERE q.d = 0)"""


@query("mutual_info_scores", "M6", ctes=MUTUAL, sql=f"""
SELECT feature, sum(n)::BIGINT AS n,
  greatest(0.0, {SEL.psi_sql('sum(n)')} + sum(n * ({SEL.psi_sql('k')} - {SEL.psi_sql('nl')} - {SEL.psi_sql('m')})) / sum(n)) AS mutual_information
FROM mm GROUP BY feature""")
def _mutual(c):
    train = QM._train(c)
    return SEL.mutual_information(train, M.contract_features(train), M.LABEL)


CHI2 = TRAIN_LF + """,
pl AS (SELECT feature, label, count(*) AS n, sum(value) AS s, min(value) AS least FROM tr GROUP BY 1, 2),
ps AS (SELECT feature, sum(n) AS rows, sum(s) AS grand, min(least) AS least FROM pl GROUP BY 1)"""


@query("chi2_scores", "M6", ctes=CHI2, sql="""
SELECT pl.feature, CASE WHEN any_value(ps.least) >= 0 AND any_value(grand) <> 0
  THEN sum((s - n / rows * grand) ** 2 / nullif(n / rows * grand, 0)) END AS score
FROM pl JOIN ps ON pl.feature = ps.feature GROUP BY pl.feature""")
def _chi2(c):
    train = QM._train(c)
    return SEL.chi2_scores(train, M.contract_features(train), M.LABEL)


F_TEST = TRAIN_LF + """,
pl AS (SELECT feature, label, count(*) AS n, avg(value) AS mean, var_pop(value) AS v FROM tr GROUP BY 1, 2),
pa AS (SELECT feature, sum(n) AS rows, count(*) AS groups, sum(n * mean) / sum(n) AS grand FROM pl GROUP BY 1),
fs AS (SELECT pl.feature, (sum(n * (mean - grand) ** 2) / nullif(any_value(groups) - 1, 0))
         / nullif(sum(n * v) / nullif(any_value(rows) - any_value(groups), 0), 0) AS score
       FROM pl JOIN pa ON pl.feature = pa.feature GROUP BY 1)"""


@query("univariate_selection", "M6", ctes=F_TEST, sql=f"""
SELECT feature, score, CAST(row_number() OVER o AS INTEGER) AS position FROM fs WINDOW o AS (ORDER BY score DESC NULLS LAST, feature)
QUALIFY position <= {FX.SELECT_BEST}""")
def _univariate(c):
    train = QM._train(c)
    return SEL.select_best(SEL.univariate_scores(train, M.contract_features(train), M.LABEL, "f_classif"), FX.SELECT_BEST)


@query("variance_selected_rows", "M5,P20", ctes=QM.CANDS + f""",
best AS (SELECT feature FROM lf WHERE split = 'train' GROUP BY feature ORDER BY var_samp(value) DESC NULLS LAST, feature LIMIT {FX.SELECT_BEST}),
sl AS (UNPIVOT (SELECT user_id, product_id, reordered, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FX.MODEL_FEATURES)} FROM spl WHERE split = 'test')
       ON {', '.join(FX.MODEL_FEATURES)} INTO NAME feature VALUE value)""", sql="""
SELECT user_id, product_id, reordered, feature, value FROM sl WHERE feature IN (SELECT feature FROM best)""")
def _selected_rows(c):
    """The test side with the columns selected on the train side, unpivoted (their names follow from the data)."""
    train = QM._train(c)
    cols = M.contract_features(train)
    kept = SEL.keep_features(QM._test(c), M.variance_kbest(train, cols, FX.SELECT_BEST), cols)
    names = [x for x in kept.columns if x in cols]
    pairs = ", ".join(f"'{x}', CAST(`{x}` AS DOUBLE)" for x in names)
    return kept.selectExpr(*M.KEYS, M.LABEL, f"stack({len(names)}, {pairs}) AS (feature, value)")


@query("scaled_features_minmax_robust", "M4", ctes=QM.CANDS + f""",
tp AS (SELECT feature, min(value) AS lo, CASE WHEN max(value) = min(value) THEN 1.0 ELSE max(value) - min(value) END AS width,
         quantile_cont(value, 0.5) AS mid,
         CASE WHEN quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1.0
              ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS iqr
       FROM lf WHERE split = 'train' GROUP BY feature),
tl AS (UNPIVOT (SELECT user_id, product_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FX.MODEL_FEATURES)} FROM spl WHERE split = 'test')
       ON {', '.join(FX.MODEL_FEATURES)} INTO NAME feature VALUE value)""", sql="""
SELECT tl.user_id, tl.product_id, tl.feature, (tl.value - lo) / width AS minmax, (tl.value - mid) / iqr AS robust
FROM tl JOIN tp ON tl.feature = tp.feature""")
def _scaled_kinds(c):
    cols = M.contract_features(QM._train(c))
    params = M.scaler_params(QM._train(c), cols).cache()
    try:
        stages = {kind: M.scaling_stage(params, cols, kind) for kind in ("minmax", "robust")}
    finally:
        params.unpersist()
    out = QM._test(c)
    for kind, stage in stages.items():
        out = stage.transform(out).withColumnsRenamed({f"s_{x}": f"{kind}_{x}" for x in cols})
    pairs = ", ".join(f"'{x}', `minmax_{x}`, `robust_{x}`" for x in cols)
    return out.selectExpr("user_id", "product_id", f"stack({len(cols)}, {pairs}) AS (feature, minmax, robust)")


@query("imputed_orders", "M1", ctes="""
gap AS (SELECT quantile_cont(days_since_prior_order, 0.5) AS median FROM c_orders)""", sql="""
SELECT order_id, user_id, coalesce(days_since_prior_order, median) AS days_since_prior_order,
  coalesce(CASE WHEN days_since_prior_order > 7 THEN eval_set END, (SELECT eval_set FROM c_orders WHERE days_since_prior_order > 7
    GROUP BY eval_set ORDER BY count(*) DESC, eval_set LIMIT 1), 'unknown') AS eval_set
FROM c_orders, gap""")
def _imputed(c):
    """Gaps by their median, the eval set of orders with a gap of a week or less (taken as unknown) by its mode."""
    rows = c.orders.select("order_id", "user_id", "days_since_prior_order",
                           F.when(F.col("days_since_prior_order") > 7, F.col("eval_set")).alias("eval_set"))
    return M.impute(rows, M.fitted_fills(M.imputation_values(rows, ["days_since_prior_order"], ["eval_set"])))
