"""ML queries: M1-M20, E13, E15, W7 on model scores.  Statistics have DuckDB
twins; trained-model outputs are checked by row count and properties."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import fixed as FX
from basketlens.functions.scalar import key_hash_sql
from basketlens.operators import evaluate as E
from basketlens.operators import features as FT
from basketlens.operators import models as M
from basketlens.operators import quality as Q
from basketlens.operators.staging import staged
from basketlens.plans import q_features
from basketlens.plans.evaluate_helpers import demo_predictions
from basketlens.plans.registry import query
from basketlens.session import ensure_checkpoint_dir

FEATURES = FX.MODEL_FEATURES

CANDS = q_features.NB + ",\ncand AS (" + q_features.CANDIDATES_SQL + f"""),
spl AS (SELECT *, CASE WHEN {key_hash_sql('user_id', 42)}
                        < 0.8 * 4294967296 THEN 'train' ELSE 'test' END AS split FROM cand),
lf AS (UNPIVOT (SELECT split, reordered, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURES)} FROM spl)
       ON {', '.join(FEATURES)} INTO NAME feature VALUE value)"""


def _memo(c, key, build):
    if key not in c._cache:
        c._cache[key] = build()
    return c._cache[key]


def _split(c) -> DataFrame:
    return _memo(c, "ml_split", lambda: staged(M.user_split(FT.candidate_training_set(c.orders, c.basket, c.products)), "split"))


def _train(c):
    return _split(c).where(F.col("split") == "train")


def _test(c):
    return _split(c).where(F.col("split") == "test")


def _scaler(c):
    return _memo(c, "ml_scaler", lambda: M.scaling_stage(M.feature_moments(_train(c), FEATURES), FEATURES))


def _model(c, kind):
    def build():
        model = M.fit(kind, _train(c), FEATURES, _scaler(c))
        path = f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/models/{kind}-{uuid.uuid4().hex}"     # one folder for each fit
        M.save(model, path)
        return path, model
    return _memo(c, ("ml_model", kind), build)


def _candidates(c) -> DataFrame:
    """Scoring candidates of every user with a history."""
    return _memo(c, "ml_candidates", lambda: staged(FT.candidate_set(c.orders, c.basket, c.products), "candidates"))


def _scores(c, kind, side="test"):
    _, model = _model(c, kind)
    data = _test(c) if side == "test" else _train(c)
    return _memo(c, ("ml_scores", kind, side), lambda: staged(M.score(model, data, FEATURES), "scores"))


@query("final_dataset_nulls", "Q13", ctes=q_features.NB + ",\nfinal AS (" + q_features.TRAINING_SQL + ")",
       sql="\nUNION ALL\n".join(
           f"SELECT 'final' AS \"table\", '{n}' AS \"column\", count(*) FILTER (WHERE {n} IS NULL) AS nulls, "
           f"count(*) FILTER (WHERE {n} IS NULL) * 100.0 / count(*) AS null_pct FROM final"
           for n in ("user_id", "product_id", "reordered", *FEATURES)))
def _final_nulls(c):
    return Q.column_profile("final", FT.training_set(c.orders, c.basket, c.products)).drop("dtype")


@query("user_split", "M2,J11,T15", ctes=CANDS, sql="""
SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, avg(reordered) AS positive_rate
FROM spl GROUP BY split""")
def _user_split(c):
    return M.split_summary(FT.candidate_training_set(c.orders, c.basket, c.products))


@query("class_weights", "M11", ctes=CANDS, sql="""
SELECT reordered, count(*) AS n, (SELECT count(*) FROM cand) / (2.0 * count(*)) AS weight
FROM cand GROUP BY reordered""")
def _weights(c):
    return M.class_weights(FT.candidate_training_set(c.orders, c.basket, c.products))


@query("scaler_params", "M3,M4", ctes=CANDS, sql="""
SELECT feature, avg(value) AS mean, min(value) AS min, max(value) AS max, var_samp(value) AS variance,
       quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3,
       CASE WHEN stddev_pop(value) = 0 OR stddev_pop(value) IS NULL THEN 1.0 ELSE stddev_pop(value) END AS std
FROM lf WHERE split = 'train' GROUP BY feature""")
def _scaler_params(c):
    return M.scaler_params(_train(c), FEATURES)


@query("imputation_values", "M1,T13", ctes=CANDS, sql="""
SELECT feature, quantile_cont(value, 0.5) AS median, CAST(NULL AS VARCHAR) AS mode FROM lf GROUP BY feature""")
def _impute(c):
    return M.imputation_values(_split(c), FEATURES)


@query("variance_kbest", "M5", ctes=CANDS, sql="""
SELECT feature, var_samp(value) AS variance FROM lf WHERE split = 'train'
GROUP BY feature ORDER BY variance DESC NULLS LAST, feature LIMIT 100""")
def _kbest(c):
    return M.variance_kbest(_train(c), FEATURES)


@query("target_correlation", "M7,T7", ctes=CANDS, sql="""
SELECT feature, CASE WHEN stddev_pop(value) * stddev_pop(reordered) = 0 THEN NULL
                     ELSE covar_pop(value, reordered) / (stddev_pop(value) * stddev_pop(reordered)) END AS correlation,
       abs(CASE WHEN stddev_pop(value) * stddev_pop(reordered) = 0 THEN NULL
                ELSE covar_pop(value, reordered) / (stddev_pop(value) * stddev_pop(reordered)) END) AS abs_correlation
FROM lf GROUP BY feature""")
def _target_corr(c):
    return M.target_correlation(_split(c), FEATURES)


def _top_correlated(c, k=10):
    corr = M.target_correlation(_split(c), FEATURES)
    rows = corr.orderBy(F.desc_nulls_last("abs_correlation"), F.asc("feature")).limit(k).collect()
    return [r["feature"] for r in rows]


@query("correlation_matrix", "M8", ctes=CANDS + """,
tc AS (SELECT feature FROM (
         SELECT feature, abs(CASE WHEN stddev_pop(value) * stddev_pop(reordered) = 0 THEN NULL
                ELSE covar_pop(value, reordered) / (stddev_pop(value) * stddev_pop(reordered)) END) AS a
         FROM lf GROUP BY feature) ORDER BY a DESC NULLS LAST, feature LIMIT 10),
rl AS (SELECT rid, feature, value FROM (
         UNPIVOT (SELECT row_number() OVER () AS rid, """ + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES) + """ FROM spl)
         ON """ + ", ".join(FEATURES) + """ INTO NAME feature VALUE value)
       WHERE feature IN (SELECT feature FROM tc))""", sql="""
SELECT a.feature AS feature_a, b.feature AS feature_b,
       CASE WHEN stddev_pop(a.value) * stddev_pop(b.value) = 0 THEN NULL
            ELSE covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END AS r
FROM rl a JOIN rl b ON a.rid = b.rid GROUP BY a.feature, b.feature""")
def _corr_matrix(c):
    return M.correlation_matrix(_split(c), _top_correlated(c))


# ------------------------------------------------------------ trained models
@query("logistic_scores", "M12,M19,P20")
def _lr(c):
    return _scores(c, "logistic")


@query("gbt_scores", "M13,M19")
def _gbt(c):
    return _scores(c, "gbt")


@query("mlp_scores", "M14,M19")
def _mlp(c):
    return _scores(c, "mlp")


@query("forest_importance", "M9")
def _rf_imp(c):
    _, model = _model(c, "random_forest")
    return M.feature_importance(model, FEATURES)


@query("combined_feature_score", "M10")
def _combined(c):
    _, model = _model(c, "random_forest")
    return M.combined_importance(M.feature_importance(model, FEATURES),
                                 M.target_correlation(_split(c), FEATURES))


@query("ensemble_scores", "M15")
def _ensemble(c):
    return M.ensemble(_scores(c, "gbt"), _scores(c, "random_forest"), 0.6, 0.4)


@query("holdout_validation", "E15,M17,M18,E7,E8")
def _holdout(c):
    path, _ = _model(c, "gbt")
    reloaded = M.load(path)
    return E.global_evaluation(M.as_eval(M.score(reloaded, _test(c), FEATURES)))


@query("trained_model_comparison", "E13,W4")
def _trained_cmp(c):
    reports = {k: E.global_evaluation(M.as_eval(_scores(c, k))) for k in ("logistic", "gbt", "random_forest", "mlp")}
    reports["ensemble"] = E.global_evaluation(M.as_eval(M.ensemble(_scores(c, "gbt"), _scores(c, "random_forest"))))
    return E.compare_models(reports)


@query("model_recommendations", "W7,M19")
def _model_recs(c):
    _, model = _model(c, "gbt")
    unlabelled = _candidates(c).withColumn(M.LABEL, F.lit(None).cast("int"))
    return E.recommend(M.as_eval(M.score(model, unlabelled, FEATURES)), 10)


@query("model_demo_predictions", "M20")
def _model_demo(c):
    return demo_predictions(M.as_eval(_scores(c, "gbt")))


@query("stream_request_scores", "R1,W7,M18,M19")
def _stream(c):
    from basketlens.streaming.scoring import run_scoring
    _, model = _model(c, "gbt")
    sink = run_scoring(c.spark, c.sf_dir, _candidates(c), model, FEATURES, k=5)
    return c.spark.read.parquet(sink)


def _name_split(c) -> DataFrame:
    return _memo(c, "ml_name_split", lambda: staged(M.user_split(
        FT.candidate_training_set(c.orders, c.name_basket, c.name_products)), "name_split"))


def _name_scores(c, kind):
    def build():
        split = _name_split(c)
        train = split.where(F.col("split") == "train")
        scaler = _memo(c, "ml_name_scaler",
                       lambda: M.scaling_stage(M.feature_moments(train, FEATURES), FEATURES))
        model = M.fit(kind, train, FEATURES, scaler)
        return staged(M.score(model, split.where(F.col("split") == "test"), FEATURES), "name_scores")
    return _memo(c, ("ml_name_scores", kind), build)


@query("name_level_model_comparison", "E13,M12,M13,M15 (name key)")
def _name_cmp(c):
    reports = {k: E.global_evaluation(M.as_eval(_name_scores(c, k))) for k in ("logistic", "gbt", "random_forest")}
    reports["ensemble"] = E.global_evaluation(M.as_eval(M.ensemble(_name_scores(c, "gbt"),
                                                                  _name_scores(c, "random_forest"))))
    return E.compare_models(reports)


@query("scaled_test_features", "M3,M18", ctes=CANDS + """,
tp AS (SELECT feature, avg(value) AS mean,
              CASE WHEN stddev_pop(value) = 0 OR stddev_pop(value) IS NULL THEN 1.0 ELSE stddev_pop(value) END AS sd
       FROM lf WHERE split = 'train' GROUP BY feature),
tl AS (UNPIVOT (SELECT user_id, product_id, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
       + """ FROM spl WHERE split = 'test') ON """ + ", ".join(FEATURES) + """ INTO NAME feature VALUE value)""",
       sql="""
SELECT tl.user_id, tl.product_id, tl.feature, (tl.value - tp.mean) / tp.sd AS scaled
FROM tl JOIN tp ON tl.feature = tp.feature""")
def _scaled(c):
    # the pipeline's own scaling stage (SQLTransformer with the train constants) on the test side
    scaled = _scaler(c).transform(_test(c))
    pairs = ", ".join(f"'{f}', `s_{f}`" for f in FEATURES)
    return scaled.selectExpr("user_id", "product_id", f"stack({len(FEATURES)}, {pairs}) AS (feature, scaled)")
