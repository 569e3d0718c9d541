"""ML preparation, training and scoring on MLlib.

Everything is DataFrame / MLlib: statistics are aggregates over the feature
table (one pass for all columns via ``stack``), the user split is an
arithmetic hash of the user id, scaling is a ``SQLTransformer`` carrying the
train-set mean and population std (MLlib's ``StandardScaler`` uses n-1), and
a fitted model is one ``PipelineModel`` (scaler + assembler + classifier)
that persists and reloads as a unit.  The two gradient-boosting libraries of
the reference collapse into ``GBTClassifier``.
"""

from __future__ import annotations


from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions import fixed as FX
from basketlens.functions import scalar as S
from basketlens.operators import network, trees
from basketlens.operators.common import with_scalars
from basketlens.operators.stats import exact_quantiles, mode_by

LABEL = "reordered"
KEYS = ("user_id", "product_id")
SPLIT_SEED = FX.SPLIT_SEED
TRAIN_FRACTION = FX.TRAIN_FRACTION


def feature_columns(df: DataFrame) -> list[str]:
    """P20: numeric columns other than keys and label, in table order."""
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return [f.name for f in df.schema.fields
            if f.name not in (*KEYS, LABEL) and isinstance(f.dataType, num)]


def contract_features(df: DataFrame, contract=FX.MODEL_FEATURES) -> list[str]:
    """P20 + M18: the feature columns that the table's schema has, in the
    contract's order; a feature of the contract that is missing or not
    numeric is a ``ValueError``."""
    have = set(feature_columns(df))
    missing = [c for c in contract if c not in have]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return [c for c in contract if c in have]


def long_features(df: DataFrame, cols) -> DataFrame:
    """Unpivot feature columns to (feature, value) with ``stack``."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, value)")


def imputation_values(df: DataFrame, numeric, categorical=()) -> DataFrame:
    """M1: exact median per numeric column (one ordered scan for all of
    them) and first mode per categorical column (else 'unknown'), as
    (feature, median double, mode string)."""
    med = exact_quantiles(long_features(df, numeric), "value", {"median": 0.5}, by=["feature"])
    out = med.select("feature", "median", F.lit(None).cast("string").alias("mode"))
    for c in categorical:
        m = mode_by(df, [], c, "mode").select(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("median"),
                                              F.coalesce(F.col("mode").cast("string"), F.lit("unknown")).alias("mode"))
        out = out.unionByName(m)
    return out


def impute(df: DataFrame, fills: dict) -> DataFrame:
    """M1 apply: ``coalesce`` with the fitted values."""
    return df.select(*[F.coalesce(F.col(c), F.lit(fills[c]).cast(df.schema[c].dataType)).alias(c)
                       if c in fills else F.col(c) for c in df.columns])


def fitted_fills(values: DataFrame) -> dict:
    """The rows of ``imputation_values`` (one a column) as ``impute`` takes them."""
    return {r["feature"]: r["mode"] if r["median"] is None else r["median"] for r in values.collect()}


def user_split(df: DataFrame, fraction: float = TRAIN_FRACTION, seed: int = SPLIT_SEED) -> DataFrame:
    """M2: user-level split, no user on both sides; deterministic in any engine."""
    train = S.key_hash(F.col("user_id"), seed) < F.lit(fraction * S.HASH_MODULUS)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def split_summary(df: DataFrame) -> DataFrame:
    """M2 report: rows, users and positive rate per side."""
    return user_split(df).groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                               F.countDistinct("user_id").alias("users"),
                                               F.avg(LABEL).alias("positive_rate"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights n / (2 n_c)."""
    per = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("n").alias("__t"))
    return with_scalars(per, tot).select(LABEL, "n", (F.col("__t") / (2.0 * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame) -> DataFrame:
    """Attach the class weight (a two-row table: broadcast is bounded)."""
    return df.join(F.broadcast(class_weights(df).select(LABEL, "weight")), LABEL, "left")


def feature_moments(train: DataFrame, cols) -> DataFrame:
    """M3 + M4: per feature mean, population std (0 -> 1), min, max and
    sample variance, fitted on the train side only: one wide aggregate, no
    unpivot and no sort."""
    x = {c: F.col(c).cast("double") for c in cols}
    wide = train.agg(*(f(x[c]).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (
        ("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max), ("variance", F.var_samp))))
    rows = ", ".join(f"'{c}', mean_{i}, sd_{i}, min_{i}, max_{i}, variance_{i}" for i, c in enumerate(cols))
    long = wide.selectExpr(f"stack({len(cols)}, {rows}) AS (feature, mean, __sd, min, max, variance)")
    return long.withColumn("std", F.when((F.col("__sd") == 0) | F.col("__sd").isNull(), F.lit(1.0))
                           .otherwise(F.col("__sd"))).drop("__sd")


def scaler_params(train: DataFrame, cols) -> DataFrame:
    """``feature_moments`` with the exact median and quartiles that robust
    scaling needs (one ordered scan for all features)."""
    q = exact_quantiles(long_features(train, cols), "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=["feature"])
    return feature_moments(train, cols).join(F.broadcast(q), "feature", "left")     # one row a feature


def scaling_stage(params: DataFrame, cols, kind: str = "standard") -> SQLTransformer:
    """SQL scaling stage with the fitted constants (one small row per
    feature crosses to the driver: bounded by the feature count)."""
    p = {r["feature"]: r for r in params.collect()}
    exprs = []
    for c in cols:
        r = p[c]
        if kind == "standard":
            off, width = r["mean"], r["std"]
        elif kind == "minmax":
            off, width = r["min"], (r["max"] - r["min"]) or 1.0
        else:   # robust
            off, width = r["median"], (r["q3"] - r["q1"]) or 1.0
        e = f"(CAST(`{c}` AS DOUBLE) - {off:.17e}) / {width:.17e}"     # an exponent makes it a double, not a decimal
        exprs.append(f"{e} AS `s_{c}`")
    return SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")


def variance_kbest(train: DataFrame, cols, k: int = FX.K_BEST) -> DataFrame:
    """M5: the k features of largest sample variance (ties by name)."""
    v = long_features(train, cols).groupBy("feature").agg(F.var_samp("value").alias("variance"))
    return v.orderBy(F.desc_nulls_last("variance"), F.asc("feature")).limit(k)


def target_correlation(df: DataFrame, cols) -> DataFrame:
    """M7: |Pearson r| of each feature with the label, ranked; a constant
    feature gives null (T7: covar_pop / nullif(sd * sd, 0))."""
    y = F.col(LABEL).cast("double")
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        den = F.stddev_pop(x) * F.stddev_pop(y)
        aggs.append(F.when(den == 0, F.lit(None).cast("double")).otherwise(F.covar_pop(x, y) / den).alias(c))
    row = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, correlation)")
    return long.withColumn("abs_correlation", F.abs("correlation"))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """M8: pairwise Pearson r of ``cols``: one aggregate pass (a pair's two
    directions are one covariance), then ``stack`` to long format
    (feature_a, feature_b, r)."""
    x = [F.col(c).cast("double") for c in cols]
    at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.stddev_pop(v).alias(f"sd_{i}") for i, v in enumerate(x)),
                 *(F.covar_pop(x[i], x[j]).alias(f"cov_{i}_{j}") for i, j in at))
    pairs = ", ".join(f"'{a}', '{b}', IF(sd_{i} * sd_{j} = 0, CAST(NULL AS DOUBLE), cov_{min(i, j)}_{max(i, j)} / (sd_{i} * sd_{j}))"
                      for i, a in enumerate(cols) for j, b in enumerate(cols))
    return row.selectExpr(f"stack({len(cols) ** 2}, {pairs}) AS (feature_a, feature_b, r)")


# --------------------------------------------------------------- training
LR_CHANGE = 1e-10      # relative change of the objective at which MLlib's solver ends
SPREAD_ROWS = 1 << 19  # rows (the sum of balanced weights) above which a logistic fit reads its rows where they are
FOREST_DEPTH = 30      # MLlib's largest depth; a smaller one trades accuracy for memory


def classifier(kind: str, n_features: int, weighted: bool = True, total_weight: float = 1.0):
    w = {"weightCol": "weight"} if weighted else {}
    if kind == "logistic":      # M12: max_iter 1000, balanced, L2 with C = 1 and tol 1e-4 as scikit-learn:
        # its objective 0.5|w|^2 + C sum(w_i loss_i) equals MLlib's with regParam = 1 / (C * sum of weights)
        # MLlib stops on the objective's relative change, scikit-learn where no gradient entry exceeds its tol: at a
        # change of 1e-4 the objective is still 8e-5 too high (newton.certificate), so the change allowed is smaller
        return LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=FX.LR_MAX_ITER, tol=LR_CHANGE,
                                  regParam=1.0 / (FX.LR_C * max(total_weight, 1.0)), elasticNetParam=0.0,
                                  standardization=False, **w)
    if kind == "gbt":           # M13: 100 trees, depth 6, learning rate 0.1
        return GBTClassifier(featuresCol="features", labelCol=LABEL, maxIter=FX.GBT_TREES, maxDepth=FX.GBT_DEPTH,
                             stepSize=FX.GBT_LEARNING_RATE,
                             seed=SPLIT_SEED, **w)
    if kind == "random_forest":  # M9 / M15 member: 100 trees, sqrt features per split; scikit-learn grows
        # unbounded trees, MLlib ends at depth 30; with each row's node kept, a level does not walk all rows
        # down all trees from the root again
        return RandomForestClassifier(featuresCol="features", labelCol=LABEL, numTrees=FX.RF_TREES, maxDepth=FOREST_DEPTH,
                                      featureSubsetStrategy="sqrt", seed=SPLIT_SEED, cacheNodeIds=True, **w)
    if kind == "mlp":           # M14: 512-256-128, 50 full passes (the reference's 50 epochs);
        # no dropout / batch-norm layers exist in MLlib
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol=LABEL,
                                              layers=[n_features, *FX.MLP_HIDDEN, 2], maxIter=FX.MLP_EPOCHS,
                                              seed=SPLIT_SEED)
    raise ValueError(kind)


def fit(kind: str, train: DataFrame, cols, scaler: SQLTransformer) -> PipelineModel:
    """Scaler + assembler + classifier as one pipeline."""
    assembler = VectorAssembler(inputCols=[f"s_{c}" for c in cols], outputCol="features")
    data = with_weights(train) if kind != "mlp" else train
    total = data.agg(F.sum("weight")).first()[0] if kind == "logistic" else 1.0
    clf = classifier(kind, len(cols), weighted=kind != "mlp", total_weight=float(total or 1.0))
    # Iterative learners re-read their input every pass: spread it over all
    # cores (a small table is often one partition after AQE), and let what
    # they read be cached once, so that no pass scales the rows again.
    from pyspark import StorageLevel
    par = train.sparkSession.sparkContext.defaultParallelism
    dealt = data.repartition(max(par, train.rdd.getNumPartitions()))

    def assembled(rows: DataFrame) -> DataFrame:
        return assembler.transform(scaler.transform(rows)).select(LABEL, "features", *(["weight"] if kind != "mlp" else []))

    if kind in ("gbt", "random_forest"):       # keep their rows as bin numbers; the dealt rows are only sampled for bin edges, as MLlib does
        grow = trees.fit_boosted if kind == "gbt" else trees.fit_forest
        weights = {int(r[LABEL]): r["weight"] for r in class_weights(train).collect() if r[LABEL] is not None}
        return PipelineModel([scaler, assembler, grow(clf, assembled(data), assembled(dealt), weights)])
    if kind == "logistic" and float(total or 0.0) > SPREAD_ROWS and train.rdd.getNumPartitions() >= par:
        # MLlib caches blocks of its own: with the vectors cached, too, every row would be held twice; spread rows need no shuffle
        return PipelineModel([scaler, assembler, clf.fit(assembled(data))])
    vectors = assembled(dealt).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = network.fit(clf, vectors) if kind == "mlp" else clf.fit(vectors)
    finally:
        vectors.unpersist()
    return PipelineModel([scaler, assembler, model])


def check_contract(df: DataFrame, cols) -> DataFrame:
    """Every model feature must be present (else ``ValueError``);
    columns are reordered to the stored feature order."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    extra = [c for c in df.columns if c not in cols]
    return df.select(*extra, *cols)


def score(model: PipelineModel, df: DataFrame, cols) -> DataFrame:
    """Probability of class 1 in [0, 1] and the 0.5 prediction."""
    scored = model.transform(check_contract(df, cols))
    prob = vector_to_array(F.col("probability"))[1]
    keep = [c for c in df.columns if c in (*KEYS, LABEL, "split")]
    return scored.select(*keep, prob.alias("reorder_probability"),
                         (prob >= FX.THRESHOLD).cast("int").alias("reorder_prediction"))


def score_batches(model: PipelineModel, frames, cols) -> list[DataFrame]:
    """M19 over a list of frames: one scored frame per input, in order."""
    return [score(model, f, cols) for f in frames]


def save(model: PipelineModel, path: str) -> None:
    """M17 persist (scaler constants, feature order and model together)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """M17 load; a missing model is ``FileNotFoundError``."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    from basketlens.sources.readers import path_exists
    if spark is None or not path_exists(spark, path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, cols) -> DataFrame:
    """M9: tree-ensemble importances as (feature, importance); the vector
    has one entry per feature (bounded by the feature count)."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(cols, [float(v) for v in imp])), "feature string, importance double")


def combined_importance(importance: DataFrame, correlation: DataFrame) -> DataFrame:
    """0.6 * importance + 0.4 * |r|, ranked."""
    return (importance.join(correlation.select("feature", "abs_correlation"), "feature", "left")
            .withColumn("combined_score", FX.IMPORTANCE_WEIGHTS[0] * F.col("importance")
                        + FX.IMPORTANCE_WEIGHTS[1] * F.coalesce(F.col("abs_correlation"), F.lit(0.0)))
            .orderBy(F.desc("combined_score"), F.asc("feature")))


def ensemble(scored_a: DataFrame, scored_b: DataFrame, wa: float = FX.ENSEMBLE_WEIGHTS[0],
             wb: float = FX.ENSEMBLE_WEIGHTS[1]) -> DataFrame:
    """Weighted mean of two members' probabilities, threshold > 0.5."""
    a = scored_a.select(*KEYS, LABEL, F.col("reorder_probability").alias("__pa"))
    b = scored_b.select(*KEYS, F.col("reorder_probability").alias("__pb"))
    p = wa * F.col("__pa") + wb * F.col("__pb")
    return a.join(b, list(KEYS), "inner").select(*KEYS, LABEL, p.alias("reorder_probability"),
                                                   (p > FX.THRESHOLD).cast("int").alias("reorder_prediction"))


def as_eval(scored: DataFrame) -> DataFrame:
    """Scored rows in the evaluation layout (user_id, item_id, label, score)."""
    return scored.select("user_id", F.col("product_id").alias("item_id"), F.col(LABEL).alias("label"),
                         F.col("reorder_probability").alias("score"))
