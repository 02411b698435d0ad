"""Supervised models (H1-H6): logistic regression on MLlib, forests from ``trees``.

Parity choices: scikit-learn's L2 logistic regression minimises ½‖w‖² + C·Σwᵢℓᵢ while
MLlib minimises Σwᵢℓᵢ/Σwᵢ + λ/2‖w‖², so λ = 1/(C·Σwᵢ); features are used unscaled by
MLlib (``standardization=False``) because the frame is already standardised.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.util import inheritable_thread_target

from ..schema import FEATURE_COLS, KEY, SEED, TARGET
from ..session import cut_lineage
from . import sampling as SA
from .prepare import with_weight
from .trees import grow_forest


def _assembler(feature_cols):
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")


def fit_logistic(train: DataFrame, feature_cols=None, label: str = TARGET, weight: str | None = "weight",
                 C: float = 0.1, max_iter: int = 1000) -> PipelineModel:            # H1
    feature_cols = list(FEATURE_COLS if feature_cols is None else feature_cols)
    agg = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * float(agg)),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6,
                            family="binomial")
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[_assembler(feature_cols), lr]).fit(train.withColumn(label, F.col(label).cast("double")))


def fit_forest(train: DataFrame, feature_cols=None, label: str = TARGET, weight: str | None = "weight",
               n_trees: int = 300, max_depth: int = 10, min_leaf: int = 5, max_bins: int = 128,
               seed: int = SEED) -> PipelineModel:                                  # H3
    feature_cols = list(FEATURE_COLS if feature_cols is None else feature_cols)
    return PipelineModel([grow_forest(train, feature_cols, label, weight, n_trees, max_depth, min_leaf, max_bins, seed)])


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:     # H2 / H4
    """P(class 1) as a double column (narrow transformation)."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def logistic_score(df: DataFrame, coefficients: dict, intercept: float, out: str = "score") -> DataFrame:  # H2
    """Logistic scoring with given coefficients as column algebra (stream-safe)."""
    z = sum((F.col(c) * F.lit(float(w)) for c, w in coefficients.items()), F.lit(float(intercept)))
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def logistic_coefficients(model: PipelineModel, feature_cols=None) -> tuple[dict, float]:
    feature_cols = list(FEATURE_COLS if feature_cols is None else feature_cols)
    lr = model.stages[-1]
    return dict(zip(feature_cols, lr.coefficients.toArray().tolist())), float(lr.intercept)


def feature_importances(model: PipelineModel, feature_cols=None) -> DataFrame:      # H5
    stage = model.stages[-1]
    if not hasattr(stage, "featureImportances"):
        raise ValueError("model has no feature importances (not fitted as a tree ensemble)")
    imp = stage.featureImportances.toArray().tolist()
    names = list(feature_cols) if feature_cols else [f"f{i}" for i in range(len(imp))]
    return SparkSession.active().createDataFrame(sorted(zip(names, imp), key=lambda t: (-t[1], t[0])),
                             "feature string, importance double")


def balanced(fit, label: str = TARGET):
    """``fit`` with a column ``weight`` refitted on the rows that it gets (balanced class weights)."""
    def run(rows: DataFrame):
        return fit(with_weight(rows, SA.class_weights(SA.class_counts(rows, label)), label))
    return run


def fold_counts(df: DataFrame, fit, k: int = 5, label: str = TARGET, key: str = KEY, seed: int = SEED, parallelism: int | None = None) -> DataFrame:
    """(fold, tp, fp, fn) of each stratified fold, scored at 0.5 by a model fitted on the others.

    Folds are fitted by ``parallelism`` driver threads (all at once by default); the jobs share the session's cores, so a fold's
    small stages don't leave the cluster idle."""
    folded = cut_lineage(SA.stratified_kfold(df, k, label, key, seed))
    y, p = F.col(label).cast("int"), (F.col("score") >= 0.5).cast("int")

    def one(f):
        model = fit(folded.filter(F.col("fold") != f))
        n = score(model, folded.filter(F.col("fold") == f)).agg(
            F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn")).first()
        return (f, *n)

    with ThreadPoolExecutor(parallelism or k) as pool:
        rows = [t.result() for t in [pool.submit(inheritable_thread_target(df.sparkSession)(one), f) for f in range(k)]]
    return df.sparkSession.createDataFrame(rows, "fold int, tp bigint, fp bigint, fn bigint")


def cv_score(df: DataFrame, fit, k: int = 5, label: str = TARGET, key: str = KEY, beta: float = 2.0,
             seed: int = SEED, parallelism: int | None = None) -> DataFrame:                                         # H6
    """Stratified k-fold: fit on k-1 folds, score the held-out fold at 0.5; mean and
    population std of recall, precision, F1 and F-beta over folds."""
    per = fold_counts(df, fit, k, label, key, seed, parallelism)
    tp, fp, fn = [F.col(c).cast("double") for c in ["tp", "fp", "fn"]]
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    b2 = beta * beta
    per = per.withColumns({"recall": rec, "precision": prec})
    per = per.withColumns({
        "f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")), F.lit(0.0)),
        "fbeta": F.coalesce(F.try_divide((1 + b2) * F.col("precision") * F.col("recall"),
                                         b2 * F.col("precision") + F.col("recall")), F.lit(0.0))})
    out = per.agg(*[F.struct(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")).alias(m)
                    for m in ["recall", "precision", "f1", "fbeta"]])
    res = out.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.mean").alias("mean"),
                                                  F.col(f"{m}.std").alias("std"))
                                         for m in ["recall", "precision", "f1", "fbeta"]])).alias("u")).select("u.*")
    return res
