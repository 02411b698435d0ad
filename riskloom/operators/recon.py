"""Unsupervised reconstruction-error detector.

``fit_pca_detector`` is a deterministic linear encoder/decoder: mean and the top-k principal axes of the normal
rows (MLlib PCA, a distributed Gram-matrix aggregate).  Reconstruction, latent codes, errors and
per-feature errors are plain column algebra (codegen, stream-safe).  A dense network is not built (see README).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURE_COLS
from .ordered import exact_quantiles


# ---------------------------------------------------------------------------
# linear (PCA) detector
# ---------------------------------------------------------------------------
@dataclass
class LinearDetector:
    feature_cols: list
    mean: list                     # per feature
    components: list               # k lists of len(features) (orthonormal axes)
    explained_variance: list = field(default_factory=list)
    train_stats: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.components)


def fit_pca_detector(normal: DataFrame, feature_cols=None, k: int = 4) -> LinearDetector:   # H7 (a)
    feature_cols = list(FEATURE_COLS if feature_cols is None else feature_cols)
    means = normal.agg(*[F.avg(c).alias(c) for c in feature_cols]).first()
    centred = normal.select(*[(F.col(c) - F.lit(float(means[c]))).alias(c) for c in feature_cols])
    vec = VectorAssembler(inputCols=feature_cols, outputCol="v").transform(centred)
    model = PCA(k=k, inputCol="v", outputCol="z").fit(vec)
    pc = model.pc.toArray()                      # features × k
    return LinearDetector(feature_cols, [float(means[c]) for c in feature_cols],
                          [pc[:, j].tolist() for j in range(k)],
                          model.explainedVariance.toArray().tolist())


def _latent_cols(det: LinearDetector):
    xs = [F.col(c) - F.lit(m) for c, m in zip(det.feature_cols, det.mean)]
    return [sum((x * F.lit(float(v[i])) for i, x in enumerate(xs)), F.lit(0.0)) for v in det.components]


def encode_latent(df: DataFrame, det: LinearDetector, out: str = "latent") -> DataFrame:     # H9
    return df.withColumn(out, F.array(*_latent_cols(det)))


def reconstruction_error(df: DataFrame, det: LinearDetector, out: str = "error",
                         reduction: str = "mean", per_feature: bool = False) -> DataFrame:   # H8
    """mean (or sum) over features of (x − x̂)², x̂ = μ + V Vᵀ (x − μ)."""
    z = [F.col(f"_z{j}") for j in range(det.k)]
    tmp = df.withColumns({f"_z{j}": e for j, e in enumerate(_latent_cols(det))})
    diffs = []
    for i, (c, m) in enumerate(zip(det.feature_cols, det.mean)):
        rec = F.lit(m) + sum((z[j] * F.lit(float(det.components[j][i])) for j in range(det.k)), F.lit(0.0))
        diffs.append(F.col(c) - rec)
    tmp = tmp.withColumn("_d", F.array(*diffs))
    sq = [F.col("_d")[i] * F.col("_d")[i] for i in range(len(diffs))]
    total = sum(sq, F.lit(0.0))
    err = total / F.lit(float(len(sq))) if reduction == "mean" else total
    tmp = tmp.withColumn(out, err)
    drop = [f"_z{j}" for j in range(det.k)] + ([] if per_feature else ["_d"])
    return tmp.drop(*drop)


def top_suspect_features(df: DataFrame, det: LinearDetector, n: int = 3, out: str = "top_features",
                         digits: int | None = None) -> DataFrame:  # H13
    """Names of the ``n`` features with the largest absolute reconstruction error (ties,
    optionally after rounding the errors to ``digits``, go to the smaller name)."""
    e = reconstruction_error(df, det, per_feature=True)

    def mag(i):
        a = F.abs(F.col("_d")[i])
        return F.round(a, digits) if digits is not None else a

    pairs = F.array(*[F.struct((-mag(i)).alias("neg_err"), F.lit(c).alias("name"))
                      for i, c in enumerate(det.feature_cols)])
    # sort_array + struct-field extraction stay in codegen (no higher-order lambdas)
    top = F.slice(F.sort_array(pairs, asc=True), 1, n).getField("name")
    return e.withColumn(out, top).drop("_d")


def train_error_stats(errors: DataFrame, col: str = "error") -> dict:                # H10
    """mean, population std, p95, p99, max of the training errors (small dict)."""
    a = errors.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.max(col).alias("max")).first()
    q = exact_quantiles(errors, [col], [0.95, 0.99]).orderBy("qi").collect()
    return {"mean": a["mean"], "std": a["std"], "p95": q[0]["quantile"], "p99": q[1]["quantile"], "max": a["max"]}


def error_stats_frame(errors: DataFrame, col: str = "error") -> DataFrame:
    a = errors.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.max(col).alias("max"))
    q = exact_quantiles(errors, [col], [0.95, 0.99]).groupBy().agg(
        F.max(F.when(F.col("qi") == 0, F.col("quantile"))).alias("p95"),
        F.max(F.when(F.col("qi") == 1, F.col("quantile"))).alias("p99"))
    return a.crossJoin(q)             # two one-row frames


def normalized_anomaly_score(df: DataFrame, p99_train: float, col: str = "error", out: str = "score",
                             mode: str = "batch") -> DataFrame:                      # H11
    """clip(err / denom, 0, 1); ``batch``: denom = max(p99_train, max err of ``df``) (a
    one-row aggregate, broadcast); ``train``: denom = p99_train (stream-safe)."""
    if mode == "train":
        denom = F.lit(float(p99_train))
        return df.withColumn(out, F.least(F.greatest(F.col(col) / denom, F.lit(0.0)), F.lit(1.0)))
    mx = df.agg(F.max(col).alias("_mx"))
    j = df.crossJoin(F.broadcast(mx))      # one row
    denom = F.greatest(F.lit(float(p99_train)), F.col("_mx"))
    return j.withColumn(out, F.least(F.greatest(F.col(col) / denom, F.lit(0.0)), F.lit(1.0))).drop("_mx")


def latent_pca_2d(latent: DataFrame, col: str = "latent") -> tuple[DataFrame, list]:   # H12
    """Centred 2-D PCA of latent codes; returns (rows with ``pc1``, ``pc2``) and the
    explained-variance ratios."""
    k = len(latent.select(col).first()[0])
    cols = [f"_l{i}" for i in range(k)]
    flat = latent.withColumns({c: F.col(col)[i] for i, c in enumerate(cols)})
    means = flat.agg(*[F.avg(c).alias(c) for c in cols]).first()
    cen = flat.withColumns({c: F.col(c) - F.lit(float(means[c])) for c in cols})
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(cen)
    m = PCA(k=2, inputCol="_v", outputCol="_p").fit(vec)
    from pyspark.ml.functions import vector_to_array
    out = m.transform(vec).withColumn("_pa", vector_to_array("_p")) \
        .withColumns({"pc1": F.col("_pa")[0], "pc2": F.col("_pa")[1]}).drop("_v", "_p", "_pa", *cols)
    return out, m.explainedVariance.toArray().tolist()
