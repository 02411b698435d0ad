"""Registered queries: models and detectors.

Scoring with fixed coefficients / a fixed projection is exact column algebra and gets a
DuckDB oracle; fitted models (MLlib LR/RF, PCA) get rows-only checks and
property tests (AUC floors, normal-only training).
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import prepare as P
from ..operators import recon as RC
from ..schema import FEATURE_COLS
from ..session import cut_lineage
from .inputs import feat
from .oracle_base import with_split
from .registry import register

# Fixed scoring parameters of the oracle-checked queries.
FIXED_COEF = {c: round(0.05 * (i + 1) * (-1) ** i, 2) for i, c in enumerate(FEATURE_COLS)}
FIXED_INTERCEPT = -2.0
_S = 1.0 / math.sqrt(2.0)
_PAIRS = [("step", "day"), ("hour", "high_risk_hour"), ("log_amount", "balance_diff_orig"),
          ("is_transfer_or_cashout", "type_TRANSFER")]
FIXED_DET = RC.LinearDetector(
    list(FEATURE_COLS), [0.0] * len(FEATURE_COLS),
    [[(_S if c in pair else 0.0) for c in FEATURE_COLS] for pair in _PAIRS])


def prepared(spark, sf):
    return P.prepare(feat(spark, sf))


def _sum_sql(terms):
    expr = "CAST(0 AS DOUBLE)"
    for t in terms:
        expr = f"({expr} + {t})"
    return expr


def _fixed_recon_sql():
    det = FIXED_DET
    xs = [f"({c} - CAST({m!r} AS DOUBLE))" for c, m in zip(det.feature_cols, det.mean)]
    z = [_sum_sql([f"{x} * CAST({float(v[i])!r} AS DOUBLE)" for i, x in enumerate(xs)]) for v in det.components]
    zc = ", ".join(f"{e} AS z{j}" for j, e in enumerate(z))
    diffs = []
    for i, (c, m) in enumerate(zip(det.feature_cols, det.mean)):
        rec = f"(CAST({m!r} AS DOUBLE) + " + _sum_sql(
            [f"z{j} * CAST({float(det.components[j][i])!r} AS DOUBLE)" for j in range(det.k)]) + ")"
        diffs.append(f"({c} - {rec})")
    dcols = ", ".join(f"{d} AS d{i}" for i, d in enumerate(diffs))
    err = _sum_sql([f"d{i} * d{i}" for i in range(len(diffs))]) + f" / CAST({len(diffs)} AS DOUBLE)"
    return zc, dcols, err


_ZC, _DC, _ERR = _fixed_recon_sql()
_RECON_CTE = f"""
zz AS (SELECT *, {_ZC} FROM scaled),
dd AS (SELECT *, {_DC} FROM zz),
ee AS (SELECT *, {_ERR} AS error FROM dd)
"""


@register("logistic_score_fixed", with_split(
    "SELECT txn_id, split, round(1 / (1 + exp(-" + _sum_sql(
        [f"{c} * CAST({w!r} AS DOUBLE)" for c, w in FIXED_COEF.items()]).replace(
        "CAST(0 AS DOUBLE)", f"CAST({FIXED_INTERCEPT!r} AS DOUBLE)", 1) + ")), 6) AS score FROM scaled"))
def q_logistic_fixed(spark, sf):                          # H2 (column algebra with fixed coefficients)
    d = prepared(spark, sf).data
    return M.logistic_score(d, FIXED_COEF, FIXED_INTERCEPT).select("txn_id", "split", F.round("score", 6).alias("score"))


@register("reconstruction_error_fixed", with_split(
    "SELECT txn_id, split, round(error, 9) AS error FROM ee", _RECON_CTE))
def q_recon_fixed(spark, sf):                             # H8 (fixed projection)
    d = prepared(spark, sf).data
    return RC.reconstruction_error(d, FIXED_DET).select("txn_id", "split", F.round("error", 9).alias("error"))


@register("top_suspect_features", with_split(
    """SELECT txn_id, string_agg(name, ',' ORDER BY rk) AS top_features FROM (
  SELECT txn_id, name, row_number() OVER (PARTITION BY txn_id ORDER BY -round(abs(d), 9) ASC, name ASC) AS rk FROM (
    SELECT txn_id, unnest([""" + ", ".join(f"'{c}'" for c in FEATURE_COLS) + """]) AS name,
           unnest([""" + ", ".join(f"d{i}" for i in range(len(FEATURE_COLS))) + """]) AS d FROM dd))
WHERE rk <= 3 GROUP BY txn_id""", _RECON_CTE))
def q_top_suspects(spark, sf):                            # H13 (fixed projection)
    d = prepared(spark, sf).data
    t = RC.top_suspect_features(d, FIXED_DET, digits=9)
    return t.select("txn_id", F.array_join("top_features", ",").alias("top_features"))


@register("anomaly_score_normalized", with_split(
    """SELECT txn_id, round(least(greatest(error / greatest(p99, mx), 0), 1), 9) AS score FROM ee,
  (SELECT quantile_cont(error, 0.99) AS p99 FROM ee WHERE split = 'train' AND isFraud = 0),
  (SELECT max(error) AS mx FROM ee WHERE split = 'val') WHERE split = 'val'""", _RECON_CTE))
def q_anomaly_score(spark, sf):                           # H10 + H11 (batch mode)
    d = RC.reconstruction_error(prepared(spark, sf).data, FIXED_DET)
    normal = d.filter((F.col("split") == "train") & (F.col("isFraud") == 0))
    p99 = RC.train_error_stats(normal)["p99"]
    v = d.filter(F.col("split") == "val")
    return RC.normalized_anomaly_score(v, p99).select("txn_id", F.round("score", 9).alias("score"))


@register("train_error_stats", with_split(
    """SELECT round(avg(error), 9) AS mean, round(stddev_pop(error), 9) AS std, round(max(error), 9) AS max,
       round(quantile_cont(error, 0.95), 9) AS p95, round(quantile_cont(error, 0.99), 9) AS p99
FROM ee WHERE split = 'train' AND isFraud = 0""", _RECON_CTE))
def q_train_error_stats(spark, sf):                       # H10
    d = RC.reconstruction_error(prepared(spark, sf).data, FIXED_DET)
    s = RC.error_stats_frame(d.filter((F.col("split") == "train") & (F.col("isFraud") == 0)))
    return s.select(*[F.round(c, 9).alias(c) for c in ["mean", "std", "max", "p95", "p99"]])


def _metrics_for(scored, name):
    # cut once: the threshold, the confusion and the curve all read the scores
    scored = cut_lineage(scored.filter("split <> 'train'").select("txn_id", "split", "isFraud", "score"))
    t = EV.optimal_threshold(scored.filter(F.col("split") == "val")).first()["threshold"]
    return EV.fraud_metrics(scored.filter(F.col("split") == "test"), t, model=name)


@register("logistic_balanced")
def q_logistic_balanced(spark, sf):                       # H1 + H2 + I7 + I2
    p = prepared(spark, sf)
    train = P.with_weight(p.split("train"), p.weights)
    m = M.fit_logistic(train)
    return _metrics_for(M.score(m, p.data), "LR_balanced")


@register("logistic_smote")
def q_logistic_smote(spark, sf):                          # H1 on SMOTE rows (no weights)
    p = prepared(spark, sf)
    m = M.fit_logistic(cut_lineage(p.train_smote()), weight=None)             # read by every pass of the fit
    return _metrics_for(M.score(m, p.data), "LR_smote")


@register("forest_balanced")
def q_forest_balanced(spark, sf):                         # H3 + H4
    p = prepared(spark, sf)
    m = M.fit_forest(P.with_weight(p.split("train"), p.weights))
    return _metrics_for(M.score(m, p.data), "RF_balanced")


@register("forest_importances")
def q_forest_importances(spark, sf):                      # H5
    p = prepared(spark, sf)
    m = M.fit_forest(P.with_weight(p.split("train"), p.weights))
    return M.feature_importances(m, FEATURE_COLS)


@register("logistic_cv")
def q_logistic_cv(spark, sf):                             # H6 (5-fold on train), class weights refitted on each fold's training rows
    return M.cv_score(prepared(spark, sf).split("train"), M.balanced(M.fit_logistic), k=5)


@register("pca_detector")
def q_pca_detector(spark, sf):                            # H7(a) + H8 + I8 + I2
    p = prepared(spark, sf)
    det = RC.fit_pca_detector(p.train_normal(), k=4)
    d = cut_lineage(RC.reconstruction_error(p.data, det).select("txn_id", "split", "isFraud", "error"))
    t = EV.grid_threshold(d.filter(F.col("split") == "val"), score="error").first()["threshold"]
    return EV.fraud_metrics(d.filter(F.col("split") == "test"), t, score="error", model="PCA_recon")


@register("latent_pca_2d")
def q_latent_pca(spark, sf):                              # H9 + H12 (+ E5 union of parts)
    p = prepared(spark, sf)
    det = RC.fit_pca_detector(p.train_normal(), k=4)
    parts = p.train_normal().withColumn("part", F.lit("train_normal")).unionByName(
        p.split("val").withColumn("part", F.lit("val")))
    out, ratio = RC.latent_pca_2d(RC.encode_latent(parts, det))
    return out.select("txn_id", "part", "isFraud", "pc1", "pc2")


@register("pca_detector_report")
def q_pca_detector_report(spark, sf):                     # H7(a) + H8 + H10 + I8 + I2 + A11: the detector's nested report
    from .reports import detector_report
    p = prepared(spark, sf)
    det = RC.fit_pca_detector(p.train_normal(), k=4)
    d = cut_lineage(RC.reconstruction_error(p.data, det).select("txn_id", "split", "isFraud", "error"))
    t = EV.grid_threshold(d.filter(F.col("split") == "val"), score="error").first()["threshold"]
    val, test = (EV.fraud_metrics(d.filter(F.col("split") == s), t, score="error", model="PCA_recon") for s in ("val", "test"))
    normal = d.filter((F.col("split") == "train") & (F.col("isFraud") == 0))
    model = M.fit_logistic(P.with_weight(p.split("train"), p.weights))
    scored = cut_lineage(M.score(model, p.data.filter("split <> 'train'")).select("txn_id", "split", "isFraud", "score"))
    tv = EV.optimal_threshold(scored.filter(F.col("split") == "val")).first()["threshold"]
    ref = EV.fraud_metrics(scored.filter(F.col("split") == "test"), tv, model="LR_balanced")
    return detector_report(det, normal, val, test, ref, t)


@register("forest_smote")
def q_forest_smote(spark, sf):                            # H3 on SMOTE rows (unweighted) + H4 + I7 + I2
    p = prepared(spark, sf)
    return _metrics_for(M.score(M.fit_forest(cut_lineage(p.train_smote()), weight=None), p.data), "RF_smote")


@register("forest_cv")
def q_forest_cv(spark, sf):                               # H6: forest, class weights refitted on each fold's training rows
    return M.cv_score(prepared(spark, sf).split("train"), M.balanced(M.fit_forest), k=5)


@register("stream_scoring", with_split(
    "SELECT txn_id, round(1 / (1 + exp(-" + _sum_sql(
        [f"{c} * CAST({w!r} AS DOUBLE)" for c, w in FIXED_COEF.items()]).replace(
        "CAST(0 AS DOUBLE)", f"CAST({FIXED_INTERCEPT!r} AS DOUBLE)", 1) + ")), 6) AS score, "
    "CAST(CASE WHEN 1 / (1 + exp(-" + _sum_sql(
        [f"{c} * CAST({w!r} AS DOUBLE)" for c, w in FIXED_COEF.items()]).replace(
        "CAST(0 AS DOUBLE)", f"CAST({FIXED_INTERCEPT!r} AS DOUBLE)", 1) + ")) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) "
    "AS prediction FROM scaled"))
def q_stream_scoring(spark, sf):                          # stream: batch-fitted scaler as literals, fixed-weight
    from ..streaming.scoring import read_events_stream, run_available, score_stream, stream_features
    p = prepared(spark, sf)                               # scaler fitted on the train split (batch)
    s = score_stream(stream_features(read_events_stream(spark, sf), p.scaler), FIXED_COEF, FIXED_INTERCEPT)
    out = run_available(s.select("txn_id", "score", "prediction", "prompt"))
    return out.select("txn_id", F.round("score", 6).alias("score"), "prediction")
