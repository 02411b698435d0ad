"""End-to-end run: exploration → preparation → supervised baselines → detector → reports.

The reference runs four notebooks in sequence that hand files to each other; here one
driver program composes the operators and writes every artefact with Spark's writers:

    python -m riskloom.plans.flow --sf /root/testdata/sf0.01 --out /path/to/output

Outputs (under ``--out``): ``eda_report``, ``prep_report``, ``features_meta`` (JSON),
``eda_summary_stats``, ``feature_correlations`` (CSV), ``prepared`` (parquet by split),
``train_smote`` (parquet), ``models/<name>`` (MLlib pipelines, scaler/weights params),
``baseline_report``, ``detector_report``, ``all_metrics`` and
``thresholds`` (JSON) and ``scores`` (parquet by model and split).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import models as M
from ..operators import prepare as P
from ..operators import recon as RC
from ..operators import stats as S
from ..operators.features import build_features
from ..operators.relations import metrics_union, rank_models
from ..schema import FEATURE_COLS, KEY, TARGET
from ..session import build_session, cut_lineage
from ..sources import io as IO
from ..sources.fixture import transactions
from . import reports as R


def _val_test_metrics(scored: DataFrame, name: str, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """Threshold by F2 on val rows, metrics on test rows (one row each)."""
    t = EV.optimal_threshold(scored.filter(F.col("split") == "val"), score=score)
    t_val = t.first()["threshold"]
    m = EV.fraud_metrics(scored.filter(F.col("split") == "test"), t_val, score=score, model=name)
    return m, t.select(F.lit(name).alias("model"), "threshold", F.col("score").alias("f2_val"))


def run_all(spark: SparkSession, raw: DataFrame, out: str, with_forest: bool = True) -> DataFrame:
    """Run every stage on ``raw`` transactions; returns the ranked metrics of all models."""
    out = out.rstrip("/")
    feats = build_features(raw)
    # 1. exploration
    IO.write_json_row(R.eda_report(raw, feats), f"{out}/eda_report")
    IO.write_csv(S.describe(raw.drop(KEY)), f"{out}/eda_summary_stats")
    IO.write_csv(S.numeric_correlation_ranking(feats), f"{out}/feature_correlations")
    # 2. preparation
    prep = P.prepare(feats)
    IO.write_splits(prep.data, out)
    smoted = cut_lineage(prep.train_smote())
    IO.write_smote(smoted, out)
    IO.write_json_row(R.prep_report_full(prep, feats, smoted), f"{out}/prep_report")
    IO.write_json_row(R.feature_metadata(prep.data, smoted), f"{out}/features_meta")
    IO.save_params(spark, {"scaler": prep.scaler, "weights": {str(k): v for k, v in prep.weights.items()},
                           "features": FEATURE_COLS}, f"{out}/models/params")
    # 3. supervised baselines: balanced weights vs SMOTE rows
    train_w = P.with_weight(prep.split("train"), prep.weights)
    fits = {"LR_balanced": lambda: M.fit_logistic(train_w),
            "LR_smote": lambda: M.fit_logistic(smoted, weight=None)}
    if with_forest:
        fits["RF_balanced"] = lambda: M.fit_forest(train_w)
        fits["RF_smote"] = lambda: M.fit_forest(smoted, weight=None)
    metrics, thresholds, scores = [], [], []
    for name, fit in fits.items():               # one distributed fit per model
        model = fit()
        IO.save_model(model, f"{out}/models/{name}")
        scored = M.score(model, prep.data).select(KEY, "split", TARGET, "score")
        m, t = _val_test_metrics(scored, name)
        metrics.append(m)
        thresholds.append(t)
        scores.append(scored.withColumn("model", F.lit(name)))
    test_metrics = metrics_union(*metrics)
    importances = None
    if with_forest:
        importances = M.feature_importances(IO.load_model(f"{out}/models/RF_balanced"), FEATURE_COLS)
    IO.write_json_row(R.baseline_report(S.flag_baseline_metrics(raw), test_metrics, importances),
                      f"{out}/baseline_report")
    # 4. unsupervised detector on normal rows, grid threshold on val
    det = RC.fit_pca_detector(prep.train_normal())
    err = cut_lineage(RC.reconstruction_error(prep.data, det).select(KEY, "split", TARGET, "error"))
    g = EV.grid_threshold(err.filter(F.col("split") == "val"), score="error").first()
    det_val, det_test = (EV.fraud_metrics(err.filter(F.col("split") == s), g["threshold"], score="error", model="PCA_recon")
                         for s in ("val", "test"))
    metrics.append(det_test)
    ref_name = "RF_smote" if with_forest else "LR_smote"
    IO.write_json_row(R.detector_report(det, err.filter((F.col("split") == "train") & (F.col(TARGET) == 0)), det_val, det_test,
                                        test_metrics.filter(F.col("model") == ref_name), g["threshold"]), f"{out}/detector_report")
    ranked = rank_models(metrics_union(*metrics))
    IO.write_json_row(ranked, f"{out}/all_metrics")
    IO.write_json_row(metrics_union(*thresholds), f"{out}/thresholds")
    metrics_union(*scores).write.mode("overwrite").partitionBy("model", "split").parquet(f"{out}/scores")
    return spark.read.json(f"{out}/all_metrics")


def main(argv=None):
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf", required=True, help="folder with the driver's parquet tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--no-forest", action="store_true")
    a = ap.parse_args(argv)
    spark = build_session(app_name="riskloom-run")
    res = run_all(spark, transactions(spark, a.sf), a.out, not a.no_forest)
    res.select("model", "threshold", "recall", "precision", "f1", "roc_auc", "pr_auc").show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
