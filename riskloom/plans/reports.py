"""Report rows (A7-A9, A11): nested one-row DataFrames composed from the operators.

Every number is an aggregate computed by Spark; the report is one ``struct`` row that a
sink writes as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.relations import mule_overlap
from ..schema import FLAG, TARGET


def feature_metadata(split_df: DataFrame, smoted: DataFrame | None = None, label: str = TARGET) -> DataFrame:  # A7
    a = split_df.agg(
        F.count_if((F.col("split") == "train") & (F.col(label) == 1)).cast("bigint").alias("n_train_fraud"),
        F.count_if((F.col("split") == "val") & (F.col(label) == 1)).cast("bigint").alias("n_val_fraud"),
        F.count_if((F.col("split") == "test") & (F.col(label) == 1)).cast("bigint").alias("n_test_fraud"),
        F.count_if((F.col("split") == "train") & (F.col(label) == 0)).alias("_n0"),
        F.count_if(F.col("split") == "train").alias("_nt"))
    out = a.select(
        "n_train_fraud", "n_val_fraud", "n_test_fraud",
        F.floor(F.try_divide(F.col("_n0").cast("double"), F.col("n_train_fraud"))).cast("bigint")
        .alias("imbalance_ratio"),
        F.round(F.col("n_train_fraud") * 100.0 / F.col("_nt"), 6).alias("fraud_rate_train_pct"),
        (F.col("n_train_fraud") / F.col("_nt")).alias("contamination_rate"))
    if smoted is not None:
        out = out.crossJoin(smoted.agg(F.sum(label).cast("bigint").alias("n_smote_fraud")))   # one row each
    return out


def _label_sets(feat: DataFrame, label: str) -> DataFrame:
    """One row: label and flag counts overall, per type and per hour, by GROUPING SETS over a single scan."""
    y, flag = F.col(label), F.col(FLAG)
    counts = [F.count(F.lit(1)).alias("rows"), F.count(y).alias("n"), F.sum(y).alias("f"), F.count_if(y == 0).alias("l"), F.sum(flag).alias("flagged"),
              F.count_if((flag == 1) & (y == 1)).alias("tp"), F.count_if((flag == 0) & (y == 1)).alias("fn"), F.count_if((flag == 1) & (y == 0)).alias("fp")]
    sets = feat.groupingSets([[], ["type"], ["hour"]], "type", "hour").agg(F.grouping_id().alias("set"), *counts)
    whole = F.struct("rows", "n", "f", "l", "flagged", "tp", "fn", "fp")
    return sets.agg(F.max(F.when(F.col("set") == 3, whole)).alias("all"),
                    F.collect_list(F.when(F.col("set") == 1, F.struct("type", "n", "f"))).alias("types"),       # a row a type
                    F.collect_list(F.when(F.col("set") == 2, F.struct("hour", "n", "f"))).alias("hours"))       # a row an hour


def _rate(f, n):
    return F.coalesce(F.try_divide(f, n) * 100, F.lit(0.0))


def eda_numbers(tx: DataFrame, feat: DataFrame, label: str = TARGET, with_types: bool = False) -> DataFrame:      # A9 (numbers)
    """The exploration report's numbers as one flat row, from two scans (counts by grouping sets, accounts).

    High-risk hours are derived from the data (hours whose fraud rate exceeds the global
    rate, D6) and the temporal rates are computed for those hours, as in the reference.
    """
    s = _label_sets(feat, label)
    total = lambda xs, c: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[c], F.lit(0)))
    risky = lambda h: F.coalesce(F.try_divide(h["f"], h["n"]) > F.try_divide(F.col("all.f"), F.col("all.n")), F.lit(False))
    s = s.withColumn("hours", F.filter("hours", lambda h: h["hour"].isNotNull()))
    s = s.withColumns({"high": F.filter("hours", risky), "low": F.filter("hours", lambda h: ~risky(h))})
    tp, rec, prec = F.col("all.tp"), C.safe_div("all.tp", "all.f"), C.safe_div("all.tp", "all.flagged")
    numbers = s.select(
        F.col("all.rows").alias("sample_size"), F.col("all.f").cast("bigint").alias("fraud_count"), F.col("all.l").alias("non_fraud_count"),
        F.round(F.try_divide("all.f", "all.n") * 100, 6).alias("fraud_rate_pct"), F.round(F.try_divide("all.l", "all.f"), 1).alias("imbalance_ratio"),
        tp.alias("flag_tp"), F.col("all.fn").alias("flag_fn"), F.col("all.fp").alias("flag_fp"), F.round(rec, 6).alias("flag_recall"),
        F.round(prec, 6).alias("flag_precision"), F.round(C.safe_div(2 * prec * rec, prec + rec), 6).alias("flag_f1"),
        F.sort_array(F.transform("high", lambda h: h["hour"].cast("int"))).alias("high_risk_hours"),
        F.round(_rate(total(F.col("high"), "f"), total(F.col("high"), "n")), 6).alias("fraud_rate_high_risk_pct"),
        F.round(_rate(total(F.col("low"), "f"), total(F.col("low"), "n")), 6).alias("fraud_rate_normal_pct"), *(["types"] if with_types else []))
    net = mule_overlap(tx).select(
        F.col("n_fraud_dest").alias("n_fraud_dest_accounts"), F.col("n_overlap").alias("n_dest_also_cashout"),
        F.round(F.col("n_overlap") * 100.0 / F.col("n_fraud_dest"), 1).alias("pct_dest_also_cashout"))
    return numbers.crossJoin(net)      # one-row frames


# Fixed values of the exploration report (lists and labels as the reference states them).
FEATURES_ENGINEERED = ["hour", "day", "week", "high_risk_hour", "is_transfer_or_cashout",
                       "balance_diff_orig", "dest_zero_balance"]
FEATURES_EXCLUDED_LEAKAGE = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
                             "nameOrig", "nameDest"]


def eda_report(tx: DataFrame, feat: DataFrame) -> DataFrame:                          # A9
    """The nested exploration report row (dataset, class distribution, flag baseline,
    fraud by type, temporal, network, feature lists, target metrics)."""
    n = eda_numbers(tx, feat, with_types=True)
    of_type = lambda t: F.struct(t["type"], F.struct(t["n"].alias("total"), t["f"].cast("bigint").alias("nb_fraudes"),
                                                     F.round(F.try_divide(t["f"], t["n"]) * 100, 4).alias("taux_fraude_pct")))
    known = F.filter("types", lambda t: t["type"].isNotNull())
    row = n.withColumn("fraud_by_type", F.map_from_entries(F.transform(known, of_type)))
    return row.select(
        F.struct(F.col("sample_size"), F.lit("stratified_split").alias("sampling_method"),
                 F.lit(len(tx.columns) - (1 if "txn_id" in tx.columns else 0)).alias("n_columns")).alias("dataset"),
        F.struct("fraud_count", "non_fraud_count", "fraud_rate_pct", "imbalance_ratio").alias("class_distribution"),
        F.struct(F.col("flag_tp").alias("tp"), F.col("flag_fn").alias("fn"), F.col("flag_fp").alias("fp"),
                 F.col("flag_recall").alias("recall"), F.col("flag_precision").alias("precision"),
                 F.col("flag_f1").alias("f1")).alias("baseline_flagged_fraud"),
        "fraud_by_type",
        F.struct("high_risk_hours", "fraud_rate_high_risk_pct", "fraud_rate_normal_pct").alias("temporal"),
        F.struct("n_fraud_dest_accounts", "n_dest_also_cashout", "pct_dest_also_cashout").alias("network_analysis"),
        F.array(*[F.lit(c) for c in FEATURES_ENGINEERED]).alias("features_engineered"),
        F.array(*[F.lit(c) for c in FEATURES_EXCLUDED_LEAKAGE]).alias("features_excluded_leakage"),
        F.struct(F.lit("Recall").alias("primary"), F.array(F.lit("F1-Score"), F.lit("PR-AUC")).alias("secondary"),
                 F.round(F.col("flag_recall"), 4).alias("dl_target_recall_min")).alias("target_metrics"))


def prep_report(split_df: DataFrame, features_df: DataFrame, label: str = TARGET,
                digits: int = 6) -> DataFrame:                                         # A8
    """Split sizes, fraud counts, balanced class weights (train) and the skewness of
    ``amount`` before / after ``log1p`` — one row from two single-pass aggregates."""
    from ..functions.moments import skew_sample
    y = F.col(label)
    a = split_df.agg(
        *[F.count_if(F.col("split") == s).cast("bigint").alias(f"n_{s}") for s in ["train", "val", "test"]],
        *[F.count_if((F.col("split") == s) & (y == 1)).cast("bigint").alias(f"fraud_{s}")
          for s in ["train", "val", "test"]])
    a = a.withColumns({
        "weight_0": F.round(F.col("n_train") / (2.0 * (F.col("n_train") - F.col("fraud_train"))), 9),
        "weight_1": F.round(F.col("n_train") / (2.0 * F.col("fraud_train")), 9)})
    sk = features_df.agg(F.round(skew_sample("amount"), digits).alias("skew_before"),
                         F.round(skew_sample(F.log1p("amount")), digits).alias("skew_after"))
    return a.crossJoin(sk)          # two one-row frames


def prep_report_full(prepared, features_df: DataFrame, smoted: DataFrame, label: str = TARGET) -> DataFrame:  # A7 + A8
    """The nested preparation report: split sizes, fraud counts, class weights, feature
    metadata and the skewness before/after log1p (one row; every number an aggregate)."""
    from ..schema import BINARY_COLS, FEATURE_COLS, HIGH_RISK_HOURS, SCALE_COLS, SEED, TRAIN_RATIO, TYPE_COLS
    data = prepared.data
    y = F.col(label)
    n = prepared.sizes                                               # observed while the split was written
    sizes = data.sparkSession.range(1).select(
        *[F.lit(sum(n[s])).cast("bigint").alias(s) for s in ["train", "val", "test"]], F.lit(n["train"][0]).cast("bigint").alias("train_normal"),
        *[F.lit(n[s][1]).cast("bigint").alias(f"f_{s}") for s in ["train", "val", "test"]])
    sm = smoted.agg(F.count(F.lit(1)).cast("bigint").alias("train_smote"),
                    F.sum(y).cast("bigint").alias("f_train_smote"))
    meta = feature_metadata(data, smoted)
    sk = prep_report(data, features_df).select("skew_before", "skew_after")
    row = sizes.crossJoin(sm).crossJoin(meta).crossJoin(sk)          # one-row frames

    def lit_list(xs):
        return F.array(*[F.lit(x) for x in xs])

    return row.select(
        F.struct("train", "val", "test", "train_normal", "train_smote").alias("split_sizes"),
        F.struct(F.col("f_train").alias("train"), F.col("f_val").alias("val"), F.col("f_test").alias("test"),
                 F.col("f_train_smote").alias("train_smote")).alias("fraud_counts"),
        F.create_map(*[x for c, w in sorted(prepared.weights.items())
                       for x in (F.lit(str(c)), F.lit(float(w)))]).alias("class_weights"),
        F.struct(lit_list(FEATURE_COLS).alias("all_features"), lit_list(SCALE_COLS).alias("scale_cols"),
                 lit_list(BINARY_COLS).alias("binary_cols"), lit_list(TYPE_COLS).alias("type_cols"),
                 F.lit(label).alias("target"), F.lit(len(FEATURE_COLS)).alias("n_features"),
                 lit_list(HIGH_RISK_HOURS).alias("high_risk_hours"),
                 (F.col("train") + F.col("val") + F.col("test")).alias("sample_size"),
                 F.lit(SEED).alias("random_state"),
                 F.struct(F.lit(TRAIN_RATIO).alias("train"), F.lit(round((1 - TRAIN_RATIO) / 2, 10)).alias("val"),
                          F.lit(round((1 - TRAIN_RATIO) / 2, 10)).alias("test")).alias("split_ratios"),
                 "n_train_fraud", "n_val_fraud", "n_test_fraud", "imbalance_ratio", "fraud_rate_train_pct", "contamination_rate",
                 F.lit(0.1).alias("smote_ratio"), "n_smote_fraud").alias("features"),
        F.struct("skew_before", "skew_after").alias("log_amount_skew"))


_METRIC_FIELDS = ["threshold", "recall", "precision", "f1", "accuracy", "tp", "fp", "fn", "tn", "roc_auc", "pr_auc"]


def baseline_report(flag_metrics: DataFrame, test_metrics: DataFrame, importances: DataFrame | None) -> DataFrame:  # A11
    """Business-flag baseline, per-model test metrics at the val threshold, best models by
    recall and F1, and the forest's feature importances — one nested row."""
    models = test_metrics.agg(F.sort_array(F.collect_list(F.struct(                 # one row per model
        F.col("model").alias("name"), F.col("threshold").alias("optimal_threshold"),
        F.struct(*_METRIC_FIELDS).alias("test_metrics")))).alias("models"),
        F.max_by("model", F.struct(F.col("recall"), F.col("f1"))).alias("best_model_recall"),
        F.max_by("model", F.struct(F.col("f1"), F.col("recall"))).alias("best_model_f1"))
    flag = flag_metrics.select(F.struct(F.lit("isFlaggedFraud").alias("model"), "recall", "precision", "f1")
                               .alias("baseline_metier"))
    out = flag.crossJoin(models)                                                     # one-row frames
    if importances is not None:
        out = out.crossJoin(importances.agg(F.collect_list(F.struct("feature", "importance"))    # ≤ n features
                                            .alias("feature_importances_rf_balanced")))
    return out


def detector_report(det, normal_err: DataFrame, val_metrics: DataFrame, test_metrics: DataFrame,
                    reference: DataFrame, optimal: float) -> DataFrame:                        # A11
    """Detector size, error statistics of the normal rows, thresholds, val/test metrics and the deltas against a
    reference model's test metrics (``reference``: one metrics row) — one nested row."""
    from ..operators.recon import error_stats_frame
    stats = error_stats_frame(normal_err).select(F.struct("mean", "std", "p95", "p99", "max").alias("train_mse_stats"),
                                                 F.col("p95").alias("p95_normal"), F.col("p99").alias("p99_normal"))
    n = normal_err.agg(F.count(F.lit(1)).alias("n_samples"))
    v = val_metrics.select(F.struct(*_METRIC_FIELDS).alias("val_metrics"))
    t = test_metrics.select(F.struct(*_METRIC_FIELDS).alias("test_metrics"), F.col("model").alias("_m"), F.col("recall").alias("_r"),
                            F.col("f1").alias("_f"), F.col("pr_auc").alias("_p"))
    ref = reference.select(F.col("model").alias("_ref"), F.col("recall").alias("_rr"), F.col("f1").alias("_rf"),
                           F.col("pr_auc").alias("_rp"))
    row = stats.crossJoin(n).crossJoin(v).crossJoin(t).crossJoin(ref)                 # one-row frames
    return row.select(
        F.struct(F.lit(det.k).alias("n_axes"), F.lit(len(det.feature_cols)).alias("n_features")).alias("architecture"),
        F.struct("n_samples", "train_mse_stats").alias("training"),
        F.struct(F.lit(float(optimal)).alias("optimal"), "p95_normal", "p99_normal").alias("threshold"),
        "val_metrics", "test_metrics",
        F.struct(F.col("_ref").alias("model"), F.round(F.col("_r") - F.col("_rr"), 4).alias("recall_delta"),
                 F.round(F.col("_f") - F.col("_rf"), 4).alias("f1_delta"),
                 F.round(F.coalesce(F.col("_p"), F.lit(0.0)) - F.coalesce(F.col("_rp"), F.lit(0.0)), 4)
                 .alias("prauc_delta")).alias("vs_reference"),
        F.when(F.col("_f") < F.col("_rf"), F.col("_ref")).otherwise(F.col("_m")).alias("best_overall"))

