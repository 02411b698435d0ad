"""Evaluation and thresholding on scored rows.

Input is a long table of scored rows (``label``, ``score``, optional group columns such
as ``model``); many models are evaluated in one pass by grouping.  Curves collapse ties
with ``groupBy(score)`` and get running totals from ``ordered.running_totals`` (bucketed
by score range, no single-task window).  Threshold grids bucket each row to the highest
grid index it passes and aggregate per bucket (≤ grid size rows) — no rows × thresholds
expansion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..schema import TARGET
from .ordered import exact_quantiles, join_groups, running_totals


def _lab(label):
    return F.col(label).cast("int")


# --- I1 / I2 -----------------------------------------------------------------
def confusion(df: DataFrame, label: str = TARGET, pred: str = "prediction", by=()) -> DataFrame:
    y, p = _lab(label), F.col(pred).cast("int")
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("tn"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("tp"))


def _rates(tp, fp, fn, tn):
    rec = safe_div(tp, tp + fn)
    prec = safe_div(tp, tp + fp)
    f1 = safe_div(2 * prec * rec, prec + rec)
    acc = safe_div(tp + tn, tp + fp + fn + tn)
    return rec, prec, f1, acc


def score_curve(df: DataFrame, label: str = TARGET, score: str = "score", by=()) -> DataFrame:   # I6
    """One row per (group, distinct score), descending: counts at the score, running tp/fp
    (score ≥ threshold), totals, precision, recall (=tpr) and fpr."""
    by = list(by)
    pts = df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(_lab(label)).cast("bigint").alias("pos"),
        F.sum(1 - _lab(label)).cast("bigint").alias("neg"))
    cur = running_totals(pts, "threshold", ["pos", "neg"], by=by, descending=True, whole="all_")
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return cur.select(
        *by, "threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"), F.col("all_pos").alias("P"), F.col("all_neg").alias("N"),
        safe_div(tp, tp + fp, None).alias("precision"),
        safe_div(tp, F.col("all_pos"), None).alias("recall"),
        safe_div(fp, F.col("all_neg"), None).alias("fpr"))


def auc_scores(curve: DataFrame, by=()) -> DataFrame:                               # I3 / I4 / I5
    """ROC-AUC (ties count half), average precision (step-wise) and trapezoidal PR-AUC
    (with the (R=0, P=1) end point) from a score curve, as plain aggregates."""
    by = list(by)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    tp_prev, fp_prev = tp - pos, fp - neg
    prec = tp / (tp + fp)
    prec_prev = F.when(tp_prev + fp_prev == 0, F.lit(1.0)).otherwise(tp_prev / (tp_prev + fp_prev))
    roc_term = neg * (tp_prev + pos / 2.0)
    ap_term = pos * prec
    trap = (pos / P) * (prec + prec_prev) / 2.0
    agg = curve.groupBy(*by).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(roc_term).alias("_roc"), F.sum(ap_term).alias("_ap"), F.sum(trap).alias("_trap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(
        *by,
        F.when(both, F.col("_roc") / (F.col("P").cast("double") * F.col("N"))).alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("_ap") / F.col("P")).alias("average_precision"),
        F.when(F.col("P") > 0, F.col("_trap")).alias("pr_auc_trapezoid"))


def fraud_metrics(df: DataFrame, threshold: float | str = 0.5, label: str = TARGET,
                  score: str = "score", by=(), model: str | None = None, digits: int = 4,
                  with_auc: bool = True) -> DataFrame:                               # I2
    """recall, precision, f1, accuracy (rounded), tp/fp/fn/tn, roc_auc and pr_auc (AP).

    ``threshold`` is a number or the name of a column carrying a per-group threshold.
    One confusion pass + one curve per group; AUCs are null for a one-class group.
    """
    by = list(by)
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    pred = (F.col(score) >= t).cast("int")
    y = _lab(label)
    conf = df.groupBy(*by).agg(
        F.count_if((y == 1) & (pred == 1)).cast("bigint").alias("tp"),
        F.count_if((y == 0) & (pred == 1)).cast("bigint").alias("fp"),
        F.count_if((y == 1) & (pred == 0)).cast("bigint").alias("fn"),
        F.count_if((y == 0) & (pred == 0)).cast("bigint").alias("tn"),
        F.first(t).alias("threshold"))
    rec, prec, f1, acc = _rates(*(F.col(c) for c in ["tp", "fp", "fn", "tn"]))
    out = conf.select(*by, "threshold",
                      F.round(rec, digits).alias("recall"), F.round(prec, digits).alias("precision"),
                      F.round(f1, digits).alias("f1"), F.round(acc, digits).alias("accuracy"),
                      "tp", "fp", "fn", "tn")
    if with_auc:
        a = auc_scores(score_curve(df, label, score, by), by).select(
            *by, F.round("roc_auc", digits).alias("roc_auc"),
            F.round("average_precision", digits).alias("pr_auc"))
        out = join_groups(out, a, by)
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out


# --- I7 ----------------------------------------------------------------------
def optimal_threshold(df: DataFrame, label: str = TARGET, score: str = "score", by=(),
                      metric: str = "fbeta", beta: float = 2.0) -> DataFrame:
    """Threshold on the PR curve maximising F1 or F-beta; ties → the lowest threshold."""
    by = list(by)
    cur = score_curve(df, label, score, by)
    p, r = F.coalesce(F.col("precision"), F.lit(0.0)), F.coalesce(F.col("recall"), F.lit(0.0))
    if metric == "f1":
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    else:
        b2 = float(beta) ** 2
        f = F.when(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))
    scored = cur.withColumn("f", f)
    best = scored.groupBy(*by).agg(F.max_by(F.struct("threshold", "f"),
                                            F.struct(F.col("f"), -F.col("threshold"))).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.f").alias("score"))


# --- I8 / I9 grids -------------------------------------------------------------
def linspace(start: float, stop: float, num: int) -> list[float]:
    """Grid values exactly as NumPy's ``linspace`` computes them."""
    return [float(x) for x in np.linspace(start, stop, num)]


def grid_counts(df: DataFrame, grid: list[float], label: str = TARGET, score: str = "score",
                by=()) -> DataFrame:
    """tp/fp/fn/tn at each grid threshold (pred = score ≥ t) via per-bucket suffix sums.

    Each row is bucketed to the highest grid index it passes (-1 = none): an arithmetic
    estimate corrected by two exact comparisons against the literal grid.
    """
    by = list(by)
    g = F.array(*[F.lit(x) for x in grid])
    n = len(grid)
    s = F.col(score).cast("double")
    lo, hi = grid[0], grid[-1]
    step = (hi - lo) / (n - 1) if n > 1 and hi > lo else 1.0
    est = F.least(F.greatest(F.floor((s - F.lit(lo)) / F.lit(step)), F.lit(-1)), F.lit(n - 1)).cast("int")

    def t_at(i):
        return F.element_at(g, i + 1)

    up = F.when((est + 1 < n) & (t_at(est + 1) <= s), est + 1).otherwise(est)
    idx = F.when(up < 0, F.when(t_at(F.lit(0)) <= s, F.lit(0)).otherwise(F.lit(-1))) \
        .when(t_at(up) > s, up - 1).otherwise(up)
    if not hi > lo:                      # degenerate grid: every value equal
        idx = F.when(s >= F.lit(lo), F.lit(n - 1)).otherwise(F.lit(-1))
    idx = F.when(s.isNull(), F.lit(-1)).otherwise(idx)
    per = df.groupBy(*by, idx.alias("i")).agg(F.sum(_lab(label)).alias("pos"),
                                              F.sum(1 - _lab(label)).alias("neg"))
    grid_df = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(grid)], "i int, threshold double")
    tot = per.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # dense grid per group: grid (≤ a few hundred rows) × groups (a handful), both bounded
    full = grid_df.crossJoin(tot)
    dense = full.join(per, [*by, "i"], "left")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))) \
        .orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)   # ≤ len(grid) rows
    tp = F.sum(F.coalesce(F.col("pos"), F.lit(0))).over(w).cast("bigint")
    fp = F.sum(F.coalesce(F.col("neg"), F.lit(0))).over(w).cast("bigint")
    out = dense.select(*by, "i", "threshold", "P", "N", tp.alias("tp"), fp.alias("fp"))
    return out.select(*by, "i", "threshold", "tp", "fp",
                      (F.col("P") - F.col("tp")).cast("bigint").alias("fn"),
                      (F.col("N") - F.col("fp")).cast("bigint").alias("tn"))


def threshold_sweep(df: DataFrame, label: str = TARGET, score: str = "score", by=(),
                    start: float = 0.01, stop: float = 0.99, num: int = 200, digits: int = 6) -> DataFrame:  # I9
    by = list(by)
    c = grid_counts(df, linspace(start, stop, num), label, score, by)
    rec, prec, f1, _ = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    c = c.withColumns({"recall": rec, "precision": prec, "f1": f1})
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))   # ≤ num rows per group
    best_i = F.min(F.when(F.col("f1") == F.max("f1").over(w), F.col("i"))).over(w)
    return c.select(*by, "i", F.round("threshold", digits).alias("threshold"),
                    F.round("recall", digits).alias("recall"), F.round("precision", digits).alias("precision"),
                    F.round("f1", digits).alias("f1"), (F.col("i") == best_i).alias("is_best"))


def grid_threshold(df: DataFrame, label: str = TARGET, score: str = "error", metric: str = "f1",
                   n_thresholds: int = 200, lo_pct: float = 50.0, hi_pct: float = 99.9) -> DataFrame:  # I8
    """Grid of ``n_thresholds`` values between two exact percentiles of the scores;
    maximise F1 (or recall) with pred = score ≥ t; strict improvement, so the lowest wins."""
    q = exact_quantiles(df, [score], [lo_pct / 100.0, hi_pct / 100.0]).orderBy("qi").collect()
    t_min, t_max = q[0]["quantile"], q[1]["quantile"]
    grid = linspace(t_min, t_max, n_thresholds)
    c = grid_counts(df, grid, label, score)
    rec, prec, f1, _ = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    m = rec if metric == "recall" else f1
    c = c.withColumn("m", m)
    best = c.agg(F.max_by(F.struct("i", "threshold", "m"), F.struct(F.col("m"), -F.col("i"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), F.col("b.m").alias("score"),
                       F.lit(t_min).alias("t_min"), F.lit(t_max).alias("t_max"))


# --- I10-I12, I14 ------------------------------------------------------------
def percentile_thresholds(df: DataFrame, score: str = "error", probs=(0.95, 0.99)) -> DataFrame:   # I10
    q = exact_quantiles(df, [score], list(probs))
    return q.select(F.col("prob"), F.col("quantile").alias("threshold"))


def error_stats_by_group(df: DataFrame, score: str = "error", by=("split", TARGET),
                         digits: int = 6) -> DataFrame:                               # I11
    by = list(by)
    a = df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
                            F.max(score).alias("max"), F.count(score).cast("bigint").alias("n"))
    p = exact_quantiles(df, [score], [0.95], by=by).select(*by, F.col("quantile").alias("p95"))
    return join_groups(a, p, by).select(*by, "n", F.round("mean", digits).alias("mean"),
                                        F.round("std", digits).alias("std"),
                                        F.round("p95", digits).alias("p95"), F.round("max", digits).alias("max"))


def separability_ratio(df: DataFrame, score: str = "error", label: str = TARGET,
                       digits: int = 6) -> DataFrame:                                 # I12
    a = df.agg(F.avg(F.when(_lab(label) == 1, F.col(score))).alias("f"),
               F.avg(F.when(_lab(label) == 0, F.col(score))).alias("l"))
    return a.select(F.round("f", digits).alias("mean_fraud"), F.round("l", digits).alias("mean_legit"),
                    F.round(F.try_divide(F.col("f"), F.col("l")), digits).alias("ratio"))


def beats_baseline(metrics: DataFrame, baseline_recall: float, baseline_f1: float) -> DataFrame:  # I14
    return metrics.withColumns({
        "beats_recall": F.col("recall") > F.lit(float(baseline_recall)),
        "beats_f1": F.col("f1") > F.lit(float(baseline_f1))})


def delta_vs_model(metrics: DataFrame, reference_model: str) -> DataFrame:          # I13
    """recall/F1/PR-AUC of each model minus those of ``reference_model`` (1-row join)."""
    ref = metrics.filter(F.col("model") == reference_model).select(
        F.col("recall").alias("_r"), F.col("f1").alias("_f"), F.col("pr_auc").alias("_p")).limit(1)
    j = metrics.crossJoin(F.broadcast(ref))    # ref is at most one row
    return j.select("model", "recall", "f1", "pr_auc",
                    (F.col("recall") - F.col("_r")).alias("delta_recall"),
                    (F.col("f1") - F.col("_f")).alias("delta_f1"),
                    (F.coalesce(F.col("pr_auc"), F.lit(0.0)) - F.coalesce(F.col("_p"), F.lit(0.0)))
                    .alias("delta_pr_auc"))


# --- I15 ---------------------------------------------------------------------
def test_at_val_threshold(scored: DataFrame, label: str = TARGET, score: str = "score",
                          model: str = "model", split: str = "split", metric: str = "fbeta",
                          beta: float = 2.0, digits: int = 4) -> DataFrame:
    """Per model: threshold chosen on val rows (I7), metrics on test rows."""
    val = scored.filter(F.col(split) == "val")
    test = scored.filter(F.col(split) == "test")
    t = optimal_threshold(val, label, score, [model], metric, beta) \
        .select(model, F.col("threshold").alias("t_opt"))
    test_t = test.join(F.broadcast(t), [model])          # one row per model
    return fraud_metrics(test_t, "t_opt", label, score, [model], digits=digits)
