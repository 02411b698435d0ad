"""Registered queries: evaluation and thresholding (I1-I15, J6) on scored rows.

The scores are deterministic functions of each transaction (no fitted model), so DuckDB
can compute the same numbers; model scores go through the same operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import sampling as SA
from ..session import cut_lineage
from .inputs import feat
from .oracle_base import with_split
from .registry import register


def scored_long(spark, sf, splits=None):
    """(txn_id, split, isFraud, model, score) for three rule scores on the split rows."""
    df = SA.stratified_split(feat(spark, sf))
    if splits:
        df = df.filter(F.col("split").isin(list(splits)))        # only what is read again goes to the checkpoint
    scores = {
        "amount_score": F.col("amount") / (F.col("amount") + F.lit(1000.0)),
        "risk_score": (F.col("high_risk_hour") + F.col("is_transfer_or_cashout")
                       + F.col("dest_zero_balance")) / F.lit(3.0),
        "diff_score": F.lit(0.5) + F.col("balance_diff_orig")
        / (F.abs(F.col("balance_diff_orig")) + F.lit(1000.0)) / F.lit(2.0),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("model"), v.cast("double").alias("score"))
                    for k, v in scores.items()])
    out = df.select("txn_id", "split", "isFraud", F.explode(arr).alias("m")) \
        .select("txn_id", "split", "isFraud", "m.model", "m.score")
    # val and test curves, thresholds and metrics all reuse the scored split: materialise
    # it once in the checkpoint folder instead of re-deriving the split in every job
    return cut_lineage(out)


SCORED_CTE = """
sc_base AS (SELECT f.*, r.split FROM features f JOIN split_rows r ON f.txn_id = r.txn_id),
scored AS (
  SELECT txn_id, split, isFraud, 'amount_score' AS model, amount / (amount + CAST(1000 AS DOUBLE)) AS score FROM sc_base
  UNION ALL
  SELECT txn_id, split, isFraud, 'risk_score', (high_risk_hour + is_transfer_or_cashout + dest_zero_balance)
         / CAST(3 AS DOUBLE) FROM sc_base
  UNION ALL
  SELECT txn_id, split, isFraud, 'diff_score', CAST(0.5 AS DOUBLE) + balance_diff_orig
         / (abs(balance_diff_orig) + CAST(1000 AS DOUBLE)) / CAST(2 AS DOUBLE) FROM sc_base),
curve AS (
  SELECT model, threshold, pos, neg,
         sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
  FROM (SELECT model, score AS threshold, sum(isFraud) AS pos, sum(1 - isFraud) AS neg
        FROM scored WHERE split = 'val' GROUP BY model, score))
"""


def _val(spark, sf):
    return scored_long(spark, sf, ["val"])


@register("confusion", with_split(
    """SELECT model, CAST(count_if(isFraud = 0 AND score < 0.5) AS BIGINT) AS tn,
       CAST(count_if(isFraud = 0 AND score >= 0.5) AS BIGINT) AS fp,
       CAST(count_if(isFraud = 1 AND score < 0.5) AS BIGINT) AS fn,
       CAST(count_if(isFraud = 1 AND score >= 0.5) AS BIGINT) AS tp
FROM scored WHERE split = 'test' GROUP BY model""", SCORED_CTE))
def q_confusion(spark, sf):                               # I1 / B23
    df = scored_long(spark, sf, ["test"]) \
        .withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return EV.confusion(df, by=["model"])


@register("score_curve", with_split(
    """SELECT model, round(threshold, 9) AS threshold, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall, round(fp / N, 6) AS fpr
FROM curve""", SCORED_CTE))
def q_score_curve(spark, sf):                             # I6
    c = EV.score_curve(_val(spark, sf), by=["model"])
    return c.select("model", F.round("threshold", 9).alias("threshold"), "pos", "neg", "tp", "fp",
                    F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    F.round("fpr", 6).alias("fpr"))


@register("auc_scores", with_split(
    """SELECT model,
       round(sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)), 6) AS roc_auc,
       round(sum(pos * (tp / (tp + fp))) / max(P), 6) AS average_precision,
       round(sum((pos / CAST(P AS DOUBLE)) * ((tp / (tp + fp)) +
             CASE WHEN (tp - pos) + (fp - neg) = 0 THEN CAST(1 AS DOUBLE)
                  ELSE (tp - pos) / ((tp - pos) + (fp - neg)) END) / 2.0), 6) AS pr_auc_trapezoid
FROM curve GROUP BY model""", SCORED_CTE))
def q_auc_scores(spark, sf):                              # I3 / I4 / I5
    a = EV.auc_scores(EV.score_curve(_val(spark, sf), by=["model"]), by=["model"])
    return a.select("model", *[F.round(c, 6).alias(c) for c in ["roc_auc", "average_precision",
                                                                "pr_auc_trapezoid"]])


_METRICS_SQL = """
SELECT m.model, CAST(0.5 AS DOUBLE) AS threshold,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
             ELSE 0 END, 4) AS f1,
       round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, tp, fp, fn, tn,
       round(a.roc, 4) AS roc_auc, round(a.ap, 4) AS pr_auc
FROM (SELECT model, CAST(count_if(isFraud = 1 AND score >= 0.5) AS BIGINT) AS tp,
             CAST(count_if(isFraud = 0 AND score >= 0.5) AS BIGINT) AS fp,
             CAST(count_if(isFraud = 1 AND score < 0.5) AS BIGINT) AS fn,
             CAST(count_if(isFraud = 0 AND score < 0.5) AS BIGINT) AS tn
      FROM scored WHERE split = 'val' GROUP BY model) m
JOIN (SELECT model, sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) AS roc,
             sum(pos * (tp / (tp + fp))) / max(P) AS ap FROM curve GROUP BY model) a ON m.model = a.model
"""


@register("fraud_metrics", with_split(_METRICS_SQL, SCORED_CTE))
def q_fraud_metrics(spark, sf):                           # I2
    return EV.fraud_metrics(_val(spark, sf), 0.5, by=["model"])


def _opt_sql(metric):
    f = ("CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END" if metric == "f1" else
         "CASE WHEN 4.0 * p + r > 0 THEN 5.0 * p * r / (4.0 * p + r) ELSE CAST(0 AS DOUBLE) END")
    return with_split(f"""SELECT model, round(threshold, 9) AS threshold, round(f, 6) AS score FROM (
  SELECT model, threshold, f, row_number() OVER (PARTITION BY model ORDER BY f DESC, threshold ASC) AS rk
  FROM (SELECT model, threshold, {f} AS f FROM
        (SELECT model, threshold, tp / (tp + fp) AS p, tp / P AS r FROM curve)))
WHERE rk = 1""", SCORED_CTE)


@register("optimal_threshold", _opt_sql("fbeta"))
def q_optimal_threshold(spark, sf):                       # I7 (F2 default)
    o = EV.optimal_threshold(_val(spark, sf), by=["model"])
    return o.select("model", F.round("threshold", 9).alias("threshold"), F.round("score", 6).alias("score"))


@register("optimal_threshold_f1", _opt_sql("f1"))
def q_optimal_threshold_f1(spark, sf):                    # I7 (F1)
    o = EV.optimal_threshold(_val(spark, sf), by=["model"], metric="f1")
    return o.select("model", F.round("threshold", 9).alias("threshold"), F.round("score", 6).alias("score"))


_GRID_CTE = SCORED_CTE.strip() + """,
grid AS (SELECT i, CASE WHEN i = 199 THEN CAST(0.99 AS DOUBLE)
                ELSE i * ((CAST(0.99 AS DOUBLE) - CAST(0.01 AS DOUBLE)) / 199) + CAST(0.01 AS DOUBLE) END AS t
         FROM range(200) r(i)),
sweep AS (
  SELECT s.model, g.i, g.t,
         count_if(s.isFraud = 1 AND s.score >= g.t) AS tp, count_if(s.isFraud = 0 AND s.score >= g.t) AS fp,
         count_if(s.isFraud = 1 AND s.score < g.t) AS fn
  FROM (SELECT * FROM scored WHERE split = 'val') s, grid g GROUP BY s.model, g.i, g.t),
sweep2 AS (
  SELECT model, i, t, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS rec,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS prec FROM sweep),
sweep3 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE CAST(0 AS DOUBLE) END AS f1
           FROM sweep2)
"""


@register("threshold_sweep", with_split(
    """SELECT model, CAST(i AS INTEGER) AS i, round(t, 6) AS threshold, round(rec, 6) AS recall,
       round(prec, 6) AS precision, round(f1, 6) AS f1,
       i = min(CASE WHEN f1 = mx THEN i END) OVER (PARTITION BY model) AS is_best
FROM (SELECT *, max(f1) OVER (PARTITION BY model) AS mx FROM sweep3)""", _GRID_CTE))
def q_threshold_sweep(spark, sf):                         # I9
    return EV.threshold_sweep(_val(spark, sf), by=["model"])


_AMT_CTE = SCORED_CTE.strip() + """,
v AS (SELECT isFraud, score FROM scored WHERE split = 'val' AND model = 'amount_score'),
bounds AS (SELECT quantile_cont(score, 0.5) AS lo, quantile_cont(score, 0.999) AS hi FROM v),
g2 AS (SELECT i, CASE WHEN i = 199 THEN hi ELSE i * ((hi - lo) / 199) + lo END AS t FROM range(200) r(i), bounds),
s2 AS (SELECT g2.i, g2.t, count_if(v.isFraud = 1 AND v.score >= g2.t) AS tp,
              count_if(v.isFraud = 0 AND v.score >= g2.t) AS fp, count_if(v.isFraud = 1 AND v.score < g2.t) AS fn
       FROM v, g2 GROUP BY g2.i, g2.t),
s3 AS (SELECT i, t, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS rec,
              CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS prec FROM s2),
s4 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE CAST(0 AS DOUBLE) END AS f1 FROM s3)
"""


@register("grid_threshold", with_split(
    """SELECT round(t, 9) AS threshold, round(f1, 6) AS score, round(lo, 9) AS t_min, round(hi, 9) AS t_max
FROM (SELECT t, f1, row_number() OVER (ORDER BY f1 DESC, i ASC) AS rk FROM s4), bounds WHERE rk = 1""", _AMT_CTE))
def q_grid_threshold(spark, sf):                          # I8
    v = _val(spark, sf).filter(F.col("model") == "amount_score")
    g = EV.grid_threshold(v, score="score")
    return g.select(F.round("threshold", 9).alias("threshold"), F.round("score", 6).alias("score"),
                    F.round("t_min", 9).alias("t_min"), F.round("t_max", 9).alias("t_max"))


@register("percentile_thresholds", with_split(
    """SELECT CAST(0.95 AS DOUBLE) AS prob, round(quantile_cont(score, 0.95), 9) AS threshold FROM n
UNION ALL SELECT CAST(0.99 AS DOUBLE), round(quantile_cont(score, 0.99), 9) FROM n""",
    SCORED_CTE.strip() + """,
n AS (SELECT score FROM scored WHERE split = 'train' AND isFraud = 0 AND model = 'amount_score')"""))
def q_percentile_thresholds(spark, sf):                   # I10
    n = scored_long(spark, sf, ["train"]).filter((F.col("split") == "train") & (F.col("isFraud") == 0)
                                      & (F.col("model") == "amount_score"))
    return EV.percentile_thresholds(n, "score").select("prob", F.round("threshold", 9).alias("threshold"))


@register("error_stats_by_group", with_split(
    """SELECT split, isFraud, CAST(count(score) AS BIGINT) AS n, round(avg(score), 6) AS mean,
       round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS max
FROM scored WHERE model = 'amount_score' GROUP BY split, isFraud""", SCORED_CTE))
def q_error_stats(spark, sf):                             # I11
    s = scored_long(spark, sf).filter(F.col("model") == "amount_score")
    return EV.error_stats_by_group(s, "score")


@register("separability_ratio", with_split(
    """SELECT round(f, 6) AS mean_fraud, round(l, 6) AS mean_legit, round(f / l, 6) AS ratio FROM
(SELECT avg(CASE WHEN isFraud = 1 THEN score END) AS f, avg(CASE WHEN isFraud = 0 THEN score END) AS l
 FROM scored WHERE split = 'val' AND model = 'amount_score')""", SCORED_CTE))
def q_separability(spark, sf):                            # I12
    return EV.separability_ratio(_val(spark, sf).filter(F.col("model") == "amount_score"), "score")


@register("beats_baseline", with_split(
    """SELECT model, recall, f1, recall > 0.003876 AS beats_recall, f1 > 0.007722 AS beats_f1
FROM (""" + _METRICS_SQL + ")", SCORED_CTE))
def q_beats_baseline(spark, sf):                          # I14 (published flag baseline)
    m = EV.fraud_metrics(_val(spark, sf), 0.5, by=["model"])
    return EV.beats_baseline(m, 0.003876, 0.007722).select("model", "recall", "f1", "beats_recall", "beats_f1")


_AT_VAL = """SELECT m.model, m.t AS threshold,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
             ELSE 0 END, 4) AS f1,
       round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, tp, fp, fn, tn,
       round(a.roc, 4) AS roc_auc, round(a.ap, 4) AS pr_auc
FROM (SELECT s.model, o.t, CAST(count_if(isFraud = 1 AND score >= o.t) AS BIGINT) AS tp,
             CAST(count_if(isFraud = 0 AND score >= o.t) AS BIGINT) AS fp,
             CAST(count_if(isFraud = 1 AND score < o.t) AS BIGINT) AS fn,
             CAST(count_if(isFraud = 0 AND score < o.t) AS BIGINT) AS tn
      FROM scored s JOIN opt o ON s.model = o.model WHERE s.split = 'test' GROUP BY s.model, o.t) m
JOIN (SELECT model, sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(N)) AS roc,
             sum(pos * (tp / (tp + fp))) / max(P) AS ap FROM tcurve GROUP BY model) a ON m.model = a.model"""
_AT_VAL_CTE = SCORED_CTE.strip() + """,
opt AS (SELECT model, threshold AS t FROM (
  SELECT model, threshold, row_number() OVER (PARTITION BY model ORDER BY f DESC, threshold ASC) AS rk
  FROM (SELECT model, threshold,
               CASE WHEN 4.0 * p + r > 0 THEN 5.0 * p * r / (4.0 * p + r) ELSE CAST(0 AS DOUBLE) END AS f
        FROM (SELECT model, threshold, tp / (tp + fp) AS p, tp / P AS r FROM curve))) WHERE rk = 1),
tcurve AS (
  SELECT model, threshold, pos, neg,
         sum(pos) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (PARTITION BY model ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
  FROM (SELECT model, score AS threshold, sum(isFraud) AS pos, sum(1 - isFraud) AS neg
        FROM scored WHERE split = 'test' GROUP BY model, score))"""


@register("test_at_val_threshold", with_split(_AT_VAL, _AT_VAL_CTE))
def q_test_at_val(spark, sf):                             # I15
    return EV.test_at_val_threshold(scored_long(spark, sf, ["val", "test"]))


@register("baseline_report", with_split(
    """SELECT (SELECT round(CASE WHEN tf > 0 THEN tp / tf ELSE 0 END, 6) FROM fl) AS flag_recall, (SELECT round(CASE WHEN ft > 0 THEN tp / ft ELSE 0 END, 6) FROM fl) AS flag_precision,
       CAST(count(*) AS INTEGER) AS n_models, max_by(model, {'r': recall, 'f': f1}) AS best_model_recall, max_by(model, {'f': f1, 'r': recall}) AS best_model_f1,
       string_agg(model || ' ' || CAST(tp AS VARCHAR) || ' ' || CAST(fp AS VARCHAR) || ' ' || CAST(fn AS VARCHAR) || ' ' || CAST(tn AS VARCHAR), ';' ORDER BY model) AS confusions,
       round(sum(threshold), 6) AS thresholds, CAST(14 AS INTEGER) AS n_importances
FROM (""" + _AT_VAL + ")", _AT_VAL_CTE + """,
fl AS (SELECT count_if(isFlaggedFraud = 1 AND isFraud = 1) AS tp, sum(isFraud) AS tf, sum(isFlaggedFraud) AS ft FROM transactions)"""))
def q_baseline_report(spark, sf):                         # A11: the nested report written as JSON and read back; the numbers of its models flattened
    import uuid

    from ..operators import models as M
    from ..operators import prepare as P
    from ..operators.stats import flag_baseline_metrics
    from ..schema import FEATURE_COLS
    from ..session import ensure_checkpoint_dir
    from ..sources import io as IO
    from .inputs import feat, tx
    from .reports import baseline_report
    p = P.prepare(feat(spark, sf))
    forest = M.fit_forest(P.with_weight(p.split("train"), p.weights), n_trees=20)
    report = baseline_report(flag_baseline_metrics(tx(spark, sf)), EV.test_at_val_threshold(scored_long(spark, sf, ["val", "test"])), M.feature_importances(forest, FEATURE_COLS))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-baseline-{uuid.uuid4().hex[:8]}"
    IO.write_json_row(report, path)
    row = spark.read.schema(report.schema).json(path)
    text = lambda m: F.concat_ws(" ", m["name"], *[m["test_metrics"][c].cast("string") for c in ("tp", "fp", "fn", "tn")])
    return row.select(
        F.col("baseline_metier.recall").alias("flag_recall"), F.col("baseline_metier.precision").alias("flag_precision"), F.size("models").alias("n_models"),
        "best_model_recall", "best_model_f1", F.array_join(F.transform("models", text), ";").alias("confusions"),
        F.round(F.aggregate("models", F.lit(0.0), lambda a, m: a + m["optimal_threshold"]), 6).alias("thresholds"),
        F.size("feature_importances_rf_balanced").alias("n_importances"))


@register("chance_line", with_split(
    "SELECT model, round(avg(isFraud), 8) AS chance_rate FROM scored WHERE split = 'val' GROUP BY model",
    SCORED_CTE))
def q_chance_line(spark, sf):                             # J6
    return _val(spark, sf).groupBy("model").agg(F.round(F.avg("isFraud"), 8).alias("chance_rate"))


def _rule_metrics(spark, sf):
    return EV.fraud_metrics(_val(spark, sf), 0.5, by=["model"])


@register("metrics_union", with_split(_METRICS_SQL, SCORED_CTE))
def q_metrics_union(spark, sf):                           # E4: one metrics row per model, unioned
    from ..operators.relations import metrics_union
    v = _val(spark, sf)
    parts = [EV.fraud_metrics(v.filter(F.col("model") == m), 0.5, model=m)
             for m in ["amount_score", "risk_score", "diff_score"]]
    return metrics_union(*parts)


@register("rank_models", with_split(
    "SELECT model, recall, precision, f1 FROM (" + _METRICS_SQL + ")", SCORED_CTE))
def q_rank_models(spark, sf):                             # E6
    from ..operators.relations import rank_models
    return rank_models(_rule_metrics(spark, sf)).select("model", "recall", "precision", "f1")


@register("best_model", with_split(
    "SELECT model, f1 FROM (" + _METRICS_SQL + ") ORDER BY f1 DESC, model LIMIT 1", SCORED_CTE))
def q_best_model(spark, sf):                              # E7
    from ..operators.relations import best_model
    return best_model(_rule_metrics(spark, sf)).select("model", "f1")


@register("delta_vs_model", with_split(
    """SELECT m.model, m.recall, m.f1, m.pr_auc, m.recall - r.recall AS delta_recall, m.f1 - r.f1 AS delta_f1,
       coalesce(m.pr_auc, 0) - coalesce(r.pr_auc, 0) AS delta_pr_auc
FROM (""" + _METRICS_SQL + """) m, (SELECT * FROM (""" + _METRICS_SQL + """) WHERE model = 'amount_score') r""",
    SCORED_CTE))
def q_delta_vs_model(spark, sf):                          # I13
    return EV.delta_vs_model(_rule_metrics(spark, sf), "amount_score")
