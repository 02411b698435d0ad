"""Registered queries: sources, sinks and reports.

Sinks write to a fresh folder under the session's checkpoint directory and return the
read-back DataFrame (rows-only checks); report numbers have DuckDB oracles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..schema import RAW_SCHEMA
from ..sources import io as IO
from ..session import ensure_checkpoint_dir
from .inputs import feat, tx
from .oracle_base import with_split, with_tx
from .q_stats import _TX_NUM, _corr_rank_sql, _describe_sql
from .q_evaluate import _METRICS_SQL as METRICS_SQL, SCORED_CTE
from .registry import register
from .reports import eda_numbers, eda_report, feature_metadata, prep_report, prep_report_full


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{name}-{uuid.uuid4().hex[:8]}"


_ALL = ["txn_id", *[f.name for f in RAW_SCHEMA]]
_ALL_SQL = f"SELECT {', '.join(_ALL)} FROM transactions"


@register("csv_roundtrip", with_tx(_ALL_SQL))
def q_csv_roundtrip(spark, sf):                           # A1 + A2 + A4 + A10 (semicolon CSV, padded names, all columns)
    path = _scratch(spark, "csv")
    df = tx(spark, sf).select(F.col("txn_id").alias(" txn_id "), *_ALL[1:])
    df.write.option("header", True).option("sep", ";").csv(path)
    return IO.read_delimited(spark, path).select(*_ALL)


@register("parquet_roundtrip", with_tx(_ALL_SQL))
def q_parquet_roundtrip(spark, sf):                       # A2 parquet dispatch
    path = _scratch(spark, "pq") + ".parquet"
    tx(spark, sf).select(*_ALL).write.parquet(path)
    return IO.load_table(spark, path)


@register("json_roundtrip", with_tx(_ALL_SQL))
def q_json_roundtrip(spark, sf):                          # A2 json dispatch
    path = _scratch(spark, "js") + ".json"
    df = tx(spark, sf).select(*_ALL)
    df.write.json(path)
    return IO.load_table(spark, path, df.schema)


@register("write_splits", with_split(
    "SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds FROM split_rows GROUP BY split"))
def q_write_splits(spark, sf):                            # A6 + A12
    out = _scratch(spark, "splits")
    p = P.prepare(feat(spark, sf))
    IO.write_splits(p.data, out)
    back = IO.load_prepared(spark, out)
    return back.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                     F.sum("isFraud").cast("bigint").alias("frauds"))


@register("feature_metadata", with_split(
    """SELECT CAST(count_if(split = 'train' AND isFraud = 1) AS BIGINT) AS n_train_fraud,
       CAST(count_if(split = 'val' AND isFraud = 1) AS BIGINT) AS n_val_fraud,
       CAST(count_if(split = 'test' AND isFraud = 1) AS BIGINT) AS n_test_fraud,
       CAST(floor(count_if(split = 'train' AND isFraud = 0) / count_if(split = 'train' AND isFraud = 1)) AS BIGINT)
         AS imbalance_ratio,
       round(count_if(split = 'train' AND isFraud = 1) * 100.0 / count_if(split = 'train'), 6) AS fraud_rate_train_pct,
       round(count_if(split = 'train' AND isFraud = 1) / count_if(split = 'train'), 9) AS contamination_rate
FROM split_rows"""))
def q_feature_metadata(spark, sf):                        # A7 (numbers)
    return feature_metadata(P.prepare(feat(spark, sf)).data).withColumn("contamination_rate", F.round("contamination_rate", 9))


@register("eda_report")
def q_eda_report(spark, sf):                              # A9 nested row (numbers: eda_numbers)
    return eda_report(tx(spark, sf), feat(spark, sf))


@register("eda_numbers", with_tx(
    """SELECT CAST(count(*) AS BIGINT) AS sample_size, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       CAST(count_if(isFraud = 0) AS BIGINT) AS non_fraud_count, round(avg(isFraud) * 100, 6) AS fraud_rate_pct,
       round(count_if(isFraud = 0) / sum(isFraud), 1) AS imbalance_ratio,
       (SELECT tp FROM fl) AS flag_tp, (SELECT fn FROM fl) AS flag_fn, (SELECT fp FROM fl) AS flag_fp,
       (SELECT round(r, 6) FROM fl) AS flag_recall, (SELECT round(p, 6) FROM fl) AS flag_precision,
       (SELECT round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) FROM fl) AS flag_f1,
       (SELECT list(CAST(hour AS INTEGER) ORDER BY hour) FROM hr) AS high_risk_hours,
       (SELECT round(coalesce(avg(CASE WHEN hour IN (SELECT hour FROM hr) THEN isFraud END) * 100, 0), 6) FROM features)
         AS fraud_rate_high_risk_pct,
       (SELECT round(coalesce(avg(CASE WHEN hour NOT IN (SELECT hour FROM hr) THEN isFraud END) * 100, 0), 6)
        FROM features) AS fraud_rate_normal_pct,
       (SELECT CAST(count(*) AS BIGINT) FROM fd) AS n_fraud_dest_accounts,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT acct FROM fd INTERSECT SELECT nameOrig FROM transactions
                                              WHERE type = 'CASH_OUT')) AS n_dest_also_cashout,
       (SELECT round((SELECT count(*) FROM (SELECT acct FROM fd INTERSECT SELECT nameOrig FROM transactions
                                            WHERE type = 'CASH_OUT')) * 100.0 / count(*), 1) FROM fd)
         AS pct_dest_also_cashout
FROM transactions""",
    """fl AS (SELECT CAST(count_if(isFlaggedFraud = 1 AND isFraud = 1) AS BIGINT) AS tp,
              CAST(count_if(isFlaggedFraud = 0 AND isFraud = 1) AS BIGINT) AS fn,
              CAST(count_if(isFlaggedFraud = 1 AND isFraud = 0) AS BIGINT) AS fp,
              CASE WHEN sum(isFraud) > 0 THEN count_if(isFlaggedFraud = 1 AND isFraud = 1) / sum(isFraud) ELSE 0 END AS r,
              CASE WHEN sum(isFlaggedFraud) > 0 THEN count_if(isFlaggedFraud = 1 AND isFraud = 1) / sum(isFlaggedFraud)
                   ELSE 0 END AS p
       FROM transactions),
hr AS (SELECT hour FROM (SELECT hour, avg(isFraud) AS fr FROM features GROUP BY hour)
       WHERE fr > (SELECT avg(isFraud) FROM features)),
fd AS (SELECT DISTINCT nameDest AS acct FROM transactions WHERE isFraud = 1 AND nameDest IS NOT NULL)"""))
def q_eda_numbers(spark, sf):                             # A9 numbers
    return eda_numbers(tx(spark, sf), feat(spark, sf))


@register("write_scores", with_split("SELECT txn_id, split, round(log_amount, 6) + CAST(0 AS DOUBLE) AS score FROM scaled"))
def q_write_scores(spark, sf):                            # A14 + A13 params round trip
    out = _scratch(spark, "scores")
    p = P.prepare(feat(spark, sf))
    scored = p.data.withColumn("score", F.col("log_amount"))
    IO.write_scores(scored, out)
    IO.save_params(spark, {"scaler": p.scaler, "weights": {str(k): v for k, v in p.weights.items()}},
                   out + "-params")
    assert IO.load_params(spark, out + "-params")["weights"]
    return spark.read.parquet(out).select("txn_id", "split", F.round("score", 6).alias("score"))


@register("bucketed_scores", with_split(
    """SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds, round(avg(log_amount), 6) + CAST(0 AS DOUBLE) AS mean_score,
       CAST(count(*) FILTER (split = 'train' AND isFraud = 0) AS BIGINT) AS normal_rows FROM scaled GROUP BY split"""))
def q_bucketed_scores(spark, sf):                         # A6 + A12 + A14: bucketed sets, rewritten in part, joined without an exchange
    at = _scratch(spark, "bucketed")
    name = f"riskloom_{uuid.uuid4().hex}"
    p = P.prepare(feat(spark, sf))
    IO.write_bucketed(p.data, f"{name}_rows", f"{at}/rows")
    IO.write_bucketed(p.data.select("txn_id", F.col("log_amount").alias("score")), f"{name}_scores", f"{at}/scores")
    IO.write_splits(p.data, at)
    IO.write_splits(p.split("val"), at)                   # a rerun of one split leaves the others as they are
    IO.write_train_normal(p.data, at)
    rows = IO.load_prepared(spark, at).groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.sum("isFraud").cast("bigint").alias("frauds"))
    joined = spark.table(f"{name}_rows").join(spark.table(f"{name}_scores"), "txn_id").groupBy("split").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    normal = IO.load_train_normal(spark, at).agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    return (rows.join(joined, "split").crossJoin(normal)                                   # one row
            .select("split", "rows", "frauds", "mean_score", F.when(F.col("split") == "train", F.col("_n")).otherwise(F.lit(0)).alias("normal_rows")))


@register("csv_quarantine", with_tx(
    """SELECT CAST(count(*) FILTER (txn_id % 97 <> 0) AS BIGINT) AS n_good, CAST(count(*) FILTER (txn_id % 97 = 0) AS BIGINT) AS n_bad,
       round(sum(amount) FILTER (txn_id % 97 <> 0), 2) AS good_amount, CAST(sum(txn_id) FILTER (txn_id % 97 = 0) AS BIGINT) AS bad_ids FROM transactions"""))
def q_csv_quarantine(spark, sf):                          # A1: cells that don't parse set their rows aside, with the raw text
    path = _scratch(spark, "bad-csv")
    df = tx(spark, sf).select(*_ALL)
    df.withColumn("amount", F.when(F.col("txn_id") % 97 == 0, F.lit("n/a")).otherwise(F.col("amount").cast("string"))).write.option("header", True).csv(path)
    good, bad = IO.read_quarantined(spark, path)
    a = good.agg(F.count(F.lit(1)).cast("bigint").alias("n_good"), F.round(F.sum("amount"), 2).alias("good_amount"))
    b = bad.agg(F.count(F.lit(1)).cast("bigint").alias("n_bad"), F.sum(F.split("raw", ",")[0].cast("bigint")).alias("bad_ids"))
    return a.crossJoin(b)                                 # one row each


@register("stream_features", with_tx(
    "SELECT txn_id, step, hour, day, week, high_risk_hour, is_transfer_or_cashout, balance_diff_orig, "
    "dest_zero_balance, isFraud FROM features"))
def q_stream_features(spark, sf):                         # row-local subset on a file-source stream
    from ..streaming.scoring import read_events_stream, run_available, stream_features
    s = stream_features(read_events_stream(spark, sf)).select(
        "txn_id", "step", "hour", "day", "week", "high_risk_hour", "is_transfer_or_cashout",
        "balance_diff_orig", "dest_zero_balance", "isFraud")
    return run_available(s)


@register("prep_report", with_split(
    """SELECT CAST(count_if(split = 'train') AS BIGINT) AS n_train, CAST(count_if(split = 'val') AS BIGINT) AS n_val,
       CAST(count_if(split = 'test') AS BIGINT) AS n_test,
       CAST(count_if(split = 'train' AND isFraud = 1) AS BIGINT) AS fraud_train,
       CAST(count_if(split = 'val' AND isFraud = 1) AS BIGINT) AS fraud_val,
       CAST(count_if(split = 'test' AND isFraud = 1) AS BIGINT) AS fraud_test,
       round(count_if(split = 'train') / (2.0 * count_if(split = 'train' AND isFraud = 0)), 9) AS weight_0,
       round(count_if(split = 'train') / (2.0 * count_if(split = 'train' AND isFraud = 1)), 9) AS weight_1,
       (SELECT round(skewness(amount), 6) FROM features) AS skew_before,
       (SELECT round(skewness(ln(1 + amount)), 6) FROM features) AS skew_after
FROM split_rows"""))
def q_prep_report(spark, sf):                             # A8
    from ..operators import sampling as SA
    f = feat(spark, sf)
    return prep_report(SA.stratified_split(P.encoded_frame(f)), f)


@register("summary_csv", with_tx(_describe_sql(_TX_NUM, "transactions")))
def q_summary_csv(spark, sf):                             # A10 (describe of all numeric columns → CSV → read back)
    from ..operators import stats as S
    path = _scratch(spark, "summary")
    IO.write_csv(S.describe(tx(spark, sf), _TX_NUM), path)
    return spark.read.option("header", True).schema(
        "column string, count bigint, mean double, std double, min double, p25 double, p50 double, "
        "p75 double, max double").csv(path)


@register("correlation_csv", _corr_rank_sql(
    ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "hour",
     "day", "week", "high_risk_hour", "is_transfer_or_cashout", "balance_diff_orig", "dest_zero_balance"],
    "feature, round(abs(c), 6) AS abs_corr"))
def q_correlation_csv(spark, sf):                         # A10 (absolute correlations with the label → CSV → read back)
    from ..operators import stats as S
    path = _scratch(spark, "correlations")
    IO.write_csv(S.numeric_correlation_ranking(feat(spark, sf)).select("feature", "abs_corr"), path)
    return spark.read.option("header", True).schema("feature string, abs_corr double").csv(path)


@register("model_report_json", with_split(
    "SELECT model, recall, precision, f1, roc_auc, pr_auc, tp, fp, fn, tn FROM (" + METRICS_SQL + ")", SCORED_CTE))
def q_model_report(spark, sf):                            # A11 (metrics rows → JSON → read back)
    from ..operators import evaluate as EV
    from .q_evaluate import scored_long
    path = _scratch(spark, "report")
    m = EV.fraud_metrics(scored_long(spark, sf, ["val"]), 0.5, by=["model"])
    IO.write_json_row(m.select("model", "recall", "precision", "f1", "roc_auc", "pr_auc", "tp", "fp", "fn", "tn"),
                      path)
    return spark.read.schema("model string, recall double, precision double, f1 double, roc_auc double, "
                             "pr_auc double, tp bigint, fp bigint, fn bigint, tn bigint").json(path)


@register("model_save_load")
def q_model_save_load(spark, sf):                         # A13: fit, save, load, identical scores
    from ..operators import evaluate as EV
    from ..operators import models as M
    p = P.prepare(feat(spark, sf))
    model = M.fit_logistic(P.with_weight(p.split("train"), p.weights))
    path = _scratch(spark, "lr-model")
    IO.save_model(model, path)
    loaded = IO.load_model(path)
    a = M.score(model, p.split("test")).select("txn_id", F.col("score").alias("a"))
    b = M.score(loaded, p.split("test")).select("txn_id", F.col("score").alias("b"))
    diff = a.join(b, "txn_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    if diff is None or diff > 0:
        raise AssertionError(f"reloaded model scores differ by {diff}")
    return EV.fraud_metrics(M.score(loaded, p.split("test")), 0.5, model="LR_balanced_reloaded")


@register("prep_report_nested")
def q_prep_report_nested(spark, sf):                      # A7 + A8 nested row (numbers: prep_report)
    f = feat(spark, sf)
    p = P.prepare(f)
    return prep_report_full(p, f, p.train_smote())
