"""Registered queries: row-local features and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators.text import explanation_prompt
from .inputs import feat, tx
from .oracle_base import with_tx
from .registry import register

FEATURE_OUT = ("txn_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, "
               "oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud, hour, day, week, "
               "high_risk_hour, is_transfer_or_cashout, balance_diff_orig, dest_zero_balance")


@register("transactions", with_tx("SELECT * FROM transactions"))
def q_transactions(spark, sf):
    return tx(spark, sf)


@register("temporal_features", with_tx(
    "SELECT txn_id, step, step % 24 AS hour, CAST(floor(step / 24) AS BIGINT) AS day, "
    "CAST(floor(step / 168) AS BIGINT) AS week, "
    "CAST(CASE WHEN CAST(floor(step / 24) AS BIGINT) % 7 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend "
    "FROM transactions"))
def q_temporal(spark, sf):                               # B1-B5
    return FE.temporal_features(tx(spark, sf), include_is_weekend=True) \
        .select("txn_id", "step", "hour", "day", "week", "is_weekend")


@register("build_features", with_tx(f"SELECT {FEATURE_OUT} FROM features"))
def q_build_features(spark, sf):                         # B6-B10
    return feat(spark, sf)


@register("drop_leakage_columns", with_tx(
    "SELECT txn_id, step, type, amount, isFraud, hour, day, week, high_risk_hour, "
    "is_transfer_or_cashout, balance_diff_orig, dest_zero_balance FROM features"))
def q_drop_leakage(spark, sf):                           # B11
    return FE.drop_leakage_columns(feat(spark, sf))


_ONEHOT_SQL = ", ".join(
    f"CAST(CASE WHEN type = '{t}' THEN 1 ELSE 0 END AS INTEGER) AS type_{t}"
    for t in ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"])


@register("encode_type", with_tx(f"SELECT txn_id, isFraud, {_ONEHOT_SQL} FROM transactions"))
def q_encode_type(spark, sf):                            # B12
    return FE.encode_type(tx(spark, sf).select("txn_id", "type", "isFraud"))


@register("onehot_check", with_tx(
    "SELECT CAST(0 AS BIGINT) AS bad_rows, "
    + ", ".join(f"CAST(count_if(type = '{t}') AS BIGINT) AS n_type_{t}"
                for t in ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"])
    + " FROM transactions"))
def q_onehot_check(spark, sf):                           # B13
    return FE.onehot_check(FE.encode_type(tx(spark, sf).select("type")))


@register("log_transform_amount", with_tx(
    "SELECT txn_id, round(ln(1 + amount), 9) AS log_amount FROM transactions"))
def q_log_amount(spark, sf):                             # B14
    out = FE.log_transform_amount(tx(spark, sf).select("txn_id", "amount"))
    return out.select("txn_id", F.round("log_amount", 9).alias("log_amount"))


@register("balance_anomalies", with_tx(
    "SELECT txn_id, oldbalanceOrg - newbalanceOrig AS observed_delta_orig, "
    "(oldbalanceOrg - newbalanceOrig) - amount AS balance_gap_vs_amount, true AS is_balance_anomaly "
    "FROM transactions WHERE NOT (abs((oldbalanceOrg - newbalanceOrig) - amount) "
    "<= 1e-8 + 1e-5 * abs(amount))"))
def q_balance_anomalies(spark, sf):                      # B15
    return FE.balance_anomalies(tx(spark, sf)).select(
        "txn_id", "observed_delta_orig", "balance_gap_vs_amount", "is_balance_anomaly")


@register("feature_projection", with_tx(
    "SELECT step, hour, day, week, high_risk_hour, is_transfer_or_cashout, balance_diff_orig, "
    "dest_zero_balance, " + _ONEHOT_SQL + ", round(ln(1 + amount), 9) AS log_amount, isFraud "
    "FROM features"))
def q_feature_projection(spark, sf):                     # B19
    df = FE.encode_type(FE.log_transform_amount(feat(spark, sf)))
    return FE.feature_projection(df).withColumn("log_amount", F.round("log_amount", 9))


@register("class_name_map", with_tx(
    "SELECT txn_id, isFraud, CASE isFraud WHEN 0 THEN 'Non-fraude' WHEN 1 THEN 'Fraude' END "
    "AS class_name FROM transactions"))
def q_class_name(spark, sf):                             # B22
    return FE.with_class_name(tx(spark, sf).select("txn_id", "isFraud"))


@register("threshold_classify", with_tx(
    "SELECT txn_id, CAST(CASE WHEN balance_diff_orig / 1000 >= 0.5 THEN 1 ELSE 0 END AS INTEGER) "
    "AS prediction FROM features"))
def q_threshold_classify(spark, sf):                     # B23 (score = balance_diff_orig / 1000)
    df = feat(spark, sf).select("txn_id", (F.col("balance_diff_orig") / 1000).alias("score"))
    return FE.threshold_classify(df, 0.5).select("txn_id", "prediction")


@register("explanation_prompt", with_tx(
    """SELECT txn_id,
  'Tu es un analyste fraude. Analyse les signaux et justifie la decision.' || chr(10)
  || 'Reponds uniquement en JSON avec les cles: risk_level, reasons, actions.' || chr(10)
  || 'Input:' || chr(10)
  || '{"transaction":{"amount":' || CAST(CAST(round(amount * 100) AS BIGINT) AS VARCHAR)
  || ',"type":"' || type || '","hour":' || CAST(hour AS VARCHAR)
  || ',"balance_diff_orig":' || CAST(CAST(round(balance_diff_orig * 100) AS BIGINT) AS VARCHAR)
  || ',"dest_zero_balance":' || CAST(dest_zero_balance AS VARCHAR)
  || '},"model_score":' || CAST(isFraud AS VARCHAR) || '.0'
  || ',"instructions":["Explain why the transaction may be fraudulent.",'
  || '"Reference each provided signal explicitly.",'
  || '"Give a short risk level: low, medium, or high.",'
  || '"Respond in French with concise bullet points."]}' AS prompt
FROM features"""))
def q_explanation_prompt(spark, sf):                     # B24
    # amounts in cents (bigint) so JSON number text is identical across engines
    df = feat(spark, sf).select(
        "txn_id", "type", "hour", "dest_zero_balance",
        F.round(F.col("amount") * 100).cast("bigint").alias("amount"),
        F.round(F.col("balance_diff_orig") * 100).cast("bigint").alias("balance_diff_orig"),
        F.col("isFraud").cast("double").alias("score"))
    return explanation_prompt(df).select("txn_id", "prompt")


@register("weekend_flag", with_tx(
    "SELECT txn_id, CAST(CASE WHEN CAST(floor(step / 24) AS BIGINT) % 7 >= 5 THEN 1 ELSE 0 END AS INTEGER) "
    "AS is_weekend FROM transactions"))
def q_weekend(spark, sf):                                # B4 on its own (derives day)
    return FE.add_is_weekend(tx(spark, sf).select("txn_id", "step")).select("txn_id", "is_weekend")


@register("normal_rows_flag", with_tx(
    "SELECT txn_id, CAST(hour AS BIGINT) AS hour FROM features WHERE isFraud = 0 AND high_risk_hour = 1"))
def q_normal_high_risk(spark, sf):                       # B20-style filter on features
    df = feat(spark, sf)
    return FE.normal_rows(df, split=None).filter(F.col("high_risk_hour") == 1) \
        .select("txn_id", F.col("hour").cast("bigint").alias("hour"))

