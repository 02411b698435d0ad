"""Registered queries: data-quality checks (C1-C8, C11, C16) and relations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import relations as R
from ..operators import sketches as K
from ..session import ensure_checkpoint_dir
from .inputs import feat, tbl, tx
from .oracle_base import with_tx
from .registry import register

_TX_COLS = ["txn_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest",
            "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]
_TYPE = {"txn_id": "bigint", "step": "bigint", "type": "string", "nameOrig": "string", "nameDest": "string", "isFraud": "int", "isFlaggedFraud": "int"}
_DOUBLE = {"amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"}


def _missing_sql(cols, doubles, src):
    parts = []
    for c in cols:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in doubles else "")
        parts.append(f"SELECT '{c}' AS column, CAST(count_if({cond}) AS BIGINT) AS missing_values, "
                     f"round(count_if({cond}) * 100.0 / count(*), 6) AS percentage FROM {src}")
    return " UNION ALL ".join(parts)


@register("missing_values", with_tx(_missing_sql(_TX_COLS, _DOUBLE, "transactions")))
def q_missing(spark, sf):                                 # C1
    return Q.missing_values(tx(spark, sf))


_ORD = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("missing_values_orders", _missing_sql(_ORD, {"o_totalprice"}, "orders"))
def q_missing_orders(spark, sf):                          # C1 on a driver table
    return Q.missing_values(tbl(spark, sf, "orders"))


@register("duplicate_count", with_tx(
    "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates, CAST(count(*) AS BIGINT) AS n_distinct FROM "
    "(SELECT count(*) AS c FROM transactions GROUP BY step, type, isFraud, nameDest)"))
def q_duplicate_count(spark, sf):                         # C2 (on a column subset with real duplicates)
    return Q.duplicate_count(tx(spark, sf), ["step", "type", "isFraud", "nameDest"])


@register("duplicate_count_all", with_tx(
    "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates, CAST(count(*) AS BIGINT) AS n_distinct FROM "
    "(SELECT count(*) AS c FROM transactions GROUP BY ALL_COLS)".replace("ALL_COLS", ", ".join(_TX_COLS[1:]))))
def q_duplicate_count_all(spark, sf):                     # C2 over all columns but the key
    return Q.duplicate_count(tx(spark, sf).select(*_TX_COLS[1:]), _TX_COLS[1:])


@register("drop_duplicates_all", with_tx(f"SELECT DISTINCT {', '.join(_TX_COLS[1:])} FROM transactions"))
def q_drop_duplicates_all(spark, sf):                     # C3 over all columns but the key
    return Q.drop_duplicates(tx(spark, sf).select(*_TX_COLS[1:]), _TX_COLS[1:])


@register("duplicate_count_lineitem",
          "SELECT CAST((SELECT count(*) FROM lineitem) - d AS BIGINT) AS n_duplicates, CAST(d AS BIGINT) AS n_distinct "
          "FROM (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lineitem))")
def q_duplicate_lineitem(spark, sf):                      # C2 on whole rows of lineitem
    return Q.duplicate_count(tbl(spark, sf, "lineitem"))


@register("drop_duplicates", with_tx("SELECT DISTINCT step, type, isFraud, nameDest FROM transactions"))
def q_drop_duplicates(spark, sf):                         # C3
    return Q.drop_duplicates(tx(spark, sf), ["step", "type", "isFraud", "nameDest"])


@register("class_imbalance", with_tx(
    """SELECT isFraud AS class, CAST(cnt AS BIGINT) AS count, round(cnt * 100.0 / total, 6) AS percentage,
       CAST(total AS BIGINT) AS total_rows, round(CAST(major AS DOUBLE) / minor, 6) AS imbalance_ratio
FROM (SELECT isFraud, count(*) AS cnt FROM transactions GROUP BY isFraud),
     (SELECT sum(cnt) AS total, max(cnt) AS major, min(cnt) AS minor
      FROM (SELECT count(*) AS cnt FROM transactions GROUP BY isFraud))"""))
def q_class_imbalance(spark, sf):                         # C4
    return Q.class_imbalance(tx(spark, sf))


@register("class_distribution", with_tx(
    """SELECT CAST(f AS BIGINT) AS n_fraud, CAST(l AS BIGINT) AS n_legit, round(f * 100.0 / n, 6) AS pct_fraud,
       round(l * 100.0 / n, 6) AS pct_legit, round(CAST(l AS DOUBLE) / f, 6) AS ratio
FROM (SELECT count_if(isFraud = 1) AS f, count_if(isFraud = 0) AS l, count(*) AS n FROM transactions)"""))
def q_class_distribution(spark, sf):                      # C5
    return Q.class_distribution(tx(spark, sf))


@register("value_counts", with_tx("SELECT type, CAST(count(*) AS BIGINT) AS count FROM transactions GROUP BY type"))
def q_value_counts(spark, sf):                            # C6
    return Q.value_counts(tx(spark, sf), "type")


@register("distinct_accounts", with_tx(
    "SELECT CAST(count(DISTINCT nameOrig) AS BIGINT) AS n_nameOrig, "
    "CAST(count(DISTINCT nameDest) AS BIGINT) AS n_nameDest FROM transactions"))
def q_distinct_accounts(spark, sf):                       # C7
    return Q.distinct_accounts(tx(spark, sf))


@register("table_profile", with_tx("SELECT position, \"column\", dtype, (SELECT CAST(count(*) AS BIGINT) FROM transactions) AS n_rows, CAST(12 AS INTEGER) AS n_columns "
          "FROM (VALUES " + ", ".join(f"({k}, '{c}', '{_TYPE.get(c, 'double')}')" for k, c in enumerate(_TX_COLS)) + ") AS t(position, \"column\", dtype)"))
def q_table_profile(spark, sf):                           # C8 (schema metadata; rows-only check)
    return Q.table_profile(tx(spark, sf))


@register("validate_features", with_tx(
    """SELECT 'hour' AS "check", CAST(NULL AS DOUBLE) AS value, CAST(min(hour) AS BIGINT) AS range_min,
       CAST(max(hour) AS BIGINT) AS range_max, '[0, 23]' AS expected, min(hour) = 0 AND max(hour) = 23 AS ok FROM features
UNION ALL SELECT 'day', NULL, min(day), max(day), '[0, 30]', min(day) = 0 AND max(day) = 30 FROM features
UNION ALL SELECT 'week', NULL, min(week), max(week), '[0, 4]', min(week) = 0 AND max(week) = 4 FROM features
UNION ALL SELECT 'high_risk_hour_ratio', round(r, 2), NULL, NULL, '> 5.0', r > 5.0 FROM
  (SELECT CASE WHEN avg(CASE WHEN high_risk_hour = 0 THEN isFraud END) > 0
          THEN avg(CASE WHEN high_risk_hour = 1 THEN isFraud END) / avg(CASE WHEN high_risk_hour = 0 THEN isFraud END)
          ELSE CAST(0 AS DOUBLE) END AS r FROM features)
UNION ALL SELECT 'dest_zero_balance_fraud_pct', round(d, 4), NULL, NULL, '> 1.5', d > 1.5 FROM
  (SELECT avg(CASE WHEN dest_zero_balance = 1 THEN isFraud END) * 100 AS d FROM features)
UNION ALL SELECT 'balance_diff_orig_corr', round(c, 4), NULL, NULL, '> 0.30', c > 0.30 FROM
  (SELECT corr(balance_diff_orig, CAST(isFraud AS DOUBLE)) AS c FROM features)"""))
def q_validate_features(spark, sf):                       # C11
    return Q.validate_features(feat(spark, sf))


@register("leakage_alert", with_tx(
    """SELECT feature, round(c, 6) AS corr, round(abs(c), 6) AS abs_corr FROM (
  SELECT 'step' AS feature, corr(CAST(step AS DOUBLE), CAST(isFraud AS DOUBLE)) AS c FROM features
  UNION ALL SELECT 'amount', corr(amount, CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'oldbalanceOrg', corr(oldbalanceOrg, CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'newbalanceOrig', corr(newbalanceOrig, CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'oldbalanceDest', corr(oldbalanceDest, CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'newbalanceDest', corr(newbalanceDest, CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'hour', corr(CAST(hour AS DOUBLE), CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'day', corr(CAST(day AS DOUBLE), CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'week', corr(CAST(week AS DOUBLE), CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'high_risk_hour', corr(CAST(high_risk_hour AS DOUBLE), CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'is_transfer_or_cashout', corr(CAST(is_transfer_or_cashout AS DOUBLE), CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'balance_diff_orig', corr(balance_diff_orig, CAST(isFraud AS DOUBLE)) FROM features
  UNION ALL SELECT 'dest_zero_balance', corr(CAST(dest_zero_balance AS DOUBLE), CAST(isFraud AS DOUBLE)) FROM features)
WHERE round(abs(c), 6) > 0.5"""))
def q_leakage_alert(spark, sf):                           # C16
    return Q.leakage_alert(feat(spark, sf))


@register("mule_overlap", with_tx(
    """SELECT CAST(a AS BIGINT) AS n_fraud_dest, CAST(b AS BIGINT) AS n_cashout_orig, CAST(o AS BIGINT) AS n_overlap,
       round(CASE WHEN a > 0 THEN o * 100.0 / a ELSE 0 END, 6) AS overlap_pct FROM
  (SELECT count(*) AS a FROM (SELECT DISTINCT nameDest FROM transactions WHERE isFraud = 1 AND nameDest IS NOT NULL)),
  (SELECT count(*) AS b FROM (SELECT DISTINCT nameOrig FROM transactions WHERE type = 'CASH_OUT' AND nameOrig IS NOT NULL)),
  (SELECT count(*) AS o FROM (SELECT nameDest FROM transactions WHERE isFraud = 1 AND nameDest IS NOT NULL
                              INTERSECT SELECT nameOrig FROM transactions WHERE type = 'CASH_OUT'))"""))
def q_mule_overlap(spark, sf):                            # E1
    return R.mule_overlap(tx(spark, sf))


@register("fraud_client_flag", with_tx(
    """SELECT t.txn_id, CAST(CASE WHEN f.nameOrig IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_fraud_client
FROM transactions t LEFT JOIN (SELECT DISTINCT nameOrig FROM transactions WHERE isFraud = 1) f
ON t.nameOrig = f.nameOrig"""))
def q_fraud_client_flag(spark, sf):                       # E2
    return R.fraud_client_flag(tx(spark, sf)).select("txn_id", "is_fraud_client")


@register("type_mix_comparison", with_tx(
    """SELECT coalesce(a.type, b.type) AS type, round(coalesce(a.s, 0), 2) AS share_group1_pct,
       round(coalesce(b.s, 0), 2) AS share_group0_pct
FROM (SELECT type, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM fc WHERE is_fraud_client = 1 GROUP BY type) a
FULL OUTER JOIN
     (SELECT type, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM fc WHERE is_fraud_client = 0 GROUP BY type) b
ON a.type = b.type""",
    """fc AS (SELECT t.type, CASE WHEN f.nameOrig IS NOT NULL THEN 1 ELSE 0 END AS is_fraud_client
       FROM transactions t LEFT JOIN (SELECT DISTINCT nameOrig FROM transactions WHERE isFraud = 1) f
       ON t.nameOrig = f.nameOrig)"""))
def q_type_mix_comparison(spark, sf):                     # E3
    return R.type_mix_comparison(R.fraud_client_flag(tx(spark, sf)))


@register("distinct_by_sketch", with_tx(" UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_exact, true AS within_3_pct FROM transactions" for c in ["nameOrig", "nameDest"])))
def q_distinct_by_sketch(spark, sf):                      # C7: HLL sketches stored per day, united on read; checked against the exact counts
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-hll-{uuid.uuid4().hex[:8]}"
    columns, df = ["nameOrig", "nameDest"], feat(spark, sf)
    K.distinct_sketches(df, columns, ["day"]).write.partitionBy("day").parquet(path)
    got = K.distinct_estimates(spark.read.parquet(path))
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    exact = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_exact")) for c in columns])).alias("x")).select("x.*")
    return exact.join(got, "column").select("column", "n_exact", (F.abs(F.col("n_distinct") / F.col("n_exact") - 1) <= 0.03).alias("within_3_pct"))
