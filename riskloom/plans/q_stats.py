"""Registered queries: aggregations and statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..operators import stats as S
from ..operators.relations import fraud_client_flag
from ..session import ensure_checkpoint_dir
from .inputs import feat, tbl, tx
from .oracle_base import with_tx
from .registry import register

_TX_NUM = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
           "newbalanceDest", "isFraud", "isFlaggedFraud"]


def _describe_sql(cols, src, digits=4, group=None):
    g = f"{group}, " if group else ""
    un = (f"(UNPIVOT (SELECT {g}" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
          + f" FROM {src}) ON " + ", ".join(cols) + " INTO NAME \"column\" VALUE v)")
    return (f"SELECT {g}\"column\", CAST(count(v) AS BIGINT) AS count, round(avg(v), {digits}) AS mean, "
            f"round(stddev_samp(v), {digits}) AS std, round(min(v), {digits}) AS min, "
            f"round(quantile_cont(v, 0.25), {digits}) AS p25, round(quantile_cont(v, 0.5), {digits}) AS p50, "
            f"round(quantile_cont(v, 0.75), {digits}) AS p75, round(max(v), {digits}) AS max "
            f"FROM {un} GROUP BY {g}\"column\"")


@register("describe", with_tx(_describe_sql(_TX_NUM, "transactions")))
def q_describe(spark, sf):                                # D1
    return S.describe(tx(spark, sf), _TX_NUM)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe_lineitem", _describe_sql(_LI_NUM, "lineitem", 6))
def q_describe_lineitem(spark, sf):                       # D1 on a larger table
    return S.describe(tbl(spark, sf, "lineitem"), _LI_NUM, digits=6)


@register("grouped_describe", with_tx(
    "SELECT isFlaggedFraud, CAST(count(amount) AS BIGINT) AS count, round(avg(amount), 4) AS mean, "
    "round(stddev_samp(amount), 4) AS std, round(min(amount), 4) AS min, "
    "round(quantile_cont(amount, 0.25), 4) AS p25, round(quantile_cont(amount, 0.5), 4) AS p50, "
    "round(quantile_cont(amount, 0.75), 4) AS p75, round(max(amount), 4) AS max "
    "FROM transactions WHERE isFraud = 1 GROUP BY isFlaggedFraud"))
def q_grouped_describe(spark, sf):                        # D2
    return S.grouped_describe(tx(spark, sf))


@register("fraud_by_type", with_tx(
    "SELECT type, CAST(count(isFraud) AS BIGINT) AS total, CAST(sum(isFraud) AS BIGINT) AS nb_fraudes, "
    "round(avg(isFraud) * 100, 4) AS taux_fraude_pct FROM transactions GROUP BY type"))
def q_fraud_by_type(spark, sf):                           # D3 (flagship)
    return S.fraud_by_type(tx(spark, sf))


def _rate_sql(key):
    return with_tx(
        f"SELECT {key}, round(avg(isFraud), 6) AS fraud_rate, CAST(count(isFraud) AS BIGINT) AS total_txn, "
        f"CAST(sum(isFraud) AS BIGINT) AS nb_fraud, round(avg(isFraud) * 100, 6) AS fraud_rate_pct "
        f"FROM features GROUP BY {key}")


@register("fraud_by_hour", _rate_sql("hour"))
def q_fraud_by_hour(spark, sf):                           # D4
    return S.fraud_rate_by(feat(spark, sf), "hour")


@register("fraud_by_day", _rate_sql("day"))
def q_fraud_by_day(spark, sf):                            # D5
    return S.fraud_rate_by(feat(spark, sf), "day")


@register("fraud_by_week", _rate_sql("week"))
def q_fraud_by_week(spark, sf):                           # D5
    return S.fraud_rate_by(feat(spark, sf), "week")


@register("derive_high_risk_hours", with_tx(
    "SELECT hour, round(fr, 6) AS fraud_rate, round(g, 6) AS global_rate FROM "
    "(SELECT hour, avg(isFraud) AS fr FROM features GROUP BY hour) h, "
    "(SELECT avg(isFraud) AS g FROM features) WHERE fr > g"))
def q_derive_high_risk_hours(spark, sf):                  # D6
    return S.derive_high_risk_hours(feat(spark, sf))


@register("risk_ratio", with_tx(
    "SELECT round(r1, 6) AS rate_flag1_pct, round(r0, 6) AS rate_flag0_pct, round(r1 / r0, 6) AS ratio FROM "
    "(SELECT coalesce(avg(CASE WHEN high_risk_hour = 1 THEN isFraud END) * 100, CAST(0 AS DOUBLE)) AS r1, "
    "coalesce(avg(CASE WHEN high_risk_hour = 0 THEN isFraud END) * 100, CAST(1 AS DOUBLE)) AS r0 FROM features)"))
def q_risk_ratio(spark, sf):                              # D7
    return S.risk_ratio(feat(spark, sf))


@register("skew_kurtosis", with_tx(
    "SELECT 'amount' AS column, round(skewness(amount), 6) AS skewness, round(kurtosis(amount), 6) AS kurtosis "
    "FROM transactions UNION ALL "
    "SELECT 'log_amount', round(skewness(ln(1 + amount)), 6), round(kurtosis(ln(1 + amount)), 6) FROM transactions"))
def q_skew_kurtosis(spark, sf):                           # D8 (+ B14 skew before/after)
    df = tx(spark, sf).withColumn("log_amount", F.log1p("amount"))
    return S.skew_kurtosis(df, ["amount", "log_amount"])


@register("amount_summary", with_tx(
    "SELECT round(quantile_cont(amount, 0.5), 6) AS median, round(avg(amount), 6) AS mean, "
    "round(max(amount), 6) AS max, round(max(amount) / quantile_cont(amount, 0.5), 6) AS max_to_median "
    "FROM transactions"))
def q_amount_summary(spark, sf):                          # D9
    return S.amount_summary(tx(spark, sf))


_DECILE_SQL = with_tx(
    """SELECT b.bin, round(k.lo, 6) AS lower, round(k.hi, 6) AS upper,
       CAST(sum(b.isFraud) AS BIGINT) AS nb_fraudes, CAST(count(*) AS BIGINT) AS total,
       round(avg(b.isFraud) * 100, 4) AS taux_pct
FROM (SELECT t.isFraud, CAST((SELECT count(*) FROM e_int WHERE e_int.e < t.amount) AS INTEGER) AS bin
      FROM transactions t WHERE t.amount IS NOT NULL) b
JOIN (SELECT row_number() OVER (ORDER BY e) - 1 AS i, e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM e_all) k
  ON k.i = b.bin
GROUP BY b.bin, k.lo, k.hi""",
    """q AS (SELECT quantile_cont(amount, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qs
        FROM transactions),
e_all AS (SELECT DISTINCT unnest(qs) AS e FROM q),
e_int AS (SELECT e FROM e_all WHERE e > (SELECT min(e) FROM e_all) AND e < (SELECT max(e) FROM e_all))""")


@register("fraud_by_amount_decile", _DECILE_SQL)
def q_amount_decile(spark, sf):                           # D10
    return S.fraud_by_amount_decile(tx(spark, sf))


@register("flag_confusion", with_tx(
    "SELECT CAST(count_if(isFlaggedFraud = 1 AND isFraud = 1) AS BIGINT) AS tp, "
    "CAST(count_if(isFlaggedFraud = 0 AND isFraud = 1) AS BIGINT) AS fn, "
    "CAST(count_if(isFlaggedFraud = 1 AND isFraud = 0) AS BIGINT) AS fp, "
    "CAST(sum(isFraud) AS BIGINT) AS total_fraud, CAST(sum(isFlaggedFraud) AS BIGINT) AS flagged_total "
    "FROM transactions"))
def q_flag_confusion(spark, sf):                          # D11
    return S.flag_confusion(tx(spark, sf))


@register("flag_baseline_metrics", with_tx(
    """SELECT tp, fn, fp, round(r, 6) AS recall, round(p, 6) AS precision,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE CAST(0 AS DOUBLE) END, 6) AS f1
FROM (SELECT tp, fn, fp,
        CASE WHEN tf > 0 THEN tp / tf ELSE CAST(0 AS DOUBLE) END AS r,
        CASE WHEN ft > 0 THEN tp / ft ELSE CAST(0 AS DOUBLE) END AS p
      FROM (SELECT CAST(count_if(isFlaggedFraud = 1 AND isFraud = 1) AS BIGINT) AS tp,
                   CAST(count_if(isFlaggedFraud = 0 AND isFraud = 1) AS BIGINT) AS fn,
                   CAST(count_if(isFlaggedFraud = 1 AND isFraud = 0) AS BIGINT) AS fp,
                   sum(isFraud) AS tf, sum(isFlaggedFraud) AS ft FROM transactions))"""))
def q_flag_baseline(spark, sf):                           # D12
    return S.flag_baseline_metrics(tx(spark, sf))


@register("feature_label_corr", with_tx(
    "SELECT round(corr(balance_diff_orig, CAST(isFraud AS DOUBLE)), 6) AS corr FROM features"))
def q_feature_label_corr(spark, sf):                      # D13
    return S.feature_label_corr(feat(spark, sf), "balance_diff_orig")


def _corr_rank_sql(cols, out="feature, round(c, 6) AS corr, round(abs(c), 6) AS abs_corr"):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(isFraud AS DOUBLE)) AS c FROM features"
        for c in cols)
    return with_tx(f"SELECT {out} FROM ({parts})")


@register("feature_correlation_ranking", _corr_rank_sql(
    ["amount", "step", "hour", "day", "week", "high_risk_hour", "is_transfer_or_cashout",
     "balance_diff_orig", "dest_zero_balance", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
     "newbalanceDest"]))
def q_corr_ranking(spark, sf):                            # D14
    return S.correlation_ranking(feat(spark, sf))


@register("numeric_correlation_ranking", _corr_rank_sql(
    ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "hour",
     "day", "week", "high_risk_hour", "is_transfer_or_cashout", "balance_diff_orig", "dest_zero_balance"]))
def q_numeric_corr_ranking(spark, sf):                    # D15
    return S.numeric_correlation_ranking(feat(spark, sf))


_MAT = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "balance_diff_orig",
        "amount", "isFraud"]


@register("correlation_matrix", with_tx(" UNION ALL ".join(
    f"SELECT '{a}' AS row, '{b}' AS col, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
    f"FROM features" for a in _MAT for b in _MAT)))
def q_corr_matrix(spark, sf):                             # D16
    return S.correlation_matrix(feat(spark, sf))


@register("flag_rate_table", with_tx(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, CAST(count(*) AS BIGINT) AS total, "
    f"CAST(sum(isFraud) AS BIGINT) AS nb_fraudes, round(avg(isFraud), 6) AS taux_fraude "
    f"FROM features GROUP BY {f}"
    for f in ["is_transfer_or_cashout", "dest_zero_balance", "high_risk_hour"])))
def q_flag_rate_table(spark, sf):                         # D17
    return S.flag_rate_table(feat(spark, sf))


@register("grouped_mean_median_max", with_tx(
    "SELECT isFraud, round(avg(balance_diff_orig), 6) AS mean, "
    "round(quantile_cont(balance_diff_orig, 0.5), 6) AS median, round(max(balance_diff_orig), 6) AS max "
    "FROM features GROUP BY isFraud"))
def q_grouped_mmm(spark, sf):                             # D18
    return S.grouped_mean_median_max(feat(spark, sf), "balance_diff_orig", "isFraud")


@register("fraud_client_amounts", with_tx(
    """SELECT is_fraud_client, round(avg(amount), 6) AS mean, round(quantile_cont(amount, 0.5), 6) AS median,
       round(max(amount), 6) AS max
FROM (SELECT t.amount, CAST(CASE WHEN f.nameOrig IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS is_fraud_client
      FROM transactions t LEFT JOIN (SELECT DISTINCT nameOrig FROM transactions WHERE isFraud = 1) f
      ON t.nameOrig = f.nameOrig)
GROUP BY is_fraud_client"""))
def q_fraud_client_amounts(spark, sf):                    # E2 + D18
    return S.grouped_mean_median_max(fraud_client_flag(tx(spark, sf)), "amount", "is_fraud_client")


@register("frauds_per_client", with_tx(
    """SELECT CAST(count_if(n >= 1) AS BIGINT) AS clients_ge1, CAST(count_if(n = 1) AS BIGINT) AS clients_eq1,
       CAST(count_if(n >= 2) AS BIGINT) AS clients_ge2, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
       CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max,
       round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50,
       round(quantile_cont(n, 0.75), 6) AS p75
FROM (SELECT nameOrig, count(*) AS n FROM transactions WHERE isFraud = 1 GROUP BY nameOrig)"""))
def q_frauds_per_client(spark, sf):                       # D19
    return S.frauds_per_client(tx(spark, sf))


@register("type_mix", with_tx(
    """SELECT isFraud, type, round(n * 100.0 / sum(n) OVER (PARTITION BY isFraud), 6) AS share_pct
FROM (SELECT isFraud, type, count(*) AS n FROM transactions GROUP BY isFraud, type)"""))
def q_type_mix(spark, sf):                                # D20
    return S.type_mix(tx(spark, sf), "isFraud")


@register("top_fraud_destinations", with_tx(
    "SELECT nameDest, CAST(count(*) AS BIGINT) AS n_fraud FROM transactions WHERE isFraud = 1 "
    "GROUP BY nameDest ORDER BY n_fraud DESC, nameDest LIMIT 20"))
def q_top_fraud_dest(spark, sf):                          # D21
    return S.top_fraud_destinations(tx(spark, sf))


@register("id_prefix_counts", with_tx(
    "SELECT 'nameOrig' AS column, substr(nameOrig, 1, 1) AS prefix, CAST(count(*) AS BIGINT) AS n "
    "FROM transactions GROUP BY 2 UNION ALL "
    "SELECT 'nameDest', substr(nameDest, 1, 1), CAST(count(*) AS BIGINT) FROM transactions GROUP BY 2"))
def q_id_prefix(spark, sf):                               # B16
    return S.id_prefix_counts(tx(spark, sf))


@register("merchant_client_split", with_tx(
    """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(z) AS BIGINT) AS n_zero,
       round(count_if(z) * 100.0 / count(*), 6) AS zero_pct,
       CAST(coalesce(sum(CASE WHEN z THEN isFraud END), 0) AS BIGINT) AS zero_frauds,
       round(avg(CASE WHEN z THEN isFraud END) * 100, 6) AS zero_fraud_rate_pct,
       CAST(count_if(z AND starts_with(nameDest, 'M')) AS BIGINT) AS n_merchant,
       CAST(count_if(z AND starts_with(nameDest, 'C')) AS BIGINT) AS n_client,
       round(avg(CASE WHEN z AND starts_with(nameDest, 'M') THEN isFraud END) * 100, 6) AS merchant_fraud_rate_pct,
       round(avg(CASE WHEN z AND starts_with(nameDest, 'C') THEN isFraud END) * 100, 6) AS client_fraud_rate_pct,
       round(avg(isFraud) * 100, 6) AS global_fraud_rate_pct
FROM (SELECT *, oldbalanceDest = 0 AND newbalanceDest = 0 AS z FROM transactions)"""))
def q_merchant_client(spark, sf):                         # B17
    return S.merchant_client_split(tx(spark, sf))


@register("amount_under_threshold", with_tx(
    "SELECT CAST(count_if(amount < 200000) AS BIGINT) AS n_under, "
    "round(avg(CASE WHEN amount < 200000 THEN 1 ELSE 0 END) * 100, 6) AS pct_under "
    "FROM transactions WHERE isFraud = 1"))
def q_amount_under(spark, sf):                            # B21
    return S.amount_under_threshold(tx(spark, sf))


@register("quantiles_by_sketch", with_tx(
    "SELECT \"column\", CAST(p AS DOUBLE) AS prob, CAST(n AS BIGINT) AS n, true AS within_1_pct FROM (SELECT unnest(['amount', 'oldbalanceOrg']) AS \"column\"), "
    "(SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]) AS p), (SELECT count(*) AS n FROM transactions)"))
def q_quantiles_by_sketch(spark, sf):                     # D1 / H10: KLL sketches stored per day, merged on read; ranks checked against the rows
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-kll-{uuid.uuid4().hex[:8]}"
    columns, df = ["amount", "oldbalanceOrg"], feat(spark, sf)
    K.quantile_sketches(df, columns, ["day"]).write.partitionBy("day").parquet(path)
    got = K.quantile_estimates(spark.read.parquet(path), [0.01, 0.25, 0.5, 0.75, 0.99])
    asked = F.broadcast(got)                              # ten rows
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]))
    ranks = (df.select(value.alias("x")).select("x.*").join(asked, "column").groupBy("column", "prob")
             .agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") <= F.col("quantile")).cast("int")).alias("upto"), F.avg((F.col("v") < F.col("quantile")).cast("int")).alias("below")))
    off = F.greatest(F.col("below") - F.col("prob"), F.col("prob") - F.col("upto"))          # ties span a range of ranks
    return ranks.select("column", "prob", F.col("n").cast("bigint").alias("n"), (off <= 0.01).alias("within_1_pct"))
