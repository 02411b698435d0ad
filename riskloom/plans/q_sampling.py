"""Registered queries: sampling, splitting, preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators import quality as Q
from ..operators import sampling as SA
from ..operators import stats as S
from ..schema import FEATURE_COLS, SCALE_COLS
from .inputs import feat, tx
from .oracle_base import quota_ctes, with_split, with_tx
from .registry import register

SAMPLE_N = 5000       # sample size of the registered sampling checks


def split_frame(spark, sf):
    return SA.stratified_split(P.encoded_frame(feat(spark, sf)))


def prepared(spark, sf):
    return P.prepare(feat(spark, sf))


_MD5 = "md5(CAST(txn_id AS VARCHAR) || ':42')"


@register("random_sample_n", with_tx(
    f"SELECT txn_id, isFraud FROM transactions ORDER BY {_MD5}, txn_id LIMIT {SAMPLE_N}"))
def q_random_sample(spark, sf):                           # A3
    return SA.random_sample_n(tx(spark, sf), SAMPLE_N).select("txn_id", "isFraud")


_SAMPLE_QUOTA = quota_ctes("transactions", "isFraud", "ss_",
                           n_train_expr=f"least(CAST({SAMPLE_N} AS BIGINT), sum(cnt))")


@register("stratified_sample", with_tx(
    f"""SELECT t.txn_id, t.isFraud FROM
  (SELECT txn_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {_MD5}, txn_id) AS rk
   FROM transactions) t JOIN ss_quotas q ON t.isFraud = q.c WHERE t.rk <= q.q_train""", _SAMPLE_QUOTA))
def q_stratified_sample(spark, sf):                       # F1
    return SA.stratified_sample(tx(spark, sf), SAMPLE_N).select("txn_id", "isFraud")


@register("sample_reproducibility", with_tx(
    f"""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(t.isFraud) AS BIGINT) AS frauds,
       CAST({SAMPLE_N} AS BIGINT) AS expected_rows,
       CAST((SELECT q_train FROM ss_quotas WHERE c = 1) AS BIGINT) AS expected_frauds,
       count(*) = {SAMPLE_N} AND sum(t.isFraud) = (SELECT q_train FROM ss_quotas WHERE c = 1) AS ok
FROM (SELECT txn_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {_MD5}, txn_id) AS rk
      FROM transactions) t JOIN ss_quotas q ON t.isFraud = q.c WHERE t.rk <= q.q_train""", _SAMPLE_QUOTA))
def q_sample_repro(spark, sf):                            # C9
    df = tx(spark, sf)
    counts = SA.class_counts(df, "isFraud")
    expected = SA.approximate_mode(counts, min(SAMPLE_N, sum(counts.values())))
    return Q.sample_reproducibility(SA.stratified_sample(df, SAMPLE_N), SAMPLE_N, expected.get(1, 0))


@register("stratified_split", with_split("SELECT txn_id, isFraud, split FROM split_rows"))
def q_stratified_split(spark, sf):                        # F2
    return split_frame(spark, sf).select("txn_id", "isFraud", "split")


@register("stratified_kfold", with_tx(
    f"SELECT txn_id, isFraud, CAST((row_number() OVER (PARTITION BY isFraud ORDER BY {_MD5}, txn_id) - 1) % 5 "
    "AS INTEGER) AS fold FROM transactions"))
def q_kfold(spark, sf):                                   # F3
    return SA.stratified_kfold(tx(spark, sf).select("txn_id", "isFraud"), 5)


@register("tail_validation_split", with_tx(
    f"""SELECT txn_id, CAST(CASE WHEN rk > n - CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) THEN 1 ELSE 0 END
       AS INTEGER) AS is_holdout
FROM (SELECT txn_id, row_number() OVER (ORDER BY {_MD5}, txn_id) AS rk, count(*) OVER () AS n
      FROM features WHERE isFraud = 0)"""))
def q_tail_validation(spark, sf):                         # F4 (on normal rows)
    normal = feat(spark, sf).filter(F.col("isFraud") == 0).select("txn_id")
    return SA.tail_validation_split(normal, 0.1)


@register("split_summary", with_split(
    "SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds, "
    "round(avg(isFraud) * 100, 6) AS fraud_rate_pct FROM split_rows GROUP BY split"))
def q_split_summary(spark, sf):                           # D22
    return S.split_summary(split_frame(spark, sf))


@register("split_summary_observed", with_split(
    "SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds, "
    "round(sum(isFraud) * 100.0 / count(*), 6) AS fraud_rate_pct FROM split_rows GROUP BY split"))
def q_split_summary_observed(spark, sf):                  # D22 (+ C10) without a scan: observed while prepare() wrote the split
    p = prepared(spark, sf)
    if not p.stratification_ok(0.05):
        raise AssertionError(f"splits are not stratified: {p.sizes}")
    return p.split_summary()


@register("stratification_check", with_split(
    """SELECT split, round(rate, 8) AS rate, round(g, 8) AS global_rate, round(abs(rate - g), 8) AS abs_diff,
       abs(rate - g) < 5e-4 AS ok
FROM (SELECT split, avg(isFraud) AS rate FROM split_rows GROUP BY split), (SELECT avg(isFraud) AS g FROM split_rows)"""))
def q_strat_check(spark, sf):                             # C10
    return Q.stratification_check(split_frame(spark, sf))


@register("fit_scaler", with_split(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std "
    f"FROM split_rows WHERE split = 'train'" for c in SCALE_COLS)))
def q_fit_scaler(spark, sf):                              # G1
    return P.scaler_frame(split_frame(spark, sf)).select(
        "column", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("apply_scaler", with_split(
    "SELECT txn_id, split, " + ", ".join(f"round({c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in SCALE_COLS)
    + " FROM scaled"))
def q_apply_scaler(spark, sf):                            # G2
    return prepared(spark, sf).data.select(
        "txn_id", "split", *[F.round(c, 6).alias(c) for c in SCALE_COLS])


@register("class_weights", with_split(
    """SELECT isFraud AS class, round(n * 1.0 / (2 * cnt), 9) AS weight
FROM (SELECT isFraud, count(*) AS cnt FROM split_rows WHERE split = 'train' GROUP BY isFraud),
     (SELECT count(*) AS n FROM split_rows WHERE split = 'train')"""))
def q_class_weights(spark, sf):                           # G4
    w = prepared(spark, sf).weights
    return spark.createDataFrame([(int(c), round(float(v), 9)) for c, v in w.items()],
                                 "class int, weight double")


@register("scaling_check", with_split(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 6) + CAST(0 AS DOUBLE) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"abs(avg({c})) < 0.01 AND abs(stddev_samp({c}) - 1) < 0.01 AS ok FROM scaled WHERE split = 'train'"
    for c in SCALE_COLS)))
def q_scaling_check(spark, sf):                           # C12
    return Q.scaling_check(prepared(spark, sf).data)


@register("drift_check", with_split(" UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg(CASE WHEN split = 'train' THEN {c} END), 6) + CAST(0 AS DOUBLE) AS mean_train, "
    f"round(avg(CASE WHEN split = 'test' THEN {c} END), 6) + CAST(0 AS DOUBLE) AS mean_test, "
    f"round(abs(avg(CASE WHEN split = 'train' THEN {c} END) - avg(CASE WHEN split = 'test' THEN {c} END)), 6) "
    f"AS abs_diff, abs(avg(CASE WHEN split = 'train' THEN {c} END) - avg(CASE WHEN split = 'test' THEN {c} END)) "
    f"< 0.15 AS ok FROM scaled" for c in SCALE_COLS)))
def q_drift_check(spark, sf):                             # C13
    return Q.drift_check(prepared(spark, sf).data)


@register("column_stats_by_split", with_split(" UNION ALL ".join(
    f"SELECT split, '{c}' AS column, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM split_rows GROUP BY split"
    for c in SCALE_COLS)))
def q_column_stats_by_split(spark, sf):                   # D23
    return S.column_stats_by_split(split_frame(spark, sf), SCALE_COLS)


@register("no_positive_in_normal", with_split(
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(coalesce(sum(isFraud), 0) AS BIGINT) AS positives, "
    "coalesce(sum(isFraud), 0) = 0 AS ok FROM split_rows WHERE split = 'train' AND isFraud = 0"))
def q_no_positive(spark, sf):                             # C15 (+ B20 normal rows)
    return Q.no_positive_in_normal(prepared(spark, sf).train_normal())


def _u(salt):
    """The md5 uniform of a synthetic row's number, as ``uniform_of`` draws it."""
    return f"CAST(('0x' || substr(md5(CAST(g AS VARCHAR) || ':42{salt}'), 1, 8)) AS BIGINT) / 4294967296.0"


_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURE_COLS)
#: SMOTE with brute-force neighbours: real and synthetic train rows
_SMOTED = f"""
minority AS MATERIALIZED (SELECT * FROM scaled WHERE split = 'train' AND isFraud = 1),
pairs AS (SELECT a.txn_id AS i, b.txn_id AS j, {_D2} AS d2 FROM minority a JOIN minority b ON a.txn_id <> b.txn_id),
near AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d2, j) - 1 AS nn_rank FROM pairs),
numbered AS (SELECT txn_id AS i, row_number() OVER (ORDER BY md5(CAST(txn_id AS VARCHAR) || ':42'), txn_id) - 1 AS idx FROM minority),
sizes AS (SELECT sum(isFraud) AS n_min, sum(1 - isFraud) AS n_maj FROM scaled WHERE split = 'train'),
gen AS (SELECT g, CAST(floor({_u("base")} * n_min) AS BIGINT) AS idx, CAST(floor({_u("nn")} * 5) AS BIGINT) AS nn_rank, {_u("gap")} AS u
        FROM (SELECT n_min, unnest(range(greatest(CAST(trunc(CAST(0.1 AS DOUBLE) * n_maj - n_min) AS BIGINT), 0))) AS g FROM sizes)),
smoted AS (
  SELECT txn_id, isFraud, 0 AS is_synthetic, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURE_COLS)} FROM scaled WHERE split = 'train'
  UNION ALL
  SELECT -(g + 1) AS txn_id, 1 AS isFraud, 1 AS is_synthetic, {", ".join(f"a.{c} + u * (b.{c} - a.{c}) AS {c}" for c in FEATURE_COLS)}
  FROM gen JOIN numbered USING (idx) JOIN near USING (i, nn_rank) JOIN minority a ON a.txn_id = i JOIN minority b ON b.txn_id = j)
"""


@register("smote", with_split(
    "SELECT txn_id, isFraud, is_synthetic, " + ", ".join(f"round({c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in FEATURE_COLS) + " FROM smoted", _SMOTED))
def q_smote(spark, sf):                                   # G3
    p = prepared(spark, sf)
    return p.train_smote().select("txn_id", "isFraud", "is_synthetic", *[F.round(c, 6).alias(c) for c in p.feature_cols])


@register("smote_quality", with_split(
    """SELECT round(r, 6) + CAST(0 AS DOUBLE) AS mean_real, round(s, 6) + CAST(0 AS DOUBLE) AS mean_synthetic, CAST(n AS BIGINT) AS n_synthetic,
       round(abs(r - s), 6) AS abs_diff, abs(r - s) < 1 AS ok
FROM (SELECT avg(log_amount) FILTER (is_synthetic = 0) AS r, avg(log_amount) FILTER (is_synthetic = 1) AS s,
             count(*) FILTER (is_synthetic = 1) AS n FROM smoted WHERE isFraud = 1)""", _SMOTED))
def q_smote_quality(spark, sf):                           # C14
    return Q.smote_quality(prepared(spark, sf).train_smote())


@register("prepare_summary", with_split(
    """SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(sum(isFraud) AS BIGINT) AS frauds,
       round(avg(log_amount), 6) + CAST(0 AS DOUBLE) AS mean_log_amount FROM scaled GROUP BY split"""))
def q_prepare_summary(spark, sf):                         # G5 composition
    d = prepared(spark, sf).data
    return d.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                                  F.sum("isFraud").cast("bigint").alias("frauds"),
                                  F.round(F.avg("log_amount"), 6).alias("mean_log_amount"))
