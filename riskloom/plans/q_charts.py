"""Registered queries: chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as CH
from ..operators import prepare as P
from ..operators import sampling as SA
from .inputs import feat, tx
from .oracle_base import with_split, with_tx
from .q_evaluate import SCORED_CTE, scored_long
from .registry import register


@register("histogram", with_tx(
    """SELECT bin, round(lo + bin * ((hi - lo) / 60), 6) AS lower, round(lo + (bin + 1) * ((hi - lo) / 60), 6) AS upper,
       CAST(count(*) AS BIGINT) AS count
FROM (SELECT CAST(least(floor((ln(1 + amount) - lo) * (60 / (hi - lo))), 59) AS INTEGER) AS bin, lo, hi
      FROM transactions, (SELECT min(ln(1 + amount)) AS lo, max(ln(1 + amount)) AS hi FROM transactions))
GROUP BY bin, lo, hi"""))
def q_histogram(spark, sf):                               # J1 (60 bins of log1p(amount))
    df = tx(spark, sf).withColumn("log_amount", F.log1p("amount"))
    return CH.histogram(df, "log_amount", 60)


@register("boxplot_stats", with_tx(
    """SELECT b.isFraud, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
       round(min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END), 6) AS whisker_low,
       round(max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END), 6) AS whisker_high,
       CAST(count_if(x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM (SELECT isFraud, ln(1 + amount) AS x FROM transactions) b
JOIN (SELECT isFraud, quantile_cont(ln(1 + amount), 0.25) AS q1, quantile_cont(ln(1 + amount), 0.5) AS med,
             quantile_cont(ln(1 + amount), 0.75) AS q3 FROM transactions GROUP BY isFraud) q
ON b.isFraud = q.isFraud GROUP BY b.isFraud, q1, med, q3"""))
def q_boxplot(spark, sf):                                 # J2
    df = tx(spark, sf).withColumn("log_amount", F.log1p("amount"))
    return CH.boxplot_stats(df, "log_amount")


@register("clipped_density_histogram", with_split(
    """SELECT grp, CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS count,
       round(count(*) / (max(n) * (clip / 79)), 9) AS density, round(clip, 9) AS clip
FROM (SELECT g.grp, g.n, c.clip,
             least((SELECT count(*) FROM edges e WHERE e.e <= least(greatest(g.score, 0), c.clip)) - 1, 78) AS bin
      FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM grouped) g, clipv c)
GROUP BY grp, bin, clip""",
    SCORED_CTE.strip() + """,
grouped AS (
  SELECT CASE WHEN split = 'train' THEN 'train_normal' WHEN isFraud = 1 THEN 'val_fraud' ELSE 'val_legit' END AS grp,
         score FROM scored
  WHERE model = 'amount_score' AND ((split = 'train' AND isFraud = 0) OR split = 'val')),
clipv AS (SELECT greatest(quantile_cont(score, 0.999), CAST(0.5 AS DOUBLE) * 1.5) AS clip
          FROM scored WHERE model = 'amount_score' AND split = 'val'),
edges AS (SELECT CASE WHEN i = 79 THEN clip ELSE i * (clip / 79) + CAST(0 AS DOUBLE) END AS e
          FROM range(80) r(i), clipv)"""))
def q_clipped_density(spark, sf):                         # J3
    s = scored_long(spark, sf).filter(F.col("model") == "amount_score")
    val = s.filter(F.col("split") == "val")
    g = s.filter(((F.col("split") == "train") & (F.col("isFraud") == 0)) | (F.col("split") == "val")) \
        .withColumn("grp", F.when(F.col("split") == "train", "train_normal")
                    .when(F.col("isFraud") == 1, "val_fraud").otherwise("val_legit"))
    return CH.clipped_density_histogram(g, "score", "grp", val, threshold=0.5)


@register("rate_series_hour", with_tx(
    """SELECT hour, CAST(count(*) AS BIGINT) AS n, round(avg(isFraud) * 100, 6) AS fraud_rate_pct,
       round((SELECT avg(isFraud) FROM features) * 100, 6) AS global_rate_pct FROM features GROUP BY hour"""))
def q_rate_series_hour(spark, sf):                        # J5 (hour)
    return CH.rate_series(feat(spark, sf), "hour")


@register("rate_series_split", with_split(
    """SELECT split, CAST(count(*) AS BIGINT) AS n, round(avg(isFraud) * 100, 6) AS fraud_rate_pct,
       round((SELECT avg(isFraud) FROM split_rows) * 100, 6) AS global_rate_pct FROM split_rows GROUP BY split"""))
def q_rate_series_split(spark, sf):                       # J5 (split)
    return CH.rate_series(SA.stratified_split(feat(spark, sf)), "split")


@register("plot_subsample", with_split(
    """SELECT txn_id, part FROM (SELECT txn_id, 'train_normal' AS part, row_number() OVER (ORDER BY md5(CAST(txn_id AS VARCHAR) || ':42'), txn_id) AS rk
       FROM split_rows WHERE split = 'train' AND isFraud = 0) WHERE rk <= 5000
UNION ALL SELECT txn_id, CASE WHEN isFraud = 1 THEN 'val_fraud' ELSE 'val_legit' END FROM split_rows WHERE split = 'val'"""))
def q_plot_subsample(spark, sf):                          # J4: at most 5000 normal training rows in hash order, with all val rows
    return CH.plot_rows(P.prepare(feat(spark, sf)).data).select("txn_id", "part")
