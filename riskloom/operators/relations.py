"""Joins, set operations and sorting.

Account sets are derived DataFrames joined by key — never Python sets on the driver.
Joins against distinct-id sets are left to Catalyst/AQE: they broadcast when the set is
small at run time and fall back to a shuffled join when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TARGET
from ..session import cut_lineage
from .sketches import Bloom


def mule_overlap(df: DataFrame, label: str = TARGET) -> DataFrame:                  # E1
    """Accounts receiving a fraud that also originate a CASH_OUT: set sizes + overlap.

    One scan and one exchange: a row gives its account in each role, an account's roles meet in an aggregate."""
    roles = F.array(F.struct(F.when(F.col(label) == 1, F.col("nameDest")).alias("acct"), F.lit(1).alias("d"), F.lit(0).alias("o")),
                    F.struct(F.when(F.col("type") == "CASH_OUT", F.col("nameOrig")).alias("acct"), F.lit(0).alias("d"), F.lit(1).alias("o")))
    acct = (df.select(F.explode(F.filter(roles, lambda x: x["acct"].isNotNull())).alias("r")).groupBy("r.acct")
            .agg(F.max("r.d").alias("d"), F.max("r.o").alias("o")))
    sizes = acct.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(n) for n, x in
                       (("n_fraud_dest", F.col("d")), ("n_cashout_orig", F.col("o")), ("n_overlap", F.col("d") * F.col("o")))])
    return sizes.withColumn("overlap_pct", F.round(F.coalesce(F.try_divide(F.col("n_overlap") * 100.0, F.col("n_fraud_dest")), F.lit(0.0)), 6))


def fraud_client_flag(df: DataFrame, label: str = TARGET, account: str = "nameOrig",
                      out: str = "is_fraud_client") -> DataFrame:                    # E2
    """1 when the row's origin account has at least one fraud.

    A Bloom filter of the fraud accounts settles most rows where they are; only rows that pass it are joined with the accounts."""
    ids = cut_lineage(df.filter((F.col(label) == 1) & F.col(account).isNotNull()).select(F.col(account).alias("_acct")).distinct())
    bloom = Bloom.of(ids.withColumnRenamed("_acct", account), [account])
    if bloom is None:
        return df.withColumn(out, F.lit(0))
    marked = bloom.mark(df, "_maybe")
    none = marked.filter("not _maybe").withColumn(out, F.lit(0)).drop("_maybe")
    some = marked.filter("_maybe").join(ids.withColumn(out, F.lit(1)), F.col(account) == F.col("_acct"), "left")
    return none.unionByName(some.withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_acct", "_maybe"))


def type_mix_comparison(df: DataFrame, group: str = "is_fraud_client", key: str = "type",
                        digits: int = 2) -> DataFrame:                              # E3
    """Share % of each type for group=1 vs group=0, 0-filled; types of neither group are left out.

    One aggregate over the input; the windows run over its few rows (one per type)."""
    n1, n0 = F.count_if(F.col(group) == 1), F.count_if(F.col(group) == 0)
    by_type = df.groupBy(key).agg(n1.alias("n1"), n0.alias("n0")).filter("n1 + n0 > 0")
    every = Window.partitionBy()
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.sum(c).over(every)), F.lit(0.0)), digits)
    return by_type.select(key, share("n1").alias("share_group1_pct"), share("n0").alias("share_group0_pct"))


def metrics_union(*frames: DataFrame) -> DataFrame:                                 # E4 / E5
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


METRIC_DEFAULTS = {"recall": 0.0, "precision": 0.0, "f1": 0.0}


def rank_models(metrics: DataFrame, by: str = "recall") -> DataFrame:               # E6
    filled = metrics.fillna({k: v for k, v in METRIC_DEFAULTS.items() if k in metrics.columns})
    return filled.orderBy(F.desc(by), "model")


def best_model(metrics: DataFrame, by: str = "f1") -> DataFrame:                    # E7
    """Row of the best model by ``by``; ties go to the first in model order."""
    return metrics.orderBy(F.desc(by), "model").limit(1)
