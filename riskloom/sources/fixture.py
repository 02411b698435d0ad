"""The ``transactions`` test view, derived from the driver's ``events`` table.

Integer-only rules (the same expressions run in DuckDB as the oracle's CTE), so both
engines see the same rows.  Every query over transactions therefore scans ``events``
and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation (shared with the oracle CTE in plans/oracle.py).
EPOCH_START = 1704067200            # 2024-01-01 00:00:00 UTC
H1_MUL, H1_MOD = 7919, 10007
H2_MUL, H2_MOD = 104729, 997
TYPE_OF_EVENT = {
    "signup": "CASH_IN",
    "error": "CASH_OUT",
    "view": "DEBIT",
    "click": "PAYMENT",
    "purchase": "TRANSFER",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions_from_events(events: DataFrame) -> DataFrame:
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    ts_type = dict(ev.dtypes)["ts"]
    if ts_type == "timestamp_ntz":
        secs = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    else:
        secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    step = F.floor((secs - F.lit(EPOCH_START)) / F.lit(3600)).cast("bigint") + F.lit(1)
    h1 = (F.col("event_id") * H1_MUL) % H1_MOD
    h2 = (F.col("event_id") * H2_MUL) % H2_MOD
    type_col = F.col("event_type")
    mapped = None
    for ev_name, tx_type in TYPE_OF_EVENT.items():
        mapped = (F.when(type_col == ev_name, F.lit(tx_type)) if mapped is None
                  else mapped.when(type_col == ev_name, F.lit(tx_type)))
    base = ev.select(
        F.col("event_id").alias("txn_id"),
        step.alias("step"),
        mapped.alias("type"),
        F.col("value"),
        F.col("user_id"),
        h1.alias("h1"),
        h2.alias("h2"),
    ).withColumn("bal", F.col("h2").cast("double") / F.lit(2.0))
    hr = F.pmod(F.col("step"), F.lit(24))
    limit = F.when((hr <= 9) | (hr == 23), F.lit(900)).otherwise(F.lit(90))
    fraud = F.coalesce(F.col("type").isin("TRANSFER", "CASH_OUT") & (F.col("h1") < limit),
                       F.lit(False))
    base = base.withColumn("isFraud", fraud.cast("int"))
    base = base.withColumn(
        "amount",
        F.round(F.col("value") * F.when(F.col("isFraud") == 1, F.lit(10.0)).otherwise(F.lit(1.0)), 2))
    zero = F.lit(0.0).cast("double")
    dest_zero = ((F.col("type") == "PAYMENT") | (F.col("h2") % 20 == 0)
                 | ((F.col("isFraud") == 1) & (F.col("h2") % 2 == 0)))
    is_fraud = F.col("isFraud") == 1
    return base.select(
        "txn_id",
        "step",
        "type",
        "amount",
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.when(is_fraud, F.col("amount")).otherwise(F.col("bal")).alias("oldbalanceOrg"),
        F.when(is_fraud, zero)
         .when(F.col("type") == "CASH_IN", F.round(F.col("bal") + F.col("amount"), 2))
         .otherwise(F.round(F.greatest(F.col("bal") - F.col("amount"), zero), 2))
         .alias("newbalanceOrig"),
        F.concat(F.when(F.col("type") == "PAYMENT", F.lit("M")).otherwise(F.lit("C")),
                 ((F.col("user_id") * 31 + F.col("h2")) % 150).cast("string")).alias("nameDest"),
        F.when(dest_zero, zero).otherwise(F.round(F.col("bal") * 2, 2)).alias("oldbalanceDest"),
        F.when(dest_zero, zero).otherwise(F.round(F.col("bal") * 2 + F.col("amount"), 2))
         .alias("newbalanceDest"),
        "isFraud",
        F.coalesce(is_fraud & (F.col("type") == "TRANSFER") & (F.col("amount") > 1200),
                   F.lit(False)).cast("int").alias("isFlaggedFraud"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions (11 reference columns + ``txn_id``) for a fixture scale."""
    return transactions_from_events(table(spark, sf_dir, "events"))
