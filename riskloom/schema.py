"""Schema, column-name contracts and fixed values of the transaction model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
TARGET = "isFraud"
FLAG = "isFlaggedFraud"
KEY = "txn_id"
SEED = 42
SAMPLE_SIZE = 200_000
TRAIN_RATIO = 0.70
HIGH_RISK_HOURS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 23]
TYPE_LEVELS = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
COLS_TO_DROP = [
    "nameOrig",
    "nameDest",
    "oldbalanceOrg",
    "newbalanceOrig",
    "oldbalanceDest",
    "newbalanceDest",
    "isFlaggedFraud",
]
SCALE_COLS = ["step", "hour", "day", "week", "log_amount", "balance_diff_orig"]
BINARY_COLS = ["high_risk_hour", "is_transfer_or_cashout", "dest_zero_balance"]
TYPE_COLS = ["type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT", "type_TRANSFER"]
FEATURE_COLS = [
    "step",
    "hour",
    "day",
    "week",
    "high_risk_hour",
    "is_transfer_or_cashout",
    "balance_diff_orig",
    "dest_zero_balance",
    "type_CASH_IN",
    "type_CASH_OUT",
    "type_DEBIT",
    "type_PAYMENT",
    "type_TRANSFER",
    "log_amount",
]
# Features the exploratory analysis ranks against the label (13 names).
CORRELATION_FEATURES = [
    "amount", "step", "hour", "day", "week",
    "high_risk_hour", "is_transfer_or_cashout",
    "balance_diff_orig", "dest_zero_balance",
    "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
]
# Seven columns of the exploratory correlation matrix.
MATRIX_COLS = [
    "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
    "balance_diff_orig", "amount", "isFraud",
]
CLASS_NAMES = {0: "Non-fraude", 1: "Fraude"}
AMOUNT_LIMIT = 200_000.0
STEPS_PER_DAY = 24
STEPS_PER_WEEK = 168

RAW_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])


def require_columns(df: DataFrame, columns, what: str = "operation") -> None:
    """Raise ``ValueError`` when any of ``columns`` is absent (A5)."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns for {what}: {missing}")


def numeric_columns(df: DataFrame, exclude=(TARGET, FLAG)) -> list[str]:
    """Numeric columns of ``df`` in schema order, minus label columns."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)
    ]
