"""Feature engineering and row-local transforms.

Each operator is a single projection/filter (no shuffle), usable with
``DataFrame.transform`` and on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import COLS_TO_DROP, TYPE_LEVELS, TYPE_COLS, FEATURE_COLS, TARGET, require_columns


def add_hour(df: DataFrame) -> DataFrame:                      # B1
    return df.withColumn("hour", C.hour_of("step"))


def add_day(df: DataFrame) -> DataFrame:                       # B2
    return df.withColumn("day", C.day_of("step"))


def add_week(df: DataFrame) -> DataFrame:                      # B3
    return df.withColumn("week", C.week_of("step"))


def add_is_weekend(df: DataFrame) -> DataFrame:                # B4
    if "day" not in df.columns:
        df = add_day(df)
    return df.withColumn("is_weekend", C.is_weekend_of("day"))


def temporal_features(df: DataFrame, include_is_weekend: bool = False) -> DataFrame:   # B5
    require_columns(df, ["step"], "temporal_features")
    out = df.withColumns({"hour": C.hour_of("step"), "day": C.day_of("step"),
                          "week": C.week_of("step")})
    if include_is_weekend:
        out = out.withColumn("is_weekend", C.is_weekend_of("day"))
    return out


def add_high_risk_hour(df: DataFrame, high_risk_hours=None) -> DataFrame:   # B6
    return df.withColumn("high_risk_hour", C.high_risk_hour_of("hour", high_risk_hours))


def add_transfer_cashout_flag(df: DataFrame) -> DataFrame:     # B7
    return df.withColumn("is_transfer_or_cashout", C.transfer_cashout_of("type"))


def add_balance_diff_orig(df: DataFrame) -> DataFrame:         # B8
    return df.withColumn("balance_diff_orig", C.balance_diff_of())


def add_dest_zero_balance(df: DataFrame) -> DataFrame:         # B9
    return df.withColumn("dest_zero_balance", C.dest_zero_balance_of())


def build_features(df: DataFrame, high_risk_hours=None) -> DataFrame:    # B10
    """Original columns + hour, day, week, high_risk_hour, is_transfer_or_cashout,
    balance_diff_orig, dest_zero_balance — one projection."""
    require_columns(df, ["step", "type", "oldbalanceOrg", "newbalanceOrig", "nameDest",
                         "oldbalanceDest", "newbalanceDest"], "build_features")
    hour = C.hour_of("step")
    return df.select(
        "*",
        hour.alias("hour"),
        C.day_of("step").alias("day"),
        C.week_of("step").alias("week"),
        C.high_risk_hour_of(hour, high_risk_hours).alias("high_risk_hour"),
        C.transfer_cashout_of("type").alias("is_transfer_or_cashout"),
        C.balance_diff_of().alias("balance_diff_orig"),
        C.dest_zero_balance_of().alias("dest_zero_balance"),
    )


def drop_leakage_columns(df: DataFrame, cols_to_drop=None) -> DataFrame:   # B11
    cols = COLS_TO_DROP if cols_to_drop is None else cols_to_drop
    return df.drop(*[c for c in cols if c in df.columns])


def encode_type(df: DataFrame, levels=None, check: bool = True) -> DataFrame:   # B12
    """One-hot ``type`` with every level kept, in sorted level order; drops ``type``.

    With ``check`` a missing expected level raises ``ValueError`` (one tiny distinct
    aggregate; skip it on streams).
    """
    levels = sorted(TYPE_LEVELS if levels is None else levels)
    if check:
        # one count per expected level: bounded by the level list whatever the column holds
        row = df.agg(*[F.count_if(F.col("type") == lvl).alias(lvl) for lvl in levels]).first()
        missing = [lvl for lvl in levels if not row[lvl]]
        if missing:
            raise ValueError(f"type levels missing after one-hot encoding: {missing}")
    cols = [c for c in df.columns if c != "type"]
    return df.select(*cols, *[C.flag(F.col("type") == lvl).alias(f"type_{lvl}") for lvl in levels])


def onehot_check(df: DataFrame, type_cols=None) -> DataFrame:      # B13
    """One row: rows whose active one-hot count != 1, and the total of every level."""
    type_cols = TYPE_COLS if type_cols is None else type_cols
    active = sum((F.col(c) for c in type_cols), F.lit(0))
    return df.agg(
        F.count_if(active != 1).cast("bigint").alias("bad_rows"),
        *[F.sum(c).cast("bigint").alias(f"n_{c}") for c in type_cols],
    )


def log_transform_amount(df: DataFrame) -> DataFrame:          # B14
    """Adds ``log_amount = ln(1+amount)`` and drops ``amount`` (skews: stats.skewness)."""
    return df.withColumn("log_amount", C.log1p_of("amount")).drop("amount")


def balance_anomalies(df: DataFrame) -> DataFrame:             # B15
    require_columns(df, ["oldbalanceOrg", "newbalanceOrig", "amount"], "balance_anomalies")
    out = df.withColumns({
        "observed_delta_orig": F.col("oldbalanceOrg") - F.col("newbalanceOrig"),
    })
    out = out.withColumns({
        "balance_gap_vs_amount": F.col("observed_delta_orig") - F.col("amount"),
        "is_balance_anomaly": ~F.coalesce(C.isclose("observed_delta_orig", "amount"), F.lit(False)),
    })
    return out.filter(F.col("is_balance_anomaly"))


def feature_projection(df: DataFrame, feature_cols=None, keep=(TARGET,)) -> DataFrame:   # B19
    feature_cols = FEATURE_COLS if feature_cols is None else feature_cols
    extra = [c for c in keep if c in df.columns and c not in feature_cols]
    return df.select(*feature_cols, *extra)


def normal_rows(df: DataFrame, split: str | None = "train", label: str = TARGET) -> DataFrame:  # B20
    cond = F.col(label) == 0
    if split is not None and "split" in df.columns:
        cond = cond & (F.col("split") == split)
    return df.filter(cond)


def with_class_name(df: DataFrame, label: str = TARGET, name: str = "class_name") -> DataFrame:  # B22
    return df.withColumn(name, C.class_name_of(label))


def threshold_classify(df: DataFrame, threshold: float = 0.5, score: str = "score",
                       out: str = "prediction") -> DataFrame:     # B23
    return df.withColumn(out, C.classify(score, threshold))
