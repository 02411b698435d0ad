"""Data-quality checks (C1-C16), each a single aggregation pass where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import num
from ..functions.moments import pct
from ..schema import KEY, SCALE_COLS, TARGET
from ..session import cut_lineage
from .sketches import Bloom, row_digest
from .stats import numeric_correlation_ranking


def _explode_structs(items):
    return F.explode(F.array(*items))


def missing_values(df: DataFrame, digits: int = 6) -> DataFrame:                   # C1
    """Null (and NaN for floating columns) count and percentage per column, one pass."""
    def miss(f):
        c = F.col(f.name)
        cond = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cond = cond | F.isnan(c)
        return F.count_if(cond).alias(f.name)

    fields = df.schema.fields
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[miss(f) for f in fields])
    return wide.select(F.col("_n"), _explode_structs([
        F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("m")) for f in fields]).alias("u")) \
        .select(F.col("u.column").alias("column"), F.col("u.m").cast("bigint").alias("missing_values"),
                F.round(pct(F.col("u.m"), F.col("_n")), digits).alias("percentage")) \
        .orderBy(F.desc("percentage"), "column")


def _repeated(df: DataFrame, columns) -> tuple[DataFrame, Bloom | None]:
    """``df``'s columns with a 128-bit digest of each row, and a Bloom filter of the digests that occur twice (None: none does).

    Only digests are shuffled, so the bytes a row don't grow with its width; identical rows meet before the shuffle already.
    """
    keyed = df.select(*columns).withColumns(row_digest(columns))
    twice = cut_lineage(keyed.groupBy("_hi", "_lo").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hi", "_lo"))
    return keyed, Bloom.of(twice, ["_hi", "_lo"])


def duplicate_count(df: DataFrame, columns=None) -> DataFrame:                     # C2
    """Rows equal to an earlier row on all ``columns``: rows whose digest occurs once are only counted, the others compared whole."""
    columns = list(columns or [c for c in df.columns if c != KEY])
    keyed, bloom = _repeated(df, columns)
    if bloom is None:
        return keyed.agg(F.lit(0).cast("bigint").alias("n_duplicates"), F.count(F.lit(1)).cast("bigint").alias("n_distinct"))
    maybe = F.col("_maybe")
    rows = bloom.mark(keyed, "_maybe").groupBy("_maybe", *[F.when(maybe, F.col(c)).alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.sum(F.when(maybe, F.col("_n") - 1)), F.lit(0))       # the rows that can't repeat are one group
    return rows.agg(n.cast("bigint").alias("n_duplicates"), F.sum(F.when(maybe, F.lit(1)).otherwise(F.col("_n"))).cast("bigint").alias("n_distinct"))


def drop_duplicates(df: DataFrame, columns=None) -> DataFrame:                     # C3
    """The distinct rows on ``columns``; rows whose digest occurs once stay where they are, only the others are shuffled whole."""
    columns = list(columns or [c for c in df.columns if c != KEY])
    keyed, bloom = _repeated(df, columns)
    if bloom is None:
        return keyed.select(*columns)
    marked = bloom.mark(keyed, "_maybe")
    return marked.filter("not _maybe").select(*columns).unionAll(marked.filter("_maybe").select(*columns).dropDuplicates())


def class_imbalance(df: DataFrame, target: str = TARGET, digits: int = 6) -> DataFrame:   # C4
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    cnt = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    tot = cnt.agg(F.sum("count").alias("total_rows"), F.max("count").alias("major"),
                  F.min("count").alias("minor"))
    return cnt.crossJoin(tot).select(          # tot is a single row
        F.col(target).alias("class"), F.col("count").cast("bigint").alias("count"),
        F.round(F.col("count") * 100.0 / F.col("total_rows"), digits).alias("percentage"),
        F.col("total_rows").cast("bigint").alias("total_rows"),
        F.round(F.coalesce(F.try_divide(F.col("major").cast("double"), F.col("minor")),
                           F.lit(float("inf"))), digits).alias("imbalance_ratio"))


def class_distribution(df: DataFrame, label: str = TARGET, digits: int = 6) -> DataFrame:   # C5
    a = df.agg(F.count_if(F.col(label) == 1).alias("f"), F.count_if(F.col(label) == 0).alias("l"),
               F.count(F.lit(1)).alias("n"))
    return a.select(F.col("f").cast("bigint").alias("n_fraud"), F.col("l").cast("bigint").alias("n_legit"),
                    F.round(pct(F.col("f"), F.col("n")), digits).alias("pct_fraud"),
                    F.round(pct(F.col("l"), F.col("n")), digits).alias("pct_legit"),
                    F.round(F.try_divide(F.col("l").cast("double"), F.col("f")), digits).alias("ratio"))


def value_counts(df: DataFrame, column: str) -> DataFrame:                         # C6
    return df.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("count")) \
        .orderBy(F.desc("count"), column)


def distinct_accounts(df: DataFrame, columns=("nameOrig", "nameDest"), exact: bool = True) -> DataFrame:  # C7
    fn = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(*[fn(c).cast("bigint").alias(f"n_{c}") for c in columns])


def table_profile(df: DataFrame) -> DataFrame:                                     # C8
    """Row count, column count and per-column type (schema from metadata, one count)."""
    n = df.count()
    rows = [(i, f.name, f.dataType.simpleString(), n, len(df.columns))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, n_rows bigint, n_columns int")


def sample_reproducibility(sample: DataFrame, expected_rows: int, expected_frauds: int,
                           label: str = TARGET) -> DataFrame:                      # C9
    a = sample.agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("frauds"))
    return a.select(F.col("rows").cast("bigint").alias("rows"), F.col("frauds").cast("bigint").alias("frauds"),
                    F.lit(int(expected_rows)).cast("bigint").alias("expected_rows"),
                    F.lit(int(expected_frauds)).cast("bigint").alias("expected_frauds"),
                    ((F.col("rows") == expected_rows) & (F.col("frauds") == expected_frauds)).alias("ok"))


def stratification_check(df: DataFrame, label: str = TARGET, split: str = "split",
                         tol: float = 5e-4, digits: int = 8) -> DataFrame:           # C10
    every = Window.partitionBy()                                # over a row a split
    per = df.groupBy(split).agg(F.sum(label).alias("f"), F.count(label).alias("n"))
    j = per.select(split, F.try_divide("f", "n").alias("rate"), F.try_divide(F.sum("f").over(every), F.sum("n").over(every)).alias("global_rate"))
    diff = F.abs(F.col("rate") - F.col("global_rate"))
    return j.select(split, F.round("rate", digits).alias("rate"),
                    F.round("global_rate", digits).alias("global_rate"),
                    F.round(diff, digits).alias("abs_diff"), (diff < tol).alias("ok"))


def validate_features(df: DataFrame, target_col: str = TARGET) -> DataFrame:       # C11
    """Ranges of hour/day/week; risk ratio > 5; dest-zero fraud % > 1.5; corr > 0.30.

    One aggregation pass; label checks are omitted when there is no label or no fraud.
    """
    has_label = target_col in df.columns
    aggs = []
    for c in ["hour", "day", "week"]:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    if has_label:
        y = F.col(target_col)
        aggs += [F.sum(y).alias("n_fraud"),
                 F.avg(F.when(F.col("high_risk_hour") == 1, y)).alias("r1"),
                 F.avg(F.when(F.col("high_risk_hour") == 0, y)).alias("r0"),
                 F.avg(F.when(F.col("dest_zero_balance") == 1, y)).alias("dz"),
                 F.corr(F.col("balance_diff_orig").cast("double"), y.cast("double")).alias("corr")]
    a = df.agg(*aggs)
    rows = []
    for c, (lo, hi) in [("hour", (0, 23)), ("day", (0, 30)), ("week", (0, 4))]:
        rows.append(F.struct(F.lit(c).alias("check"), F.lit(None).cast("double").alias("value"),
                             F.col(f"{c}_min").cast("bigint").alias("range_min"),
                             F.col(f"{c}_max").cast("bigint").alias("range_max"),
                             F.lit(f"[{lo}, {hi}]").alias("expected"),
                             ((F.col(f"{c}_min") == lo) & (F.col(f"{c}_max") == hi)).alias("ok")))
    if has_label:
        ratio = F.when(F.col("r0") > 0, F.col("r1") / F.col("r0")).otherwise(F.lit(0.0))
        dz = F.col("dz") * 100
        for name, val, exp, ok in [
            ("high_risk_hour_ratio", F.round(ratio, 2), "> 5.0", ratio > 5.0),
            ("dest_zero_balance_fraud_pct", F.round(dz, 4), "> 1.5", dz > 1.5),
            ("balance_diff_orig_corr", F.round(F.col("corr"), 4), "> 0.30", F.col("corr") > 0.30),
        ]:
            rows.append(F.struct(F.lit(name).alias("check"), val.cast("double").alias("value"),
                                 F.lit(None).cast("bigint").alias("range_min"),
                                 F.lit(None).cast("bigint").alias("range_max"),
                                 F.lit(exp).alias("expected"), ok.alias("ok")))
        out = a.select(F.col("n_fraud"), _explode_structs(rows).alias("u"))
        out = out.filter(F.col("u.range_min").isNotNull() | (F.col("n_fraud") > 0))
        return out.select("u.*")
    return a.select(_explode_structs(rows).alias("u")).select("u.*")


def scaling_check(df: DataFrame, columns=None, split: str = "train", tol: float = 0.01,
                  digits: int = 6) -> DataFrame:                                    # C12
    columns = list(SCALE_COLS if columns is None else columns)
    src = df.filter(F.col("split") == split) if split and "split" in df.columns else df
    wide = src.agg(*[F.struct(F.lit(c).alias("column"), F.avg(num(c)).alias("mean"),
                              F.stddev_samp(num(c)).alias("std")).alias(c) for c in columns])
    long = wide.select(_explode_structs([F.col(c) for c in columns]).alias("u")).select("u.*")
    return long.select("column", F.round("mean", digits).alias("mean"), F.round("std", digits).alias("std"),
                       ((F.abs("mean") < tol) & (F.abs(F.col("std") - 1) < tol)).alias("ok"))


def drift_check(df: DataFrame, columns=None, a: str = "train", b: str = "test",
                tol: float = 0.15, digits: int = 6) -> DataFrame:                   # C13
    columns = list(SCALE_COLS if columns is None else columns)
    wide = df.agg(*[F.struct(F.lit(c).alias("column"),
                             F.avg(F.when(F.col("split") == a, num(c))).alias("mean_a"),
                             F.avg(F.when(F.col("split") == b, num(c))).alias("mean_b")).alias(c)
                    for c in columns])
    long = wide.select(_explode_structs([F.col(c) for c in columns]).alias("u")).select("u.*")
    d = F.abs(F.col("mean_a") - F.col("mean_b"))
    return long.select("column", F.round("mean_a", digits).alias(f"mean_{a}"),
                       F.round("mean_b", digits).alias(f"mean_{b}"), F.round(d, digits).alias("abs_diff"),
                       (d < tol).alias("ok"))


def smote_quality(smoted: DataFrame, column: str = "log_amount", label: str = TARGET,
                  tol: float = 1.0, digits: int = 6) -> DataFrame:                  # C14
    m = smoted.filter(F.col(label) == 1).agg(
        F.avg(F.when(F.col("is_synthetic") == 0, F.col(column))).alias("real"),
        F.avg(F.when(F.col("is_synthetic") == 1, F.col(column))).alias("synthetic"),
        F.count_if(F.col("is_synthetic") == 1).alias("n_synthetic"))
    d = F.abs(F.col("real") - F.col("synthetic"))
    return m.select(F.round("real", digits).alias("mean_real"), F.round("synthetic", digits).alias("mean_synthetic"),
                    F.col("n_synthetic").cast("bigint").alias("n_synthetic"),
                    F.round(d, digits).alias("abs_diff"), (d < tol).alias("ok"))


def no_positive_in_normal(normal: DataFrame, label: str = TARGET) -> DataFrame:    # C15
    return normal.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                      F.coalesce(F.sum(label), F.lit(0)).cast("bigint").alias("positives")) \
        .withColumn("ok", F.col("positives") == 0)


def leakage_alert(df: DataFrame, label: str = TARGET, limit: float = 0.5) -> DataFrame:   # C16
    return numeric_correlation_ranking(df, label).filter(F.col("abs_corr") > limit)

