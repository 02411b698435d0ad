"""Aggregations and statistics.

Every operator is one (or a few) aggregation jobs with partial (map-side) aggregation;
wide results are reshaped with ``stack``/``explode`` of literal arrays, never with a
driver loop over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.moments import kurt_sample, pct, skew_sample
from ..schema import AMOUNT_LIMIT, CORRELATION_FEATURES, FLAG, KEY, MATRIX_COLS, TARGET, numeric_columns
from .moments import correlations
from .ordered import exact_quantiles, join_groups
from .sketches import top_values

QUARTILES = [0.25, 0.5, 0.75]


def _r(col, digits):
    return F.round(col, digits) if digits is not None else col


def _unpivot_struct(names, make) -> F.Column:
    """explode(array(struct(name, ...) per name)) — a wide row into long rows."""
    return F.explode(F.array(*[make(n) for n in names]))


def describe(df: DataFrame, columns=None, digits: int | None = 4, by=(),
             approx_quantiles: bool = False) -> DataFrame:                                  # D1 / D2
    """count/mean/std(ddof 1)/min/25%/50%/75%/max per numeric column (long rows).

    Exact quantiles (distributed, see ``ordered.exact_quantiles``), not ``summary()``;
    ``approx_quantiles=True`` uses one ``percentile_approx`` pass instead.
    """
    by = list(by)
    columns = columns or [c for c in numeric_columns(df, exclude=()) if c != KEY and c not in by]
    v = C.num        # NaN counts as missing, as in pandas
    wide = df.groupBy(*by).agg(*[
        F.struct(F.lit(c).alias("column"), F.count(v(c)).cast("bigint").alias("count"), F.avg(v(c)).alias("mean"),
                 F.stddev_samp(v(c)).alias("std"), F.min(v(c)).cast("double").alias("min"),
                 F.max(v(c)).cast("double").alias("max")).alias(f"_{k}")
        for k, c in enumerate(columns)])
    long = wide.select(*by, F.explode(F.array(*[f"_{k}" for k in range(len(columns))])).alias("_s")).select(*by, "_s.*")
    q = exact_quantiles(df, columns, QUARTILES, by=by, approx=approx_quantiles)
    qw = q.groupBy(*by, "column").agg(*[
        F.max(F.when(F.col("qi") == i, F.col("quantile"))).alias(name)
        for i, name in enumerate(["p25", "p50", "p75"])])
    same = F.col("l.column") == F.col("q.column")
    for k in by:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"q.{k}"))        # a null group is a group
    out = long.alias("l").join(qw.alias("q"), same, "left").select("l.*", "q.p25", "q.p50", "q.p75")
    return out.select(*by, "column", "count",
                      *[_r(F.col(c), digits).alias(c)
                        for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def grouped_describe(df: DataFrame, value: str = "amount", by: str = FLAG,
                     where=None, digits: int | None = 4) -> DataFrame:             # D2
    """D1 of ``value`` per ``by`` (default: amount per isFlaggedFraud within frauds)."""
    src = df.filter(F.col(TARGET) == 1) if where is None else df.filter(where)
    return describe(src.select(by, value), [value], digits, by=[by]).drop("column")


def fraud_by_type(df: DataFrame, label: str = TARGET) -> DataFrame:                # D3
    return (df.groupBy("type")
            .agg(F.count(label).cast("bigint").alias("total"),
                 F.sum(label).cast("bigint").alias("nb_fraudes"),
                 F.round(F.avg(label) * 100, 4).alias("taux_fraude_pct"))
            .orderBy(F.desc("taux_fraude_pct"), "type"))


def fraud_rate_by(df: DataFrame, key: str, label: str = TARGET) -> DataFrame:      # D4 / D5
    """mean, count, sum and pct of the label per ``key`` (hour, day, week, ...)."""
    return (df.groupBy(key)
            .agg(F.round(F.avg(label), 6).alias("fraud_rate"),
                 F.count(label).cast("bigint").alias("total_txn"),
                 F.sum(label).cast("bigint").alias("nb_fraud"),
                 F.round(F.avg(label) * 100, 6).alias("fraud_rate_pct")))


def derive_high_risk_hours(df: DataFrame, label: str = TARGET, key: str = "hour") -> DataFrame:  # D6
    """Hours whose fraud rate exceeds the global rate, which comes from the grouped rows (a row an hour)."""
    every = Window.partitionBy()
    per = df.groupBy(key).agg(F.sum(label).alias("f"), F.count(label).alias("n"))
    return (per.select(key, F.try_divide("f", "n").alias("fraud_rate"), F.try_divide(F.sum("f").over(every), F.sum("n").over(every)).alias("global_rate"))
            .filter(F.col("fraud_rate") > F.col("global_rate"))
            .select(key, F.round("fraud_rate", 6).alias("fraud_rate"),
                    F.round("global_rate", 6).alias("global_rate"))
            .orderBy(key))


def risk_ratio(df: DataFrame, flag: str = "high_risk_hour", label: str = TARGET) -> DataFrame:   # D7
    """Fraud rate % where flag=1 and flag=0 and their ratio; absent class → 0 / 1."""
    r1 = F.avg(F.when(F.col(flag) == 1, F.col(label))) * 100
    r0 = F.avg(F.when(F.col(flag) == 0, F.col(label))) * 100
    return df.agg(F.coalesce(r1, F.lit(0.0)).alias("r1"), F.coalesce(r0, F.lit(1.0)).alias("r0")) \
        .select(F.round("r1", 6).alias("rate_flag1_pct"), F.round("r0", 6).alias("rate_flag0_pct"),
                F.round(F.try_divide(F.col("r1"), F.col("r0")), 6).alias("ratio"))


def skew_kurtosis(df: DataFrame, columns=("amount",), digits: int = 6) -> DataFrame:     # D8
    return df.select(_unpivot_struct(list(columns), lambda c: F.struct(
        F.lit(c).alias("column"), C.num(c).alias("v"))).alias("u")) \
        .groupBy(F.col("u.column").alias("column")) \
        .agg(F.round(skew_sample("u.v"), digits).alias("skewness"),
             F.round(kurt_sample("u.v"), digits).alias("kurtosis"))


def amount_summary(df: DataFrame, value: str = "amount", digits: int = 6) -> DataFrame:   # D9
    med = exact_quantiles(df, [value], [0.5]).select(F.col("quantile").alias("median"))
    agg = df.agg(F.avg(C.num(value)).alias("mean"), F.max(C.num(value)).alias("max"))
    return agg.crossJoin(med).select(   # both sides are one row
        F.round("median", digits).alias("median"), F.round("mean", digits).alias("mean"),
        F.round("max", digits).alias("max"),
        F.round(F.try_divide(F.col("max"), F.col("median")), digits).alias("max_to_median"))


def quantile_bins(df: DataFrame, value: str, q: int = 10) -> tuple[DataFrame, list[float]]:
    """Attach ``bin`` like ``pd.qcut(..., q, duplicates='drop')`` (right-closed, lowest
    included).  Edges are exact distributed quantiles; the bin is the count of interior
    edges below the value (≤ q-1 literal comparisons, codegen'd)."""
    probs = [i / q for i in range(q + 1)]
    rows = exact_quantiles(df, [value], probs).orderBy("qi").collect()
    edges = sorted({r["quantile"] for r in rows if r["quantile"] is not None})
    interior = edges[1:-1]
    b = sum((F.when(F.col(value) > F.lit(e), 1).otherwise(0) for e in interior), F.lit(0))
    return df.withColumn("bin", b.cast("int")), edges


def fraud_by_amount_decile(df: DataFrame, value: str = "amount", label: str = TARGET,
                           q: int = 10) -> DataFrame:                                  # D10
    binned, edges = quantile_bins(df.filter(F.col(value).isNotNull()), value, q)
    lo = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 2)
    return (binned.groupBy("bin")
            .agg(F.sum(label).cast("bigint").alias("nb_fraudes"),
                 F.count(F.lit(1)).cast("bigint").alias("total"),
                 F.round(F.avg(label) * 100, 4).alias("taux_pct"))
            .select("bin", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"),
                    "nb_fraudes", "total", "taux_pct"))


def flag_confusion(df: DataFrame, flag: str = FLAG, label: str = TARGET) -> DataFrame:   # D11
    return df.agg(
        F.count_if((F.col(flag) == 1) & (F.col(label) == 1)).cast("bigint").alias("tp"),
        F.count_if((F.col(flag) == 0) & (F.col(label) == 1)).cast("bigint").alias("fn"),
        F.count_if((F.col(flag) == 1) & (F.col(label) == 0)).cast("bigint").alias("fp"),
        F.sum(label).cast("bigint").alias("total_fraud"),
        F.sum(flag).cast("bigint").alias("flagged_total"))


def flag_baseline_metrics(df: DataFrame, flag: str = FLAG, label: str = TARGET,
                          digits: int = 6) -> DataFrame:                               # D12
    c = flag_confusion(df, flag, label)
    rec = C.safe_div(F.col("tp"), F.col("total_fraud"))
    prec = C.safe_div(F.col("tp"), F.col("flagged_total"))
    c = c.withColumns({"recall": rec, "precision": prec})
    f1 = C.safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.select("tp", "fn", "fp", F.round("recall", digits).alias("recall"),
                    F.round("precision", digits).alias("precision"),
                    F.round(f1, digits).alias("f1"))


def pearson(df: DataFrame, pairs) -> dict:
    """Pearson correlation of column pairs on pairwise-complete rows (as pandas): {pair: value or None}, from one scan."""
    pairs = [tuple(p) for p in pairs]
    got = correlations(df, {a for a, _ in pairs}, {b for _, b in pairs}).collect()                  # columns x columns rows
    value = {(r["row"], r["col"]): r["corr"] for r in got}
    return {p: value[p] for p in pairs}


def feature_label_corr(df: DataFrame, feature: str, label: str = TARGET,
                       digits: int = 6) -> DataFrame:                                  # D13
    return df.agg(F.round(F.corr(F.col(feature).cast("double"), F.col(label).cast("double")),
                          digits).alias("corr"))


def correlation_ranking(df: DataFrame, features=None, label: str = TARGET,
                        digits: int = 6) -> DataFrame:                                 # D14
    """Pearson correlation of each feature with the label, ranked by |corr|; one scan."""
    features = list(CORRELATION_FEATURES if features is None else features)
    out = correlations(df, features, [label])
    return (out.select(F.col("row").alias("feature"), F.round("corr", digits).alias("corr"), F.round(F.abs("corr"), digits).alias("abs_corr"))
            .orderBy(F.desc("abs_corr"), "feature"))


def numeric_correlation_ranking(df: DataFrame, label: str = TARGET, digits: int = 6) -> DataFrame:  # D15
    cols = [c for c in numeric_columns(df) if c != KEY]
    return correlation_ranking(df, cols, label, digits)


def correlation_matrix(df: DataFrame, columns=None, digits: int = 6) -> DataFrame:     # D16
    """All pairwise Pearson correlations, as long rows; one scan."""
    columns = list(MATRIX_COLS if columns is None else columns)
    return correlations(df, columns, columns).select("row", "col", F.round("corr", digits).alias("corr"))


def flag_rate_table(df: DataFrame, flags=("is_transfer_or_cashout", "dest_zero_balance",
                                          "high_risk_hour"), label: str = TARGET) -> DataFrame:  # D17
    flags = list(flags)
    long = df.select(F.col(label), _unpivot_struct(flags, lambda f: F.struct(
        F.lit(f).alias("feature"), F.col(f).cast("int").alias("value"))).alias("u"))
    return (long.groupBy("u.feature", "u.value")
            .agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                 F.sum(label).cast("bigint").alias("nb_fraudes"),
                 F.round(F.avg(label), 6).alias("taux_fraude")))


def grouped_mean_median_max(df: DataFrame, value: str, by: str, digits: int = 6) -> DataFrame:  # D18
    agg = df.groupBy(by).agg(F.avg(C.num(value)).alias("mean"), F.max(C.num(value)).alias("max"))
    med = exact_quantiles(df, [value], [0.5], by=[by]).select(by, F.col("quantile").alias("median"))
    return join_groups(agg, med, [by]).select(
        by, F.round("mean", digits).alias("mean"), F.round("median", digits).alias("median"),
        F.round("max", digits).alias("max"))


def frauds_per_client(df: DataFrame, account: str = "nameOrig", label: str = TARGET,
                      digits: int = 6) -> DataFrame:                                    # D19
    """Fraud count per account (two-level aggregation) and a summary of those counts."""
    per = df.filter(F.col(label) == 1).groupBy(account).agg(F.count(F.lit(1)).alias("n"))
    summ = per.agg(
        F.count_if(F.col("n") >= 1).cast("bigint").alias("clients_ge1"),
        F.count_if(F.col("n") == 1).cast("bigint").alias("clients_eq1"),
        F.count_if(F.col("n") >= 2).cast("bigint").alias("clients_ge2"),
        F.round(F.avg("n"), digits).alias("mean"),
        F.round(F.stddev_samp("n"), digits).alias("std"),
        F.min("n").cast("bigint").alias("min"),
        F.max("n").cast("bigint").alias("max"))
    qs = exact_quantiles(per, ["n"], QUARTILES).groupBy().agg(*[
        F.max(F.when(F.col("qi") == i, F.round("quantile", digits))).alias(nm)
        for i, nm in enumerate(["p25", "p50", "p75"])])
    return summ.crossJoin(qs)          # one row each


def type_mix(df: DataFrame, by: str, key: str = "type", digits: int = 6) -> DataFrame:   # D20
    """Share % of each ``key`` level inside each ``by`` group (a null group is a group); totals come from the grouped rows."""
    cnt = df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))                   # a row a level
    return cnt.select(by, key, F.round(F.col("n") * 100.0 / total, digits).alias("share_pct"))


def top_fraud_destinations(df: DataFrame, n: int = 20, account: str = "nameDest",
                           label: str = TARGET) -> DataFrame:                          # D21
    """Top-n accounts by fraud count (ties by name)."""
    return top_values(df.filter(F.col(label) == 1), account, n, "n_fraud")


def split_summary(df: DataFrame, label: str = TARGET, split: str = "split") -> DataFrame:   # D22
    return (df.groupBy(split)
            .agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
                 F.sum(label).cast("bigint").alias("frauds"),
                 F.round(F.avg(label) * 100, 6).alias("fraud_rate_pct")))


def column_stats_by_split(df: DataFrame, columns, split: str = "split", digits: int = 6) -> DataFrame:  # D23
    columns = list(columns)
    long = df.select(split, _unpivot_struct(columns, lambda c: F.struct(
        F.lit(c).alias("column"), C.num(c).alias("v"))).alias("u"))
    return (long.groupBy(split, "u.column")
            .agg(F.round(F.avg("u.v"), digits).alias("mean"),
                 F.round(F.stddev_samp("u.v"), digits).alias("std"),
                 F.round(F.min("u.v"), digits).alias("min"),
                 F.round(F.max("u.v"), digits).alias("max")))


def id_prefix_counts(df: DataFrame, columns=("nameOrig", "nameDest")) -> DataFrame:      # B16
    columns = list(columns)
    long = df.select(_unpivot_struct(columns, lambda c: F.struct(
        F.lit(c).alias("column"), F.substring(F.col(c), 1, 1).alias("prefix"))).alias("u"))
    return long.groupBy("u.column", "u.prefix").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def merchant_client_split(df: DataFrame, label: str = TARGET, digits: int = 6) -> DataFrame:  # B17
    """Rows with destination balances 0/0, split by M/C prefix, in one pass."""
    zero = (F.col("oldbalanceDest") == 0) & (F.col("newbalanceDest") == 0)
    merchant = zero & F.col("nameDest").startswith("M")
    client = zero & F.col("nameDest").startswith("C")
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(zero).alias("n_zero"),
        F.sum(F.when(zero, F.col(label))).alias("zero_frauds"),
        F.avg(F.when(zero, F.col(label))).alias("zero_rate"),
        F.count_if(merchant).alias("n_merchant"),
        F.count_if(client).alias("n_client"),
        F.avg(F.when(client, F.col(label))).alias("client_rate"),
        F.avg(F.when(merchant, F.col(label))).alias("merchant_rate"),
        F.avg(label).alias("global_rate"))
    return agg.select(
        F.col("total").cast("bigint").alias("total"), F.col("n_zero").cast("bigint").alias("n_zero"),
        F.round(pct(F.col("n_zero"), F.col("total")), digits).alias("zero_pct"),
        F.coalesce(F.col("zero_frauds"), F.lit(0)).cast("bigint").alias("zero_frauds"),
        F.round(F.col("zero_rate") * 100, digits).alias("zero_fraud_rate_pct"),
        F.col("n_merchant").cast("bigint").alias("n_merchant"),
        F.col("n_client").cast("bigint").alias("n_client"),
        F.round(F.col("merchant_rate") * 100, digits).alias("merchant_fraud_rate_pct"),
        F.round(F.col("client_rate") * 100, digits).alias("client_fraud_rate_pct"),
        F.round(F.col("global_rate") * 100, digits).alias("global_fraud_rate_pct"))


def amount_under_threshold(df: DataFrame, limit: float = AMOUNT_LIMIT, label: str = TARGET,
                           value: str = "amount", digits: int = 6) -> DataFrame:       # B21
    fr = df.filter(F.col(label) == 1)
    return fr.agg(F.count_if(F.col(value) < limit).cast("bigint").alias("n_under"),
                  F.round(F.avg((F.col(value) < limit).cast("int")) * 100, digits).alias("pct_under"))
