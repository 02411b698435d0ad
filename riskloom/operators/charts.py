"""Tables behind the reference's figures (J1-J6); drawing is left to the caller.

Bin edges are computed once (tiny aggregates) and applied as literals, so each table is
one scan plus a small ``groupBy``.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TARGET
from .evaluate import linspace
from .ordered import exact_quantiles, join_groups
from .sampling import tag_by_rank


def histogram(df: DataFrame, column: str, bins: int = 50, by=(), digits: int = 6) -> DataFrame:   # J1
    """Equal-width histogram between the column's min and max (last bin closed)."""
    by = list(by)
    mm = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = (float(mm[k]) if mm[k] is not None else 0.0 for k in ("lo", "hi"))      # no value: no row
    norm = bins / (hi - lo) if hi > lo else 0.0
    b = F.least(F.floor((F.col(column) - F.lit(lo)) * F.lit(norm)), F.lit(bins - 1)).cast("int")
    width = (hi - lo) / bins if hi > lo else 0.0
    out = df.filter(F.col(column).isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"))
    return out.select(*by, "bin", F.round(F.lit(lo) + F.col("bin") * F.lit(width), digits).alias("lower"),
                      F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), digits).alias("upper"), "count")


def boxplot_stats(df: DataFrame, column: str, by: str = TARGET, digits: int = 6) -> DataFrame:   # J2
    """Quartiles, 1.5·IQR whiskers at the nearest data point inside the fences, outliers."""
    q = exact_quantiles(df, [column], [0.25, 0.5, 0.75], by=[by]).groupBy(by).agg(
        *[F.max(F.when(F.col("qi") == i, F.col("quantile"))).alias(n) for i, n in enumerate(["q1", "med", "q3"])])
    j = join_groups(df.select(by, column), F.broadcast(q), [by], "inner")          # one row per group
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    x = F.col(column)
    agg = j.groupBy(by, "q1", "med", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("whisker_low"), F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.count_if((x < lo_f) | (x > hi_f)).cast("bigint").alias("n_outliers"))
    return agg.select(by, *[F.round(c, digits).alias(c) for c in ["q1", "med", "q3", "whisker_low", "whisker_high"]],
                      "n_outliers")


def clipped_density_histogram(df: DataFrame, score: str, group: str, clip_source: DataFrame,
                              threshold: float, n_edges: int = 80, digits: int = 9) -> DataFrame:    # J3
    """Density histograms per group on edges ``linspace(0, clip, n_edges)``, values
    clipped to [0, clip], clip = max(p99.9 of ``clip_source``, 1.5·threshold)."""
    p999 = exact_quantiles(clip_source, [score], [0.999]).first()
    clip = max(float(p999["quantile"]) if p999 else 0.0, float(threshold) * 1.5)
    edges = linspace(0.0, clip, n_edges)
    nb = n_edges - 1
    width = clip / nb
    clipped = df.withColumn("_x", F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(clip)))
    bz = Bucketizer(splits=[float("-inf"), *edges[1:-1], float("inf")], inputCol="_x", outputCol="_b")
    counts = bz.transform(clipped).groupBy(group, F.col("_b").cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("count"))
    j = counts.withColumn("n", F.sum("count").over(Window.partitionBy(group)))           # a row a bin
    return j.select(group, "bin", F.col("count").cast("bigint").alias("count"),
                    F.round(F.col("count") / (F.col("n") * F.lit(width)), digits).alias("density"),
                    F.round(F.lit(clip), digits).alias("clip"))


def rate_series(df: DataFrame, key: str, label: str = TARGET, digits: int = 6) -> DataFrame:   # J5
    """Fraud rate % per bucket with the global rate % as a reference line."""
    every = Window.partitionBy()                                                          # over a row a bucket
    per = df.groupBy(key).agg(F.sum(label).alias("f"), F.count(label).alias("y"), F.count(F.lit(1)).cast("bigint").alias("n"))
    per = per.withColumns({"r": F.try_divide("f", "y"), "g": F.try_divide(F.sum("f").over(every), F.sum("y").over(every))})
    return per.select(
        key, "n", F.round(F.col("r") * 100, digits).alias("fraud_rate_pct"),
        F.round(F.col("g") * 100, digits).alias("global_rate_pct"))


def plot_rows(prepared: DataFrame, n: int = 5000, label: str = TARGET) -> DataFrame:   # J4
    """Rows of a scatter plot with ``part``: at most ``n`` normal training rows (in hash order), and all val rows by class."""
    normal = tag_by_rank(prepared.filter((F.col("split") == "train") & (F.col(label) == 0)), label, {0: [(n, "train_normal")]}, "part")
    val = prepared.filter(F.col("split") == "val").withColumn("part", F.when(F.col(label) == 1, "val_fraud").otherwise("val_legit"))
    return normal.filter(F.col("part") == "train_normal").unionByName(val)
