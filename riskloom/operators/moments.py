"""Co-moments of many column pairs in one scan.

A partition's rows give, for every pair of columns, the count, both means and the centred second moments of the rows where both are
present (as pandas: null and NaN are missing).  Batches of a partition, and then the partitions, are merged by the pairwise update of
centred moments, so nothing is lost to cancellation however far the values lie from zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import num
from ..session import cut_lineage

_PARTS = ["n", "mx", "my", "xx", "yy", "xy"]


def _batch(x: np.ndarray) -> np.ndarray:
    """(6, columns, columns) moments of one batch, NaN for missing: count, means of the row and column variable, their moments."""
    there = ~np.isnan(x)
    m = there.astype(float)
    own = there.sum(axis=0)
    mean = np.where(own > 0, np.where(there, x, 0.0).sum(axis=0) / np.maximum(own, 1), 0.0)
    c = np.where(there, x - mean, 0.0)
    n = m.T @ m
    some = np.maximum(n, 1)
    s = c.T @ m                                          # sums of the row variable where the column variable is present
    mx = mean[:, None] + s / some
    xx = (c * c).T @ m - s * s / some
    xy = c.T @ c - s * s.T / some
    return np.stack([n, mx, mx.T, xx, xx.T, xy])


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    w = np.where(n > 0, a[0] * b[0] / np.maximum(n, 1), 0.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    share = b[0] / np.maximum(n, 1)
    return np.stack([n, a[1] + share * dx, a[2] + share * dy, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dy * dy, a[5] + b[5] + w * dx * dy])


def co_moments(df: DataFrame, columns) -> DataFrame:
    """(row, col, n, mx, my, xx, yy, xy): pairwise-complete centred moments of all pairs of ``columns``."""
    columns = list(dict.fromkeys(columns))
    names = [f"x{k}" for k in range(len(columns))]
    k = len(columns)

    def run(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            if batch.num_rows:
                total = _merge(total, _batch(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)])))
        at = np.arange(k * k)
        yield pa.record_batch([pa.array(at // k, pa.int32()), pa.array(at % k, pa.int32()), *map(pa.array, total.reshape(6, -1))], names=["i", "j", *_PARTS])

    parts = df.select(*[num(c).alias(n) for c, n in zip(columns, names, strict=True)]) \
        .mapInArrow(run, "i int, j int, " + ", ".join(f"{p} double" for p in _PARTS)).filter("n > 0")
    parts = cut_lineage(parts)                            # columns x columns rows a partition; the input is read once
    # all partitions at once: the overall means first, then each partition's moments moved to them
    whole = parts.groupBy("i", "j").agg(F.sum("n").alias("w_n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("w_mx"),
                                        (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("w_my"))
    dx, dy, n = F.col("mx") - F.col("w_mx"), F.col("my") - F.col("w_my"), F.col("n")
    out = (parts.alias("p").join(F.broadcast(whole).alias("w"), ["i", "j"])                      # columns x columns rows
           .groupBy("i", "j").agg(F.first("w_n").alias("n"), F.first("w_mx").alias("mx"), F.first("w_my").alias("my"), F.sum(F.col("xx") + n * dx * dx).alias("xx"),
                                  F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy")))
    name = F.array(*[F.lit(c) for c in columns])
    return out.select(name[F.col("i")].alias("row"), name[F.col("j")].alias("col"), *_PARTS)


def correlations(df: DataFrame, rows, cols) -> DataFrame:
    """(row, col, corr) for each of ``rows`` with each of ``cols``: Pearson on pairwise-complete rows, null where a side is constant."""
    rows, cols = list(rows), list(cols)
    wanted = df.sparkSession.createDataFrame([(a, b) for a in rows for b in cols], "row string, col string")
    m = co_moments(df, [*rows, *cols])
    r = F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))
    return wanted.join(F.broadcast(m), ["row", "col"], "left").select("row", "col", F.when((F.col("xx") > 0) & (F.col("yy") > 0), r).alias("corr"))
