"""Distributed order statistics: exact quantiles and running totals, one path at every size.

Neither uses a window without a partition (one task) nor the ``percentile`` aggregate's single
final merge (all distinct values in one task).

* Running totals in two levels: cut points from a quantile sketch part the order values into coarse buckets, a
  bounded number of them a core; the buckets' totals are added up first (a row a group and bucket) and go back to the rows as
  one more row at the head of each bucket, so a single window inside the buckets finishes the sums without a join.
* Quantiles: approximate quantiles a little below and above each wanted one cut the values into
  buckets; counts tell which bucket holds a wanted rank; only those buckets' values, collapsed to
  (value, count) rows so that a hot value is one row, get running totals.

Offsets, ranks and counts stay in DataFrames, so neither the number of groups nor that of rows bounds what works.
Group keys are compared null-safely.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_BUCKET = 100_000  # rows of a coarse bucket of running totals, unless that gives too many
BUCKETS_PER_CORE = 4       # most buckets, for each core of the session
APPROX_ACCURACY = 10_000
SKETCH_MAX_K = 65_535      # KLL parameter: a rank error of about 0.01 %
MERGERS = 64               # tasks that merge the partitions' sketches before the last one


def _splits(bounds) -> list[float]:
    vals = sorted({float(b) for b in (bounds or []) if b is not None and not math.isnan(b)})
    return [-math.inf, *[v for v in vals if not math.isinf(v)], math.inf]


def _same(a: str, b: str, keys):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def join_groups(a: DataFrame, b: DataFrame, by, how: str = "left") -> DataFrame:
    """``a`` with the columns of ``b``, joined on the group columns ``by`` null-safely: a null group is a group."""
    by = list(by)
    if not by:
        return a.crossJoin(b)                   # one row each
    rest = [F.col(f"b.{c}").alias(c) for c in b.columns if c not in by]
    return a.alias("a").join(b.alias("b"), _same("a", "b", by), how).select("a.*", *rest)


def _brackets(probs: list[float]) -> list[float]:
    """Approximate quantiles asked for: each wanted one is bracketed by twice the rank error on both sides."""
    e = 2.0 / APPROX_ACCURACY
    return sorted({min(1.0, max(0.0, q)) for p in probs for q in (p - e, p + e)})


def _bucketed(src: DataFrame, by, columns, probs) -> DataFrame:
    """Long rows (by, column, bucket, value) of the non-null, non-NaN values."""
    row = src.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), _brackets(probs), APPROX_ACCURACY).alias(c) for c in columns]).first()
    b = Bucketizer(inputCols=columns, outputCols=[f"_b_{c}" for c in columns],
                   splitsArray=[_splits(row[c]) if len(_splits(row[c])) > 2 else [-math.inf, 0.0, math.inf] for c in columns], handleInvalid="keep")
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").cast("int").alias("bucket"), F.col(c).alias("value")) for c in columns])
    valid = F.filter(items, lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]))
    return b.transform(src).select(*by, F.explode(valid).alias("_s")).select(*by, "_s.*")


def exact_quantiles(df: DataFrame, columns, probs, by=(), approx: bool = False,
                    accuracy: int = APPROX_ACCURACY) -> DataFrame:
    """Exact linear-interpolated quantiles (NumPy/pandas default) of ``columns``.

    Returns long rows ``(*by, column, qi, prob, quantile)``; nulls and NaN are ignored.
    ``approx=True`` trades exactness for a single ``percentile_approx`` pass (rank error
    about n/accuracy, no interpolation).
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    by = list(by)
    probs = [float(p) for p in probs]
    src = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    if approx:
        clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
        wide = src.groupBy(*by).agg(*[F.percentile_approx(clean[c], probs, accuracy).alias(c) for c in columns])
        return _approx_long(wide, by, columns, probs)
    src = cut_lineage(src)                     # read three times: cut points, bucket counts, values
    long = _bucketed(src, by, columns, probs)
    group, keys = [*by, "column"], [*by, "column", "bucket"]
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)      # a row a bucket
    counts = (long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
              .withColumns({"start": F.coalesce(F.sum("cnt").over(before), F.lit(0)), "n": F.sum("cnt").over(Window.partitionBy(*group))}))
    ask = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(p).alias("prob")) for i, p in enumerate(probs)])
    pos = F.col("prob") * (F.col("n") - 1)
    asked = (counts.withColumn("_a", F.explode(ask)).select(*keys, "cnt", "start", "n", "_a.*")
             .withColumns({"frac": pos - F.floor(pos), "lo": F.floor(pos), "hi": F.least(F.floor(pos) + 1, F.col("n") - 1)})
             .withColumn("_r", F.explode(F.array(F.struct(F.lit("lo").alias("slot"), F.col("lo").alias("rank")), F.struct(F.lit("hi").alias("slot"), F.col("hi").alias("rank")))))
             .filter((F.col("_r.rank") >= F.col("start")) & (F.col("_r.rank") < F.col("start") + F.col("cnt"))))
    need = cut_lineage(asked.select(*keys, "qi", "prob", "frac", "_r.slot", (F.col("_r.rank") - F.col("start")).alias("local_rank")))
    cand = long.alias("l").join(need.select(*keys).distinct().alias("w"), _same("l", "w", keys), "left_semi")
    ranked = running_totals(cand.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt")), "value", "cnt", by=keys, descending=False)
    inside = (F.col("r.cum_cnt") - F.col("r.cnt") <= F.col("n.local_rank")) & (F.col("n.local_rank") < F.col("r.cum_cnt"))
    hit = ranked.alias("r").join(need.alias("n"), _same("r", "n", keys) & inside).select("n.*", F.col("r.value").alias("value"))
    out = hit.groupBy(*group, "qi", "prob", "frac").agg(F.max(F.when(F.col("slot") == "lo", F.col("value"))).alias("lo"),
                                                        F.max(F.when(F.col("slot") == "hi", F.col("value"))).alias("hi"))
    return out.select(*group, "qi", "prob", (F.col("lo") + F.col("frac") * (F.col("hi") - F.col("lo"))).alias("quantile"))


def _approx_long(wide: DataFrame, by, columns, probs) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("qi"), F.lit(p).alias("prob"),
                      F.col(c)[i].alias("quantile"))
             for c in columns for i, p in enumerate(probs)]
    return wide.select(*by, F.explode(F.array(*items)).alias("_x")).select(*by, "_x.*")


def sketch_cuts(df: DataFrame, column: str, most: int, rows_each: int) -> list[float]:
    """Rising cut points that part the values of ``column`` into near-equal shares of ``rows_each`` rows, ``most`` shares at most.

    KLL sketches are built per partition, merged in two levels (so no task merges them all) and read once.
    """
    x = F.col(column).cast("double")
    k = int(min(SKETCH_MAX_K, max(200, (4.6 * most) ** 1.11)))        # the sketch's rank error is about 2.3 / k ** 0.9
    some = F.pmod(F.spark_partition_id(), F.lit(MERGERS))
    sketches = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(some.alias("_s")).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("_q"))
    whole = sketches.agg(F.kll_merge_agg_double("_q").alias("_q")).filter(F.kll_sketch_get_n_double("_q") > 0)
    asked = F.array(*[F.lit(i / most) for i in range(1, most)])
    row = whole.select(F.kll_sketch_get_n_double("_q").alias("n"), F.kll_sketch_get_quantile_double("_q", asked).alias("cuts")).first() if most > 1 else None
    parts = min(most, -(-row["n"] // rows_each)) if row else 1
    return sorted({row["cuts"][i * most // parts - 1] for i in range(1, parts)})


def _coarse(df: DataFrame, column: str, parts: int) -> DataFrame:
    """``df`` with ``_b``, the bucket of ``column`` in rising order: nulls first, NaN last (as Spark sorts)."""
    x = F.col(column).cast("double")
    splits = [-math.inf, *[c for c in sketch_cuts(df, column, parts, ROWS_PER_BUCKET) if not math.isinf(c)], math.inf]
    if len(splits) == 2:
        splits = [-math.inf, 0.0, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(df.withColumn("_x", x))
    return cut.withColumn("_b", F.when(F.col("_x").isNull(), F.lit(-1)).otherwise(F.col("_b").cast("int"))).drop("_x")


def running_totals(df: DataFrame, order_col: str, sum_cols, by=(), descending: bool = True,
                   prefix: str = "cum_", whole: str | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_col`` order (inclusive), per ``by`` group (null keys are a group).

    ``df`` should hold one row per (group, order value) — collapse ties with a
    ``groupBy`` first.  Output: ``df`` plus ``<prefix><col>`` columns, and with ``whole`` the groups' totals as
    ``<whole><col>``.
    """
    sum_cols = [sum_cols] if isinstance(sum_cols, str) else list(sum_cols)
    by = list(by)
    columns = df.columns
    df = cut_lineage(df)
    parts = BUCKETS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    dealt = _coarse(df, order_col, parts).withColumn("_row", F.lit(1))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    # a row a group and bucket: what lies before the bucket, and the group's total
    heads = dealt.groupBy(*by, "_b").agg(*[F.sum(c).alias(c) for c in sum_cols])
    heads = heads.select(*by, "_b", F.lit(0).alias("_row"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_h_{c}") for c in sum_cols],
                         *[F.sum(c).over(group).alias(f"_w_{c}") for c in sum_cols])
    inside = Window.partitionBy(*by, "_b").orderBy("_row", F.col(order_col).desc() if descending else F.col(order_col).asc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.unionByName(heads, allowMissingColumns=True)
    sums = {f"{prefix}{c}": F.sum(F.coalesce(F.col(c), F.col(f"_h_{c}"))).over(inside) for c in sum_cols}
    totals = {f"{whole}{c}": F.max(f"_w_{c}").over(inside) for c in sum_cols} if whole else {}     # the head comes first
    return both.select("*", *[x.alias(n) for n, x in {**sums, **totals}.items()]).filter("_row = 1").select(*columns, *sums, *totals)
