"""Exact, deterministic sampling and splitting.

Order inside a class is the md5 text of ``key:seed`` (then the key), the same in Spark
and DuckDB.  Quotas follow scikit-learn's stratified rules (floor + largest remainder,
ties to the smaller class label), computed on the driver from the per-class counts.

Scale: rows are not ranked by one window over a whole class (that puts the majority
class in one task).  Counts of 256 md5-prefix buckets per class go to the driver; only the
buckets that hold a quota's last row are looked at again, finer each time, and ranked by a
window per bucket.  The row at each quota then is a literal that all rows are compared with.
A null class or key is refused with the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import order_key
from ..schema import KEY, SEED, TARGET, TRAIN_RATIO

ROWS_PER_BUCKET = 50_000


# ---------------------------------------------------------------------------
# quota arithmetic (driver side, on per-class counts)
# ---------------------------------------------------------------------------
def approximate_mode(class_counts: dict, n_draws: int) -> dict:
    """Per-class draws summing to ``n_draws``: floor of the proportional share, then one
    extra for the largest remainders (ties: smaller class label first)."""
    total = sum(class_counts.values())
    if total == 0:
        return {c: 0 for c in class_counts}
    cont = {c: float(cnt * n_draws) / float(total) for c, cnt in class_counts.items()}
    out = {c: int(math.floor(v)) for c, v in cont.items()}
    need = int(n_draws - sum(out.values()))
    order = sorted(class_counts, key=lambda c: (-(cont[c] - out[c]), c))
    for c in order[:max(need, 0)]:
        out[c] += 1
    return out


def split_sizes(n: int, test_size: float) -> tuple[int, int]:
    """(n_train, n_test) with n_test = ceil(test_size·n) for a float fraction."""
    n_test = int(math.ceil(test_size * n))
    return n - n_test, n_test


def split_quotas(class_counts: dict, train_ratio: float = TRAIN_RATIO) -> dict:
    """Two-step 70/15/15: train vs temp (test_size = 1 - ratio), then temp halves into
    val (first part) and test.  Returns {class: (n_train, n_val, n_test)}."""
    n = sum(class_counts.values())
    n_train, _ = split_sizes(n, 1.0 - train_ratio)
    tr = approximate_mode(class_counts, n_train)
    temp = {c: class_counts[c] - tr[c] for c in class_counts}
    n_val, _ = split_sizes(sum(temp.values()), 0.5)
    va = approximate_mode(temp, n_val)
    return {c: (tr[c], va[c], temp[c] - va[c]) for c in class_counts}


def class_weights(class_counts: dict) -> dict:
    """Balanced weights n / (n_classes · n_c)."""
    n = sum(class_counts.values())
    k = len(class_counts)
    return {c: n / (k * cnt) for c, cnt in class_counts.items() if cnt}


# ---------------------------------------------------------------------------
# distributed rank-range tagging
# ---------------------------------------------------------------------------
FIRST_DIGITS = 2        # 256 hash buckets per class; each refinement adds as many digits
MD5_DIGITS = 32


def class_counts(df: DataFrame, class_col: str | None) -> dict:
    if class_col is None:
        return {None: df.count()}
    return {r[0]: r[1] for r in df.groupBy(class_col).count().collect()}   # one row per class


def _hashed(df: DataFrame, class_col: str | None, key: str, seed: int) -> DataFrame:
    return df.withColumns({"_cls": F.col(class_col) if class_col else F.lit(0), "_ok": order_key(key, seed)})


def _bucket_counts(base: DataFrame, class_col: str | None, key: str) -> dict:
    """{class: [(2-digit bucket, rows)]} in bucket order; null classes or keys are refused by name."""
    rows = (base.groupBy("_cls", F.substring("_ok", 1, FIRST_DIGITS).alias("_bk"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key).isNull()).alias("no_key")).collect())   # classes x 256
    no_key = sum(r["no_key"] for r in rows)
    no_class = sum(r["n"] for r in rows if r["_cls"] is None)
    if no_key or no_class:
        raise ValueError(f"{no_key} rows without {key!r}, {no_class} rows without {class_col!r}: every row needs both")
    per: dict = {}
    for r in rows:
        per.setdefault(r["_cls"], []).append((r["_bk"], r["n"]))
    return {c: sorted(lst) for c, lst in per.items()}


def _locate(lst: list, rank: int) -> tuple[str, int, int]:
    """(bucket, rows before it, its rows) of the bucket that holds a 1-based rank."""
    off = 0
    for bk, n in lst:
        if rank <= off + n:
            return bk, off, n
        off += n
    raise ValueError(f"rank {rank} is beyond {off} rows")


def _rows_at(base: DataFrame, per: dict, wanted: list, key: str) -> dict:
    """{(class, rank): (md5 text, key)} of the rows at the wanted 1-based ranks of their classes.

    Only the buckets that hold a wanted rank are looked at again, two digits finer each time until one has
    ``ROWS_PER_BUCKET`` rows or fewer; those are ranked by a window per bucket.  The driver holds 256 counts per wanted rank.
    """
    at = {(c, r): _locate(per[c], r) for c, r in wanted}
    digits = FIRST_DIGITS
    while digits < MD5_DIGITS:
        big = {(c, bk) for (c, _), (bk, _, n) in at.items() if n > ROWS_PER_BUCKET}
        if not big:
            break
        digits += FIRST_DIGITS
        inside = F.lit(False)
        for c, bk in big:
            inside = inside | ((F.col("_cls") == F.lit(c)) & F.col("_ok").startswith(bk))
        finer: dict = {}
        for r in base.filter(inside).groupBy("_cls", F.substring("_ok", 1, digits).alias("_bk")).count().collect():
            finer.setdefault((r["_cls"], r["_bk"][:digits - FIRST_DIGITS]), []).append((r["_bk"], r["count"]))
        for (c, rank), (bk, off, _) in list(at.items()):
            if (c, bk) in big:
                sub, before, n = _locate(sorted(finer[c, bk]), rank - off)
                at[c, rank] = (sub, off + before, n)
    if not at:
        return {}
    edges = sorted({(c, bk) for (c, _), (bk, _, _) in at.items()}, key=str)
    which = F
    for k, (c, bk) in enumerate(edges):
        which = which.when((F.col("_cls") == F.lit(c)) & F.col("_ok").startswith(bk), F.lit(k))
    w = Window.partitionBy("_edge").orderBy("_ok", key)
    ranked = (base.select("_cls", "_ok", key, which.alias("_edge")).filter(F.col("_edge").isNotNull())
              .withColumn("_rank", F.row_number().over(w)))
    need = F.lit(False)
    for (c, rank), (bk, off, _) in at.items():
        need = need | ((F.col("_edge") == edges.index((c, bk))) & (F.col("_rank") == rank - off))
    hit = {(r["_edge"], r["_rank"]): (r["_ok"], r[key]) for r in ranked.filter(need).collect()}   # one row per wanted rank
    return {(c, rank): hit[edges.index((c, bk)), rank - off] for (c, rank), (bk, off, _) in at.items()}


def tag_by_rank(df: DataFrame, class_col: str | None, cuts, out: str,
                key: str = KEY, seed: int = SEED, counts: dict | None = None) -> DataFrame:
    """Tag rows by their 1-based rank inside their class in hash order.

    ``cuts`` maps class -> list of ``(last_rank_inclusive, tag)`` in increasing rank (or is a function of the class
    counts returning that map); rows past the last cut get null.  The row at each cut becomes a literal, and
    every row is tagged by comparing its (md5 text, key) with it: no join and no shuffle of the tagged rows.
    """
    base = _hashed(df, class_col, key, seed)
    per = _bucket_counts(base, class_col, key)
    found = {c: sum(n for _, n in lst) for c, lst in per.items()}
    if class_col is None:
        found = {None: sum(found.values())}
    cuts = cuts(found) if callable(cuts) else cuts
    size = {c: sum(n for _, n in lst) for c, lst in per.items()}
    plan = {c: cuts.get(None if class_col is None else c, []) for c in per}
    wanted = sorted({(c, last) for c, ccuts in plan.items() for last, _ in ccuts if 0 < last < size[c]}, key=str)
    rows = _rows_at(base, per, wanted, key)
    here = F.struct("_ok", F.col(key).alias("_key"))
    tag = F.lit(None).cast("string")
    for c, ccuts in plan.items():
        inner = F.lit(None).cast("string")
        for last, t in reversed(ccuts):
            if last >= size[c]:
                inner = F.lit(t)
            elif last > 0:
                ok, k = rows[c, last]
                inner = F.when(here <= F.struct(F.lit(ok).alias("_ok"), F.lit(k).cast(base.schema[key].dataType).alias("_key")), F.lit(t)).otherwise(inner)
        tag = F.when(F.col("_cls") == F.lit(c), inner).otherwise(tag)
    return base.withColumn(out, tag).select(*df.columns, out)


def rank_in_class(df: DataFrame, class_col: str | None, key: str = KEY, seed: int = SEED,
                  out: str = "rank_in_class") -> DataFrame:
    """Exact 1-based rank of every row inside its class (hash order), distributed.

    Buckets have as many digits as keep them near ``ROWS_PER_BUCKET`` rows.  Their offsets stay in a DataFrame: a window inside
    each 2-digit bucket, plus the offset of that bucket from the driver (classes x 256 rows).
    """
    spark = df.sparkSession
    base = _hashed(df, class_col, key, seed)
    per = _bucket_counts(base, class_col, key)
    most = max((n for lst in per.values() for _, n in lst), default=0)
    digits = FIRST_DIGITS
    while most > ROWS_PER_BUCKET and digits < MD5_DIGITS:
        digits, most = digits + 1, most // 16
    coarse = []
    for c, lst in per.items():
        off = 0
        for bk, n in lst:
            coarse.append((c, bk, off))
            off += n
    schema = T.StructType([T.StructField("_cls", base.schema["_cls"].dataType),
                           T.StructField("_top", T.StringType()), T.StructField("_before", T.LongType())])
    base = base.withColumns({"_bk": F.substring("_ok", 1, digits), "_top": F.substring("_ok", 1, FIRST_DIGITS)})
    inner = Window.partitionBy("_cls", "_top").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = (base.groupBy("_cls", "_top", "_bk").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_within", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
            .join(F.broadcast(spark.createDataFrame(coarse, schema)), ["_cls", "_top"])
            .select("_cls", "_bk", (F.col("_within") + F.col("_before")).alias("_off")))
    w = Window.partitionBy("_cls", "_bk").orderBy("_ok", key)
    ranked = base.select(*df.columns, "_cls", "_bk", F.row_number().over(w).alias("_r"))
    return ranked.join(offs, ["_cls", "_bk"]).withColumn(out, F.col("_r") + F.col("_off")).select(*df.columns, out)


# ---------------------------------------------------------------------------
# operators
# ---------------------------------------------------------------------------
def random_sample_n(df: DataFrame, n: int, key: str = KEY, seed: int = SEED) -> DataFrame:   # A3
    """Exactly min(n, rows) rows, unstratified, deterministic in (key, seed)."""
    def cuts(counts):
        return {None: [(min(int(n), counts[None]), "in")]}
    tagged = tag_by_rank(df, None, cuts, "_s", key, seed)
    return tagged.filter(F.col("_s") == "in").drop("_s")


def stratified_sample(df: DataFrame, n: int, label: str = TARGET, key: str = KEY,
                      seed: int = SEED) -> DataFrame:                                    # F1
    def cuts(counts):
        q = approximate_mode(counts, min(int(n), sum(counts.values())))
        return {c: [(q[c], "in")] for c in counts}
    tagged = tag_by_rank(df, label, cuts, "_s", key, seed)
    return tagged.filter(F.col("_s") == "in").drop("_s")


def stratified_split(df: DataFrame, label: str = TARGET, train_ratio: float = TRAIN_RATIO,
                     key: str = KEY, seed: int = SEED, out: str = "split",
                     counts: dict | None = None) -> DataFrame:                           # F2
    def cuts(found):
        q = split_quotas(found, train_ratio)
        return {c: [(tr, "train"), (tr + va, "val"), (tr + va + te, "test")] for c, (tr, va, te) in q.items()}
    return tag_by_rank(df, label, cuts, out, key, seed, counts)


def stratified_kfold(df: DataFrame, k: int = 5, label: str = TARGET, key: str = KEY,
                     seed: int = SEED, out: str = "fold") -> DataFrame:                  # F3
    ranked = rank_in_class(df, label, key, seed, "_r")
    return ranked.withColumn(out, ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def tail_validation_split(df: DataFrame, frac: float = 0.1, key: str = KEY, seed: int = SEED,
                          out: str = "is_holdout") -> DataFrame:                          # F4
    """Hold out ceil(frac·n) rows (hash order; the last ones) for early stopping."""
    def cuts(counts):
        total = counts[None]
        n_hold = int(math.ceil(frac * total))
        return {None: [(total - n_hold, "fit"), (total, "hold")]}
    tagged = tag_by_rank(df, None, cuts, "_t", key, seed)
    return tagged.withColumn(out, (F.col("_t") == "hold").cast("int")).drop("_t")
