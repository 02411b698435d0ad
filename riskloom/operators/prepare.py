"""Preparation: scaler, class weights, SMOTE and the whole pipeline.

Fitted parameters (6 means/stds, 2 weights) are tiny aggregates brought to the driver
and applied as literals, so applying them is a narrow projection — no join, no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import num, uniform_of
from ..functions.moments import skew_sample
from ..session import cut_lineage, cut_observed
from ..schema import FEATURE_COLS, KEY, SCALE_COLS, SEED, TARGET, TRAIN_RATIO
from . import features as FE
from .neighbours import nearest
from .sampling import class_counts, class_weights, rank_in_class, stratified_split


ROWS_PER_PARTITION = 1_000_000     # ~128 MB of the 16 prepared columns


# --- G1 / G2 -----------------------------------------------------------------
def fit_scaler(df: DataFrame, scale_cols=None, split: str | None = "train") -> dict:
    """Mean and population std of ``scale_cols`` on the train rows: {col: (mean, std)}."""
    scale_cols = list(SCALE_COLS if scale_cols is None else scale_cols)
    src = df.filter(F.col("split") == split) if split and "split" in df.columns else df
    row = src.agg(*[F.struct(F.avg(num(c)).alias("m"), F.stddev_pop(num(c)).alias("s")).alias(c)
                    for c in scale_cols]).first()
    return {c: (row[c]["m"], row[c]["s"]) for c in scale_cols}


def scaler_frame(df: DataFrame, scale_cols=None, split: str | None = "train") -> DataFrame:
    """The fitted scaler as rows (column, mean, std) — lazily, for reports and oracles."""
    scale_cols = list(SCALE_COLS if scale_cols is None else scale_cols)
    src = df.filter(F.col("split") == split) if split and "split" in df.columns else df
    wide = src.agg(*[F.struct(F.lit(c).alias("column"), F.avg(num(c)).alias("mean"),
                              F.stddev_pop(num(c)).alias("std")).alias(c) for c in scale_cols])
    return wide.select(F.explode(F.array(*scale_cols)).alias("u")).select("u.*")


def apply_scaler(df: DataFrame, params: dict) -> DataFrame:
    """(x - mean) / std on the fitted columns; std 0 divides by 1 (as scikit-learn)."""
    return df.withColumns({
        c: (F.col(c) - F.lit(float(m))) / F.lit(float(s) if s and s > 0 else 1.0)
        for c, (m, s) in params.items()})


# --- G4 ----------------------------------------------------------------------
def fit_class_weights(df: DataFrame, label: str = TARGET, split: str | None = "train") -> dict:
    src = df.filter(F.col("split") == split) if split and "split" in df.columns else df
    return class_weights(class_counts(src, label))


def with_weight(df: DataFrame, weights: dict, label: str = TARGET, out: str = "weight") -> DataFrame:
    expr = None
    for c, w in weights.items():
        expr = (F.when(F.col(label) == c, F.lit(float(w))) if expr is None
                else expr.when(F.col(label) == c, F.lit(float(w))))
    return df.withColumn(out, expr.otherwise(F.lit(1.0)))


# --- G3 SMOTE ----------------------------------------------------------------
def _smallest_keys(pts: DataFrame, n: int, key: str = "key", salt_buckets: int = 1024) -> DataFrame:
    """The ``n`` smallest keys of every distinct vector ``vec`` (rank 0..n-1), in two
    levels so that a vector with a huge number of copies is never sorted in one task:
    top-n inside (vec, hash(key) mod salt) first, then top-n of those survivors."""
    sb = F.pmod(F.xxhash64(F.col(key)), F.lit(salt_buckets))
    w1 = Window.partitionBy("vec", "_sb").orderBy(key)
    part = pts.withColumn("_sb", sb).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
    w2 = Window.partitionBy("vec").orderBy(key)
    return part.withColumn("rank", F.row_number().over(w2) - 1).filter(F.col("rank") < n) \
        .select("vec", F.col(key).alias("member"), "rank")


def minority_neighbours(minority: DataFrame, cols, k: int = 5, key: str = KEY) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded, ties by key) of every
    minority row, robust to copies.

    Identical rows are collapsed to distinct vectors first.  A row's copies are its
    neighbours at distance 0 (the k+1 smallest keys of its vector give them, two-level,
    without sorting a hot vector in one task); rows with fewer than k copies take the rest
    from the k nearest distinct vectors (k-d cells of distinct vectors only), each
    expanded to its smallest keys.  Every row sees at most k + k·(k+1) candidates.
    Returns (i, nn_rank 0..k-1, j, d2).
    """
    cols = list(cols)
    pts = cut_lineage(minority.select(F.col(key).alias("key"), *cols)).withColumn("vec", F.struct(*cols))
    vecs = pts.groupBy("vec").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("vkey"))
    small = _smallest_keys(pts, k + 1)
    # own copies at distance 0
    own = pts.select("key", "vec").join(small, "vec").filter(F.col("member") != F.col("key")) \
        .select(F.col("key").alias("i"), F.lit(0.0).alias("d2"), F.col("member").alias("j"))
    # k nearest distinct vectors, for vectors whose copies cannot fill k neighbours
    short = vecs.filter(F.col("copies") - 1 < k)
    vn = nearest(vecs.select(F.col("vkey").alias(key), *[F.col(f"vec.{c}").alias(c) for c in cols], (F.col("copies") - 1 < k).alias("_ask")),
                 cols, k, key, "_ask")
    vmap = vecs.select("vec", "vkey")
    need = pts.join(vmap, "vec").join(short.select("vkey"), "vkey", "left_semi") \
        .select("key", F.col("vkey").alias("vi"))
    other = need.join(vn.select(F.col("i").alias("vi"), F.col("j").alias("vj"), "d2"), "vi") \
        .join(vmap.withColumnRenamed("vkey", "vj"), "vj") \
        .join(small, "vec") \
        .select(F.col("key").alias("i"), "d2", F.col("member").alias("j"))
    cand = own.unionByName(other)
    w = Window.partitionBy("i").orderBy("d2", "j")
    return cand.withColumn("nn_rank", F.row_number().over(w) - 1).filter(F.col("nn_rank") < k) \
        .select("i", "nn_rank", "j", "d2")


def smote(train: DataFrame, feature_cols=None, label: str = TARGET, ratio: float = 0.1,
          k: int = 5, key: str = KEY, seed: int = SEED) -> DataFrame:
    """Synthesise minority rows until minority/majority = ``ratio``.

    New row j = x + u·(nn - x): x a minority row, nn one of its k nearest minority
    neighbours; the choices and u are md5-uniforms of j (deterministic).  Output: the
    input rows plus synthetic rows, with ``is_synthetic`` (synthetic keys are negative).
    """
    feature_cols = list(FEATURE_COLS if feature_cols is None else feature_cols)
    counts = class_counts(train, label)
    n_min, n_maj = counts.get(1, 0), counts.get(0, 0)
    base = train.withColumn("is_synthetic", F.lit(0))
    n_new = int(ratio * n_maj - n_min)
    if n_new <= 0:
        return base
    if n_min <= k:
        raise ValueError(f"SMOTE needs more than k={k} minority rows, got {n_min}")
    minority = train.filter(F.col(label) == 1).select(key, *feature_cols)
    nbrs = minority_neighbours(minority, feature_cols, k, key)
    indexed = rank_in_class(minority, None, key, seed, "_idx") \
        .withColumn("_idx", F.col("_idx") - 1)
    gen = train.sparkSession.range(n_new).select(
        F.col("id").alias("g"),
        F.floor(uniform_of("id", seed, "base") * n_min).cast("long").alias("_idx"),
        F.floor(uniform_of("id", seed, "nn") * k).cast("int").alias("nn_rank"),
        uniform_of("id", seed, "gap").alias("_u"))
    x = indexed.select("_idx", F.col(key).alias("i"), *[F.col(c).alias(f"x_{c}") for c in feature_cols])
    nn = minority.select(F.col(key).alias("j"), *[F.col(c).alias(f"n_{c}") for c in feature_cols])
    syn = gen.join(x, "_idx").join(nbrs.select("i", "nn_rank", "j"), ["i", "nn_rank"]).join(nn, "j")
    cols_out = []
    for f in base.schema.fields:
        c = f.name
        if c in feature_cols:
            cols_out.append((F.col(f"x_{c}") + F.col("_u") * (F.col(f"n_{c}") - F.col(f"x_{c}")))
                            .cast("double").alias(c))
        elif c == key:
            cols_out.append((-(F.col("g") + 1)).cast(f.dataType).alias(c))
        elif c == label:
            cols_out.append(F.lit(1).cast(f.dataType).alias(c))
        elif c == "is_synthetic":
            cols_out.append(F.lit(1).alias(c))
        else:
            cols_out.append(F.lit(None).cast(f.dataType).alias(c))
    base = base.withColumns({c: F.col(c).cast("double") for c in feature_cols})
    return base.unionByName(syn.select(*cols_out))


# --- G5 ----------------------------------------------------------------------
@dataclass
class PreparedData:
    data: DataFrame                  # key, 14 features (scaled), label, split
    scaler: dict
    weights: dict
    skew_before: float | None
    skew_after: float | None
    feature_cols: list = field(default_factory=lambda: list(FEATURE_COLS))
    sizes: dict = field(default_factory=dict)      # split -> (normal rows, frauds), observed while the split was written

    def split(self, name: str) -> DataFrame:
        return self.data.filter(F.col("split") == name)

    def split_summary(self) -> DataFrame:
        """(split, rows, frauds, fraud_rate_pct) as observed while the split was written: no scan."""
        rows = [(s, a + b, b, round(100.0 * b / (a + b), 6)) for s, (a, b) in self.sizes.items() if a + b]
        return self.data.sparkSession.createDataFrame(rows, "split string, rows bigint, frauds bigint, fraud_rate_pct double")

    def stratification_ok(self, tol: float = 5e-4) -> bool:
        """C10 from the observed sizes: every split's fraud rate is within ``tol`` of the whole's."""
        n, f = (sum(x) for x in zip(*[(a + b, b) for a, b in self.sizes.values()], strict=True))
        return all(abs(b / (a + b) - f / n) < tol for a, b in self.sizes.values() if a + b)

    def train_normal(self) -> DataFrame:
        return self.data.filter((F.col("split") == "train") & (F.col(TARGET) == 0))

    def train_smote(self, ratio: float = 0.1, k: int = 5, seed: int = SEED) -> DataFrame:
        return smote(self.split("train"), self.feature_cols, TARGET, ratio, k, KEY, seed)


def encoded_frame(features_df: DataFrame, check_levels: bool = True) -> DataFrame:
    """B11 → B12 → B14: key, 14 model features (unscaled) and label."""
    df = FE.drop_leakage_columns(features_df)
    df = FE.encode_type(df, check=check_levels)
    df = FE.log_transform_amount(df)
    return df.select(KEY, *FEATURE_COLS, TARGET)


def prepare(features_df: DataFrame, train_ratio: float = TRAIN_RATIO, seed: int = SEED,
            checkpoint: bool = True) -> PreparedData:
    """B11→B12→B14→F2→G1→G2→G4 (SMOTE on demand via ``train_smote``).

    Driver round trips are merged: one pass gives the skews, the type levels and the
    class counts; the pass that writes the split gives scaler, weights and sizes.
    """
    from ..schema import TYPE_LEVELS
    pre = features_df.agg(skew_sample("amount").alias("b"), skew_sample(F.log1p("amount")).alias("a"),
                          *[F.count_if(F.col("type") == lvl).alias(f"lvl_{lvl}") for lvl in TYPE_LEVELS],
                          F.count_if(F.col(TARGET) == 0).alias("n0"),
                          F.count_if(F.col(TARGET) == 1).alias("n1")).first()
    missing = [lvl for lvl in TYPE_LEVELS if not pre[f"lvl_{lvl}"]]
    if missing:
        raise ValueError(f"type levels missing after one-hot encoding: {missing}")
    counts = {c: n for c, n in ((0, pre["n0"]), (1, pre["n1"])) if n}
    enc = encoded_frame(features_df, check_levels=False)
    split = stratified_split(enc, TARGET, train_ratio, KEY, seed, counts=counts)
    in_train = F.col("split") == "train"
    fitted = [x for c in SCALE_COLS for x in (F.avg(F.when(in_train, num(c))).alias(f"m_{c}"), F.stddev_pop(F.when(in_train, num(c))).alias(f"s_{c}"))]
    sizes = [F.count_if((F.col("split") == s) & (F.col(TARGET) == y)).alias(f"{s}_{y}") for s in ("train", "val", "test") for y in (0, 1)]
    if checkpoint:
        # the split feeds the scaler, weights, SMOTE and every model: materialise it once in the cluster's checkpoint
        # folder (survives executor loss), dealt by key to a partition per core at least, so that neither the
        # derivation above nor the iterative fits (L-BFGS, trees) run on fewer tasks than there are cores; the scaler's
        # moments and the sizes are observed in the pass that writes it
        n_parts = max(features_df.sparkSession.sparkContext.defaultParallelism, math.ceil((pre["n0"] + pre["n1"]) / ROWS_PER_PARTITION))
        split, row = cut_observed(split.repartition(n_parts, KEY), [*fitted, *sizes])
    else:
        row = split.agg(*fitted, *sizes).first().asDict()
    params = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in SCALE_COLS}
    weights = class_weights({c: row[f"train_{c}"] for c in (0, 1) if row[f"train_{c}"]})
    scaled = apply_scaler(split, params)
    return PreparedData(scaled, params, weights, pre["b"], pre["a"], sizes={s: (row[f"{s}_0"], row[f"{s}_1"]) for s in ("train", "val", "test")})
