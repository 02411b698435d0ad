"""The forest of ``operators.trees``: histograms, splits, walks and bootstrap counts by brute force; quality beside MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import models as M
from riskloom.operators import trees as T

COLS = ["a", "b", "c", "d"]


def _gini(y, w):
    p = np.array([w[y == k].sum() for k in (0, 1)])
    return 1 - ((p / p.sum()) ** 2).sum() if p.sum() else 0.0


def _table(spark, n=6000):
    """``a`` and ``b`` tell the class, ``c`` has three values, ``d`` is noise with NaN and null."""
    u = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100_000)) / 100_000).alias(f"u{k}") for k in range(5)]
    t = spark.range(n).select("id", *u)
    return t.select("id", F.col("u0").alias("a"), (F.col("u1") * 10).alias("b"), F.floor(F.col("u2") * 3).cast("double").alias("c"),
                    F.when(F.col("u3") < 0.05, F.lit(float("nan"))).when(F.col("u3") > 0.95, F.lit(None)).otherwise(F.col("u3")).alias("d"),
                    ((F.col("a") + F.col("b") / 20 + F.col("u4") / 4) > 1.05).cast("int").alias("isFraud")).repartition(3, "id")


def test_bootstrap_counts_are_poisson_and_repeat():
    c = np.concatenate([T.bootstrap_counts(42, k, 16_384, g) for k in range(4) for g in range(4)])
    share = np.bincount(c.ravel(), minlength=5)[:5] / c.size
    assert np.allclose(share, [0.36788, 0.36788, 0.18394, 0.06131, 0.01533], atol=2e-3)
    assert abs(np.corrcoef(c.T)[np.triu_indices(4, 1)]).max() < 0.02
    assert (T.bootstrap_counts(42, 7, 100, 3) == T.bootstrap_counts(42, 7, 100, 3)).all()
    assert (T.bootstrap_counts(42, 7, 100, 3) != T.bootstrap_counts(42, 8, 100, 3)).any()


@pytest.mark.parametrize("by_row", [False, True])
def test_histograms_and_splits_equal_brute_force(by_row):
    rng = np.random.default_rng(3)
    n, bins = 500, np.array([6, 2, 9])
    x = np.stack([rng.integers(0, b, n) for b in bins])
    y = (x[0] + x[2] + rng.integers(0, 6, n) > 10).astype(int)
    w = rng.random(n) + 0.5 if by_row else np.ones(n)
    counts = T.bootstrap_counts(1, 0, n, 0)[:, 0]
    tree, nodes = T.Tree.root(2), np.zeros(1, np.int64)
    where = np.zeros(n, int)
    for level in range(6):                                    # past the steps that whole columns are compared for
        one = T._Open(tree, 0, nodes, bins, 2, 5, level)
        out = np.zeros((1 + by_row, one.size * 2))
        T._histogram(one, level, (x * 2 + y).astype(np.uint16).ravel(), n, w if by_row else None, counts, 2, out)
        feature, cut, gain, low, high, whole, _ = T.best_splits(out[0].reshape(-1, 2), out[-1].reshape(-1, 2), one.chosen, one.base, bins, 5)
        for k, node in enumerate(nodes):
            on = where == node
            c, f = counts * on, w * counts * on
            best = 0.0
            for j in one.chosen[k]:
                for b in range(bins[j] - 1):
                    left = x[j] <= b
                    if c[left].sum() >= 5 and c[~left].sum() >= 5:
                        best = max(best, _gini(y, f) - sum(f[s].sum() * _gini(y[s], f[s]) for s in (left, ~left)) / f.sum())
            assert gain[k] == pytest.approx(best, abs=1e-9)
            assert np.allclose(whole[k], [f[y == q].sum() for q in (0, 1)])
        on = gain > 1e-12
        split = nodes[on]
        first = tree.grow(split, feature[on], cut[on], gain[on], low[on], high[on])
        for s, f, b, to in zip(split, feature[on], cut[on], first, strict=True):
            here = where == s
            where[here] = to + (x[f][here] > b)
        made = np.stack([first, first + 1], axis=1).ravel()
        nodes = made[T.gini(tree.stats[made]) > 1e-12]
        if not len(nodes):
            break
    assert level > T.TOP - 1 or not len(nodes)


def test_cuts_of_few_many_and_heavy_values(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).cast("double").alias("few"), F.col("id").cast("double").alias("many"),
                                      F.when(F.col("id") % 2 == 0, 500.5).otherwise(F.col("id")).cast("double").alias("heavy"), F.lit(None).cast("double").alias("none"))
    few, many, heavy, none = T.find_cuts(rows, ["few", "many", "heavy", "none"], 128)
    assert few.tolist() == [0.5, 1.5] and len(none) == 0
    assert len(many) == 127 and np.abs(np.diff(many) - 156.25).max() < 10
    at = T.to_bins(np.array([500.4, 500.5, 500.6]), heavy)
    assert at[0] < at[1] < at[2] and len(heavy) < 128


def test_forest_learns_as_well_as_mllibs_and_keeps_few_bytes_a_row(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    t = _table(spark)
    fit, test = t.filter("id % 3 > 0 and d is not null and not isnan(d)"), t.filter("id % 3 = 0")
    # the job itself keeps no count a row and tree: a block is a byte a feature and the label
    cuts = T.find_cuts(fit, COLS, 128)
    blocks = T.packed(fit, COLS, "isFraud", None, cuts, 2).selectExpr("sum(n) n", "sum(length(x) + length(y) + length(w)) b").first()
    n = fit.count()
    assert blocks["n"] == n and blocks["b"] == n * (len(COLS) + 1)
    own = M.fit_forest(fit, COLS, weight=None, n_trees=30, max_depth=6)
    rf = RandomForestClassifier(labelCol="isFraud", numTrees=30, maxDepth=6, minInstancesPerNode=5, featureSubsetStrategy="sqrt", maxBins=128, seed=42)
    theirs = Pipeline(stages=[M._assembler(COLS), rf]).fit(fit)
    auc = [EV.fraud_metrics(M.score(m, test).na.fill(0.0, ["score"]), 0.5).first()["roc_auc"] for m in (own, theirs)]
    assert auc[0] > 0.95 and abs(auc[0] - auc[1]) < 0.01
    importance = own.stages[-1].featureImportances.toArray()
    assert np.abs(importance - theirs.stages[-1].featureImportances.toArray()).max() < 0.1
    again = M.fit_forest(fit.withColumn("weight", F.lit(2.5)), COLS, n_trees=30, max_depth=6)      # one weight changes nothing
    assert again.stages[-1].featureImportances.toArray() == pytest.approx(importance)


def test_forest_refuses_what_it_cannot_learn(spark):
    t = _table(spark, 200)
    with pytest.raises(ValueError, match="null, NaN or infinite"):
        M.fit_forest(t, COLS, weight=None, n_trees=2)
    t = t.na.fill(0.0).withColumn("d", F.nanvl("d", F.lit(0.0)))
    with pytest.raises(ValueError, match="class numbers"):
        M.fit_forest(t.withColumn("isFraud", F.lit(0.5)), COLS, weight=None, n_trees=2)
    with pytest.raises(ValueError, match="negative"):
        M.fit_forest(t.withColumn("weight", F.lit(-1.0)), COLS, n_trees=2)
    one_class = M.fit_forest(t.withColumn("isFraud", F.lit(1)), COLS, weight=None, n_trees=2)
    assert M.score(one_class, t).filter("score <> 1").count() == 0
