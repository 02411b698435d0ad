"""Curves, AUCs and thresholds against brute-force definitions (tied scores)."""

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import evaluate as EV


def _brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    roc = np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg])
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        r, p = tp / (y == 1).sum(), tp / pred.sum()
        ap += (r - prev_r) * p
        prev_r = r
    return roc, ap


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auc_and_ap(spark, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 60)
    s = np.round(rng.random(60) + 0.3 * y, 1)         # many ties
    df = spark.createDataFrame(pd.DataFrame({"isFraud": y, "score": s}))
    a = EV.auc_scores(EV.score_curve(df)).first()
    roc, ap = _brute(y, s)
    assert a["roc_auc"] == pytest.approx(roc, abs=1e-12)
    assert a["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_one_class_auc_is_null(spark):
    df = spark.createDataFrame(pd.DataFrame({"isFraud": [0, 0, 0], "score": [0.1, 0.2, 0.3]}))
    m = EV.fraud_metrics(df, 0.5).first()
    assert m["roc_auc"] is None and m["recall"] == 0.0 and m["tn"] == 3


def test_optimal_threshold_ties_lowest(spark):
    df = spark.createDataFrame(pd.DataFrame({"isFraud": [1, 1, 0, 0], "score": [0.9, 0.8, 0.2, 0.1]}))
    t = EV.optimal_threshold(df, metric="f1").first()
    assert t["threshold"] == 0.8 and t["score"] == 1.0


def test_grid_counts_brute(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = rng.random(300)
    s[:20] = EV.linspace(0.01, 0.99, 200)[50]          # values exactly on a grid point
    df = spark.createDataFrame(pd.DataFrame({"isFraud": y, "score": s}))
    grid = EV.linspace(0.01, 0.99, 200)
    got = EV.grid_counts(df, grid).toPandas().sort_values("i")
    for _, r in got.iterrows():
        t = grid[int(r["i"])]
        assert r["tp"] == ((s >= t) & (y == 1)).sum()
        assert r["fp"] == ((s >= t) & (y == 0)).sum()
