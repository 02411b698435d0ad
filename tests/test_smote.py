"""SMOTE neighbours equal brute force; synthetic rows lie on neighbour segments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import neighbours as N
from riskloom.operators import prepare as P
from riskloom.operators.neighbours import nearest
from riskloom.operators.prepare import minority_neighbours, smote
from riskloom.plans.inputs import feat
from riskloom.schema import FEATURE_COLS


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(11)
    n = 120
    x = rng.normal(size=(n, 3))
    x[:5] = x[0]                                        # duplicates
    x[-3:] *= 40                                         # far outliers
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(txn_id=np.arange(n), isFraud=1)
    return spark.createDataFrame(pdf), pdf


def test_neighbours_brute_force(spark, data):
    df, pdf = data
    got = minority_neighbours(df, ["a", "b", "c"], 5).toPandas()
    x = pdf[["a", "b", "c"]].to_numpy()
    for i in range(len(pdf)):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], j) for j in range(len(x)) if j != i)[:5]
        mine = got[got.i == i].sort_values("nn_rank")
        assert list(mine.j) == [j for _, j in order]


def test_synthetic_on_segments(spark, data):
    df, pdf = data
    majority = spark.createDataFrame(pd.DataFrame({"a": [0.0] * 2000, "b": 0.0, "c": 0.0,
                                                   "txn_id": np.arange(1000, 3000), "isFraud": 0}))
    train = df.unionByName(majority)
    out = smote(train, ["a", "b", "c"], ratio=0.1, k=5)
    syn = out.filter(F.col("is_synthetic") == 1).toPandas()
    assert len(syn) == int(0.1 * 2000 - 120)
    x = pdf[["a", "b", "c"]].to_numpy()
    for _, r in syn.head(30).iterrows():
        p = r[["a", "b", "c"]].to_numpy(dtype=float)
        ok = False
        for i in range(len(x)):
            for j in range(len(x)):
                d = x[j] - x[i]
                if np.allclose(d, 0):
                    ok |= np.allclose(p, x[i])
                    continue
                u = np.dot(p - x[i], d) / np.dot(d, d)
                if -1e-9 <= u <= 1 + 1e-9 and np.allclose(x[i] + u * d, p, atol=1e-9):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_smote_needs_more_than_k(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [0.0] * 105, "txn_id": range(105),
                                             "isFraud": [1] * 5 + [0] * 100}))
    with pytest.raises(ValueError):
        smote(df, ["a"], ratio=0.5, k=5)


def test_neighbours_with_hot_copy_group(spark):
    rng = np.random.default_rng(4)
    n = 150
    x = rng.normal(size=(n, 2))
    x[:50] = x[7]                                       # a third of the rows are copies of one row
    x[50:53] = x[60]                                    # a small copy group (fewer than k copies)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(txn_id=np.arange(n))
    got = minority_neighbours(spark.createDataFrame(pdf), ["a", "b"], 5).toPandas()
    assert len(got) == 5 * n
    for i in list(range(0, 55)) + [100, 149]:
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], j) for j in range(n) if j != i)[:5]
        mine = got[got.i == i].sort_values("nn_rank")
        assert list(mine.j) == [j for _, j in order], i


def test_neighbours_with_hot_coordinate_value(spark):
    rng = np.random.default_rng(9)
    n = 150
    x = rng.normal(size=(n, 3))
    x[:60, 0] = 0.0                                     # a third+ of distinct rows share one coordinate value
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(txn_id=np.arange(n))
    got = minority_neighbours(spark.createDataFrame(pdf), ["a", "b", "c"], 5).toPandas()
    for i in range(0, n, 7):
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        order = sorted((d2[j], j) for j in range(n) if j != i)[:5]
        assert list(got[got.i == i].sort_values("nn_rank").j) == [j for _, j in order], i


def _brute(x, keys, k):
    out = {}
    for i in range(len(x)):
        d2 = np.zeros(len(x))
        for c in range(x.shape[1]):
            d2 += (x[i, c] - x[:, c]) ** 2
        out[keys[i]] = [j for _, j in sorted((d, j) for d, j in zip(d2, keys) if j != keys[i])[:k]]
    return out


def test_neighbours_across_shards(spark):
    """Several shards at every size of the top tree, with a hot coordinate, flags, null coordinates, ties and far points."""
    rng = np.random.default_rng(21)
    n = 400
    x = np.column_stack([rng.integers(0, 2, n), rng.normal(size=n), rng.integers(0, 6, n), rng.exponential(size=n) ** 3]).astype(float)
    x[:140, 3] = 0.0
    x = np.unique(x, axis=0)
    keys = rng.permutation(len(x)) + 10
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(txn_id=keys)
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 5), (float("nan"), 1.0, 1.0, 1.0, 6)], "a double, b double, c double, d double, txn_id long"))
    want = _brute(x, keys, 5)
    for shard_points in (10_000, 100, 25):
        got = nearest(df, list("abcd"), 5, shard_points=shard_points).toPandas().sort_values(["i", "nn_rank"])
        assert got.groupby("i")["j"].apply(list).to_dict() == want, shard_points
    some = nearest(df.withColumn("q", F.col("txn_id") % 7 == 0), list("abcd"), 5, ask="q", shard_points=50).toPandas().sort_values(["i", "nn_rank"])
    assert some.groupby("i")["j"].apply(list).to_dict() == {i: j for i, j in want.items() if i % 7 == 0}


def test_neighbours_hot_shard_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_ROWS", 20)
    x = np.random.default_rng(2).normal(size=(200, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(txn_id=np.arange(200)))
    got = nearest(df, ["a", "b"], 3, shard_points=20).toPandas().sort_values(["i", "nn_rank"])
    assert got.groupby("i")["j"].apply(list).to_dict() == _brute(x, np.arange(200), 3)


def test_neighbours_few_or_no_points(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2)], "a double, txn_id long")
    assert [(r.i, r.j) for r in nearest(df, ["a"], 5).orderBy("i").collect()] == [(1, 2), (2, 1)]
    assert nearest(df.limit(0), ["a"], 5).count() == 0


def test_compared_points_do_not_grow_with_the_minority(spark):
    rng = np.random.default_rng(8)
    per = []
    for n in (1_000, 8_000):
        x = rng.normal(size=(n, 4))
        per.append(N.shard_neighbours(x, np.arange(n), x, np.arange(n), np.full(n, np.inf), 5)[2] / n)
    assert per[1] < 1.5 * per[0]
    m = P.prepare(feat(spark, "/root/testdata/sf0.1")).split("train").filter("isFraud = 1").select(*FEATURE_COLS).distinct().toPandas().to_numpy(float)
    got = N.shard_neighbours(m, np.arange(len(m)), m, np.arange(len(m)), np.full(len(m), np.inf), 5)[2]
    assert got < 0.2 * len(m) ** 2
