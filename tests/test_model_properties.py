"""What must hold of fitted models, whatever their parameters: optimality, orthogonality, sums, equal scores after a reload."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.operators import prepare as P
from riskloom.operators import recon as RC
from riskloom.plans.inputs import feat
from riskloom.schema import FEATURE_COLS
from riskloom.sources import io as IO

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def prep(spark):
    return P.prepare(feat(spark, SF))


@pytest.fixture(scope="module")
def train(prep):
    return prep.split("train").select("txn_id", "isFraud", *FEATURE_COLS).toPandas()


def test_logistic_regression_is_at_its_optimum(prep, train):                       # H1
    model = M.fit_logistic(P.with_weight(prep.split("train"), prep.weights))
    coef, b = M.logistic_coefficients(model)
    w = np.array([coef[c] for c in FEATURE_COLS])
    x, y = train[FEATURE_COLS].to_numpy(float), train.isFraud.to_numpy()
    weight = np.where(y == 1, prep.weights[1], prep.weights[0])
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # gradient of 0.5 |w|^2 + C sum(weight * loss), at C = 0.1
    grad = w + 0.1 * ((weight * (p - y)) @ x)
    assert np.abs(grad).max() < 2e-3 * 0.1 * np.abs((weight[:, None] * x)).sum(axis=0).max() and abs((weight * (p - y)).sum()) < 2e-3 * weight.sum()


def test_column_algebra_scores_like_the_model(prep):                               # H2
    model = M.fit_logistic(P.with_weight(prep.split("train"), prep.weights), max_iter=20)
    a = M.score(model, prep.split("test")).select("txn_id", F.col("score").alias("a"))
    b = M.logistic_score(prep.split("test"), *M.logistic_coefficients(model)).select("txn_id", F.col("score").alias("b"))
    assert a.join(b, "txn_id").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9


def test_forest_importances_and_reload(spark, prep, tmp_path):                     # H3, H4, H5, A13
    model = M.fit_forest(P.with_weight(prep.split("train"), prep.weights), n_trees=15)
    imp = M.feature_importances(model, FEATURE_COLS).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1) and [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)
    assert {r.feature for r in imp} == set(FEATURE_COLS)
    IO.save_model(model, str(tmp_path / "rf"))
    a, b = (M.score(m, prep.split("val")).select("txn_id", "score") for m in (model, IO.load_model(str(tmp_path / "rf"))))
    assert a.exceptAll(b).count() == 0 and a.filter("score < 0 or score > 1").count() == 0
    both = M.score(model, prep.split("val")).groupBy("isFraud").agg(F.avg("score").alias("s")).collect()
    s = {r.isFraud: r.s for r in both}
    assert s[1] > s[0]
    with pytest.raises(ValueError):
        M.feature_importances(M.fit_logistic(P.with_weight(prep.split("train"), prep.weights), max_iter=2))


def test_detector_axes_are_the_leading_eigenvectors(prep, train):                  # H7, H8
    det = RC.fit_pca_detector(prep.train_normal(), k=4)
    x = train[train.isFraud == 0][FEATURE_COLS].to_numpy(float)
    v = np.array(det.components, float)
    assert np.allclose(v @ v.T, np.eye(4), atol=1e-8) and np.allclose(det.mean, x.mean(axis=0), atol=1e-9)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    lead = vectors[:, ::-1][:, :4]
    assert np.allclose(np.abs(np.linalg.svd(v @ lead)[1]), 1, atol=1e-6)            # the same subspace
    err = RC.reconstruction_error(prep.train_normal(), det).agg(F.avg("error")).first()[0]
    assert err == pytest.approx(values[::-1][4:].sum() * (len(x) - 1) / len(x) / len(FEATURE_COLS), rel=1e-6)


def test_latent_codes_and_their_plane(prep):                                       # H9, H12, E5
    det = RC.fit_pca_detector(prep.train_normal(), k=4)
    rows = prep.data.filter("split <> 'test'")
    out, ratio = RC.latent_pca_2d(RC.encode_latent(rows, det))
    got = out.select("txn_id", "pc1", "pc2").toPandas()
    x = rows.select("txn_id", *FEATURE_COLS).toPandas().set_index("txn_id")
    z = (x[FEATURE_COLS].to_numpy(float) - np.array(det.mean)) @ np.array(det.components, float).T
    z = z - z.mean(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    want = z @ vt[:2].T
    mine = got.set_index("txn_id").loc[x.index, ["pc1", "pc2"]].to_numpy()
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-6)                      # up to the sign of an axis
    assert np.allclose(list(ratio)[:2], (s ** 2 / (s ** 2).sum())[:2], atol=1e-8)
