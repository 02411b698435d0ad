"""Model sanity on the sf0.01 fixture: detection quality floors, normal-only training."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom.operators import prepare as P
from riskloom.operators import quality as Q
from riskloom.plans.inputs import feat

from .conftest import SF_MID


def test_logistic_balanced_auc(spark):
    m = E.queries()["logistic_balanced"](spark, SF_MID).first()
    assert m["roc_auc"] >= 0.95 and m["recall"] > 0.0


def test_pca_detector_auc(spark):
    m = E.queries()["pca_detector"](spark, SF_MID).first()
    assert m["roc_auc"] >= 0.75


def test_normal_set_has_no_fraud(spark):
    p = P.prepare(feat(spark, SF_MID))
    assert Q.no_positive_in_normal(p.train_normal()).first()["ok"]
    assert p.train_normal().filter(F.col("split") != "train").count() == 0
