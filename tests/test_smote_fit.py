"""The rows that SMOTE makes are made once, not again by each pass of a fit."""

import pytest

from riskloom.plans import q_models as Q

from .conftest import SF_SMALL


class Seen(Exception):
    pass


@pytest.mark.parametrize("query, fit", [(Q.q_logistic_smote, "fit_logistic"), (Q.q_forest_smote, "fit_forest")])
def test_fits_read_the_smote_rows_from_a_checkpoint(spark, monkeypatch, query, fit):
    def caught(train, **_):
        raise Seen(train._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(Q.M, fit, caught)
    with pytest.raises(Seen) as plan:
        query(spark, SF_SMALL)
    assert "Join" not in str(plan.value) and "Union" not in str(plan.value)
