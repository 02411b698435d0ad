"""The end-to-end driver program runs and writes every artefact (small settings)."""

import json
import os
import tempfile

from riskloom.plans.flow import run_all
from riskloom.sources.fixture import transactions

from .conftest import SF_SMALL


def test_run_all_writes_reports(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="riskloom-flow-"), "out")
    res = run_all(spark, transactions(spark, SF_SMALL), out, with_forest=False)
    models = {r["model"] for r in res.collect()}
    assert models == {"LR_balanced", "LR_smote", "PCA_recon"}
    for name in ["eda_report", "prep_report", "features_meta", "baseline_report", "detector_report",
                 "thresholds", "all_metrics", "prepared", "train_smote", "scores", "eda_summary_stats"]:
        assert os.path.isdir(os.path.join(out, name)), name
    rep = [f for f in os.listdir(os.path.join(out, "detector_report")) if f.endswith(".json")][0]
    got = json.loads(open(os.path.join(out, "detector_report", rep)).read())
    assert got["architecture"] == {"n_axes": 4, "n_features": 14} and got["training"]["n_samples"] > 0
