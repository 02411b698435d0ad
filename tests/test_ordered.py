"""Distributed order statistics against NumPy, including the multi-bucket path."""

import numpy as np
import pandas as pd
import pytest

from riskloom.operators import ordered as O


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(7)
    v = np.round(rng.lognormal(3, 2, 3000), 1)
    v[:900] = 5.0                                   # one hot value holding ~a third of rows
    g = rng.integers(0, 3, 3000)
    return spark.createDataFrame(pd.DataFrame({"g": g, "v": v, "w": rng.normal(size=3000)})), v, g


@pytest.mark.parametrize("rows_per_bucket", [100_000, 200])
def test_exact_quantiles_match_numpy(spark, frame, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", rows_per_bucket)
    df, v, g = frame
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r["qi"]: r["quantile"] for r in O.exact_quantiles(df, ["v"], probs).collect()}
    for i, p in enumerate(probs):
        assert got[i] == pytest.approx(np.percentile(v, p * 100), rel=1e-12, abs=1e-12)
    grouped = O.exact_quantiles(df, ["v", "w"], [0.5], by=["g"]).collect()
    pdf = pd.DataFrame({"g": g, "v": v})
    for r in grouped:
        if r["column"] == "v":
            assert r["quantile"] == pytest.approx(np.median(pdf[pdf.g == r["g"]].v), rel=1e-12)


@pytest.mark.parametrize("rows_per_bucket", [100_000, 50])
def test_running_totals_match_cumsum(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = np.random.default_rng(3)
    s = np.unique(rng.normal(size=800))
    pos = rng.integers(0, 3, len(s))
    df = spark.createDataFrame(pd.DataFrame({"s": s, "pos": pos}))
    out = O.running_totals(df, "s", ["pos"], descending=True).toPandas().sort_values("s", ascending=False)
    assert (out["cum_pos"].to_numpy() == np.cumsum(out["pos"].to_numpy())).all()
