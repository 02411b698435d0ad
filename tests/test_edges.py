"""Hand-made edge fixtures (FIXTURES.md §3)."""

import math
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as EV
from riskloom.operators import features as FE
from riskloom.operators import prepare as P
from riskloom.operators import quality as Q
from riskloom.operators import stats as S
from riskloom.sources import io as IO


@pytest.mark.parametrize("sep", [";", "\t", ","])
def test_delimiter_fallback(spark, sep):
    d = tempfile.mkdtemp(prefix="riskloom-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write(sep.join([" step", "type ", "amount"]) + "\n")
        f.write(sep.join(["1", "PAYMENT", "9.5"]) + "\n")
        f.write(sep.join(["2", "TRANSFER", "100.0"]) + "\n")
    df = IO.load_table(spark, path)
    assert df.columns == ["step", "type", "amount"]
    assert df.count() == 2


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        IO.load_table(spark, "/tmp/data.xlsx")


def test_null_flags_default_to_zero(spark):
    rows = [(1, "TRANSFER", "C1", 1.0), (None, None, "C2", float("nan")), (5, "PAYMENT", None, 3.0),
            (23, "CASH_OUT", "M3", None), (2, None, "C4", 5.0)]
    df = spark.createDataFrame(rows, "step bigint, type string, nameDest string, amount double") \
        .withColumns({"oldbalanceOrg": F.lit(1.0), "newbalanceOrig": F.lit(0.0),
                      "oldbalanceDest": F.lit(0.0), "newbalanceDest": F.lit(0.0)})
    out = FE.build_features(df).toPandas()
    assert out["high_risk_hour"].tolist() == [1, 0, 1, 1, 1]
    assert out["is_transfer_or_cashout"].tolist() == [1, 0, 0, 1, 0]
    assert out["dest_zero_balance"].tolist() == [1, 1, 0, 0, 1]
    miss = {r["column"]: r["missing_values"] for r in Q.missing_values(df).collect()}
    assert miss["amount"] == 2 and miss["type"] == 2 and miss["nameDest"] == 1


def test_negative_and_zero_steps(spark):
    df = spark.createDataFrame(pd.DataFrame({"step": [-1, 0, -25]}))
    out = FE.temporal_features(df, include_is_weekend=True).toPandas()
    assert out["hour"].tolist() == [23, 0, 23]
    assert out["day"].tolist() == [-1, 0, -2]
    assert out["week"].tolist() == [-1, 0, -1]
    assert out["is_weekend"].tolist() == [1, 0, 1]          # (-1 mod 7 = 6), (-2 mod 7 = 5)


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a")], "x int, y string")
    r = Q.duplicate_count(df, ["x", "y"]).first()
    assert r["n_duplicates"] == 2 and r["n_distinct"] == 2
    assert Q.drop_duplicates(df, ["x", "y"]).count() == 2


def test_one_class_labels(spark):
    df = spark.createDataFrame(pd.DataFrame({"isFraud": [0, 0, 0, 0], "score": [0.1, 0.9, 0.3, 0.4],
                                             "high_risk_hour": [1, 1, 0, 0]}))
    m = EV.fraud_metrics(df, 0.5).first()
    assert m["roc_auc"] is None and m["pr_auc"] is None and m["fp"] == 1
    rr = S.risk_ratio(df).first()
    assert rr["rate_flag1_pct"] == 0.0 and rr["ratio"] is None     # 0 / 0 has no ratio


def test_constant_column(spark):
    df = spark.createDataFrame(pd.DataFrame({"c": [3.0] * 5, "isFraud": [0, 1, 0, 1, 0]}))
    scaled = P.apply_scaler(df, P.fit_scaler(df, ["c"], split=None)).toPandas()
    assert scaled["c"].tolist() == [0.0] * 5
    assert S.pearson(df, [("c", "isFraud")])[("c", "isFraud")] is None


def test_repeated_amounts_drop_duplicate_edges(spark):
    amounts = [10.0] * 12 + [float(i) for i in range(20, 28)]
    df = spark.createDataFrame(pd.DataFrame({"amount": amounts, "isFraud": [0] * 19 + [1]}))
    out = S.fraud_by_amount_decile(df).orderBy("bin").toPandas()
    edges = sorted(set(pd.Series(amounts).quantile([i / 10 for i in range(11)]).tolist()))
    assert len(out) == len(pd.cut(pd.Series(amounts), edges, include_lowest=True).cat.categories
                           [pd.cut(pd.Series(amounts), edges, include_lowest=True).value_counts(sort=False) > 0])
    assert int(out["total"].sum()) == 20


def test_missing_type_level(spark):
    df = spark.createDataFrame(pd.DataFrame({"type": ["CASH_IN", "DEBIT", "PAYMENT", "TRANSFER"]}))
    with pytest.raises(ValueError):
        FE.encode_type(df)


def test_balance_anomaly_isclose(spark):
    df = spark.createDataFrame(pd.DataFrame({"oldbalanceOrg": [100.0, 100.0], "newbalanceOrig": [50.0, 90.0],
                                             "amount": [50.0 + 1e-9, 50.0]}))
    out = FE.balance_anomalies(df).toPandas()
    assert len(out) == 1 and math.isclose(out["balance_gap_vs_amount"][0], -40.0)


def test_describe_skips_nan_like_pandas(spark):
    vals = [1.0, float("nan"), 3.0, None, 10.0]
    df = spark.createDataFrame([(x,) for x in vals], "amount double")
    r = S.describe(df, ["amount"], digits=None).first()
    ref = pd.Series(vals, dtype="float64").describe()
    assert r["count"] == ref["count"] == 3
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"),
                         ("p75", "75%"), ("max", "max")]:
        assert r[ours] == pytest.approx(ref[theirs], rel=1e-12)


def test_nan_skipped_in_stats_like_pandas(spark):
    vals = [1.0, float("nan"), 3.0, 10.0, 4.0]
    lab = [0, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(vals, lab)), "amount double, isFraud int")
    s = pd.Series(vals)
    sk = S.skew_kurtosis(df, ["amount"], digits=12).first()
    assert sk["skewness"] == pytest.approx(s.skew(), rel=1e-9)
    r = S.pearson(df, [("amount", "isFraud")])[("amount", "isFraud")]
    assert r == pytest.approx(s.corr(pd.Series(lab, dtype=float)), rel=1e-12)
    m = S.amount_summary(df, digits=12).first()
    assert m["mean"] == pytest.approx(s.mean()) and m["median"] == pytest.approx(s.median())
    params = P.fit_scaler(df, ["amount"], split=None)
    assert params["amount"][0] == pytest.approx(s.mean()) and params["amount"][1] == pytest.approx(s.std(ddof=0))
