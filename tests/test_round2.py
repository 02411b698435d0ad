"""Refusals, refinement over several levels, readers by header name, partitions, null groups."""

import types

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskloom import session
from riskloom.operators import ordered as O
from riskloom.operators import prepare as P
from riskloom.operators import sampling as SA
from riskloom.operators import stats as S
from riskloom.plans.inputs import feat
from riskloom.sources import io as IO

from .conftest import SF_MID


def labelled(spark, n=400):
    return spark.range(n).select(F.col("id").alias("txn_id"), (F.col("id") % 7 == 0).cast("int").alias("isFraud"))


def test_null_labels_and_keys_are_refused(spark):
    no_label = labelled(spark).withColumn("isFraud", F.when(F.col("txn_id") > 9, F.col("isFraud")))
    no_key = labelled(spark).withColumn("txn_id", F.when(F.col("txn_id") > 9, F.col("txn_id")))
    for bad in (no_label, no_key):
        with pytest.raises(ValueError, match="10 rows without"):
            SA.stratified_split(bad)
        with pytest.raises(ValueError, match="10 rows without"):
            SA.stratified_kfold(bad)


@pytest.mark.parametrize("rows", [50_000, 3, 1])
def test_refined_cuts_are_the_same_rows(spark, monkeypatch, rows):
    want = {r.txn_id: r.split for r in SA.stratified_split(labelled(spark)).collect()}
    folds = {r.txn_id: r.fold for r in SA.stratified_kfold(labelled(spark)).collect()}
    monkeypatch.setattr(SA, "ROWS_PER_BUCKET", rows)
    split = SA.stratified_split(labelled(spark))
    assert {r.txn_id: r.split for r in split.collect()} == want
    assert "Join" not in split._jdf.queryExecution().optimizedPlan().toString()
    assert {r.txn_id: r.fold for r in SA.stratified_kfold(labelled(spark)).collect()} == folds


def test_csv_columns_match_by_name(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("amount,step\n1.5,3\n2.5,4\n")
    got = IO.load_table(spark, str(f), "step bigint, amount double").collect()
    assert [tuple(r) for r in got] == [(3, 1.5), (4, 2.5)]
    with pytest.raises(ValueError, match="no column"):
        IO.load_table(spark, str(f), "step bigint, other double")
    f2 = tmp_path / "b.csv"
    f2.write_text("step,amount\n1,x\n")
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED|FAILFAST"):
        IO.load_table(spark, str(f2), "step bigint, amount double").collect()


def test_cluster_needs_a_shared_checkpoint_folder():
    none = types.SimpleNamespace(isDefined=lambda: False)
    sc = types.SimpleNamespace(master="yarn", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none)),
                               getConf=lambda: types.SimpleNamespace(get=lambda *_: None))
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_prepared_rows_use_every_core(spark):
    assert P.prepare(feat(spark, SF_MID)).data.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 10.0), (None, 20.0), ("b", None)], "g string, v double")
    got = {(r.g, r.column): (r["count"], r.p50) for r in S.describe(df, ["v"], by=["g"]).collect()}
    assert got == {("a", "v"): (2, 2.0), (None, "v"): (2, 15.0), ("b", "v"): (0, None)}


@pytest.mark.parametrize("rows", [100_000, 500, 20])
def test_order_statistics_at_three_bucket_sizes(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", rows)
    rng = np.random.default_rng(2)
    v = np.round(rng.lognormal(2, 1, 2000), 1)
    v[:700] = 3.0
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = {r.qi: r.quantile for r in O.exact_quantiles(df, ["v"], [0.0, 0.3, 0.5, 0.99, 1.0]).collect()}
    assert [got[k] for k in range(5)] == pytest.approx(np.quantile(v, [0.0, 0.3, 0.5, 0.99, 1.0]).tolist())
