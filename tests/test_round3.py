"""One-scan aggregates, sketches, duplicates by digest, bucketed sets, null groups and empty tables."""

import math
import os
import re
import tracemalloc
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import charts as CH
from riskloom.operators import evaluate as EV
from riskloom.operators import models as M
from riskloom.operators import moments as MO
from riskloom.operators import neighbours as N
from riskloom.operators import ordered as O
from riskloom.operators import prepare as P
from riskloom.operators import quality as Q
from riskloom.operators import relations as R
from riskloom.operators import sketches as K
from riskloom.operators import stats as S
from riskloom.plans.inputs import feat, tx
from riskloom.plans.reports import eda_numbers
from riskloom.schema import FEATURE_COLS
from riskloom.sources import io as IO

from .conftest import SF_SMALL
from .test_plans import _plan


def scans(df) -> int:
    return len(re.findall(r"Scan parquet", _plan(df)))


# ---------------------------------------------------------------- running totals

@pytest.mark.parametrize("rows", [40, 100_000])
def test_running_totals_with_null_and_nan_and_null_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", rows)
    rng = np.random.default_rng(5)
    v = [None, float("nan"), *map(float, np.unique(np.round(rng.normal(size=500), 4))), float("inf")]
    data = [(g, x, int(rng.integers(0, 4))) for g in ("a", None) for x in v]
    df = spark.createDataFrame(data, "g string, v double, n int")
    got = O.running_totals(df.repartition(5), "v", "n", by=["g"], whole="all_").collect()
    assert len(got) == len(data)
    order = lambda x: -math.inf if x is None else (math.inf, 1) if math.isnan(x) else x
    for g in ("a", None):
        mine = [x for x in data if x[0] == g]
        keyed = sorted(mine, key=lambda x: (2, 0) if x[1] is None else (0, 0) if math.isnan(x[1]) else (1, -x[1]))
        want = dict(zip([str(x[1]) for x in keyed], np.cumsum([x[2] for x in keyed]).tolist(), strict=True))
        assert {str(r.v): r.cum_n for r in got if r.g == g} == want
        assert {r.all_n for r in got if r.g == g} == {sum(x[2] for x in mine)}
    assert order(None) == -math.inf


def test_buckets_of_running_totals_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 1)
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    most = O.BUCKETS_PER_CORE * spark.sparkContext.defaultParallelism
    cuts = O.sketch_cuts(df, "v", most, 1)
    assert len(cuts) == most - 1
    sizes = np.diff([0, *np.searchsorted(np.arange(20_000), cuts), 20_000])
    assert sizes.max() < 2.5 * 20_000 / most
    assert np.allclose(O.sketch_cuts(df, "v", most, 5_000), [5_000, 10_000, 15_000], atol=600)
    assert O.sketch_cuts(df.limit(0), "v", most, 1) == []


def test_null_groups_are_groups(spark):
    rows = [(g, float(k % 7), k % 2, "x" if k % 3 else None) for g in ("a", "b", None) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, v double, isFraud int, type string")
    pdf = pd.DataFrame(rows, columns=["g", "v", "y", "t"])
    mmm = {r.g: r for r in S.grouped_mean_median_max(df, "v", "g").collect()}
    assert set(mmm) == {"a", "b", None} and all(r.median == pdf.v[:40].median() for r in mmm.values())
    mix = S.type_mix(df, "g").collect()
    assert {r.g for r in mix} == {"a", "b", None} and sum(r.share_pct for r in mix if r.g is None) == pytest.approx(100, abs=1e-4)
    assert {r.g for r in CH.boxplot_stats(df, "v", "g").collect()} == {"a", "b", None}
    dens = CH.clipped_density_histogram(df, "v", "g", df, 0.5, 5).collect()
    assert {r.g for r in dens} == {"a", "b", None} and sum(r["count"] for r in dens) == 120
    curve = EV.score_curve(df, score="v", by=["g"]).collect()
    assert len(curve) == 21 and {(r.P, r.N) for r in curve} == {(20, 20)}
    met = {r.g: r for r in EV.fraud_metrics(df, 3.0, score="v", by=["g"]).collect()}
    assert met[None].roc_auc is not None and met[None].roc_auc == met["a"].roc_auc


def test_charts_of_an_empty_table(spark):
    none = spark.createDataFrame([], "v double, g string, isFraud int")
    assert CH.histogram(none, "v").collect() == []
    assert CH.clipped_density_histogram(none, "v", "g", none, 0.5).collect() == []
    assert CH.boxplot_stats(none, "v", "g").collect() == []
    assert CH.rate_series(none, "g").collect() == []


# ---------------------------------------------------------------- one scan

def test_reports_scan_little(spark):
    assert scans(R.mule_overlap(tx(spark, SF_SMALL))) == 1
    assert scans(eda_numbers(tx(spark, SF_SMALL), feat(spark, SF_SMALL))) == 2
    for df in (S.derive_high_risk_hours(feat(spark, SF_SMALL)), S.type_mix(tx(spark, SF_SMALL), "isFraud"), CH.rate_series(feat(spark, SF_SMALL), "hour"),
               Q.stratification_check(feat(spark, SF_SMALL).withColumn("split", F.col("type")))):
        assert scans(df) == 1


def test_co_moments_equal_pandas_and_lose_nothing_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    x[:, 1] += 0.5 * x[:, 0]
    x[:, 2] = 3.25
    x[rng.random(x.shape) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd"))
    far = pdf + [1e9, -1e8, 0, 1e7]
    for frame, close in ((pdf, 1e-12), (far, 1e-6)):
        df = spark.createDataFrame(frame).repartition(7).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
        got = {(r.row, r.col): r["corr"] for r in MO.correlations(df, "abcd", "abcd").collect()}
        want = pdf.corr()
        for i in "abcd":
            for j in "abcd":
                if "c" in (i, j):
                    assert got[i, j] is None
                else:
                    assert got[i, j] == pytest.approx(want.loc[i, j], abs=close)
    assert {r["corr"] for r in MO.correlations(df.limit(0), "ab", "a").collect()} == {None}


def test_co_moments_merge_like_one_batch():
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, size=(900, 3))
    x[rng.random(x.shape) < 0.3] = np.nan
    whole, parts = MO._batch(x), np.zeros((6, 3, 3))
    for a, b in ((0, 1), (1, 1), (1, 400), (400, 900)):
        parts = MO._merge(parts, MO._batch(x[a:b]))
    assert np.allclose(parts, whole)


# ---------------------------------------------------------------- digests, Bloom filters, frequent values

def wide(spark):
    nan = float("nan")
    rows = [(1, "a", 0.0, None), (1, "a", -0.0, None), (1, None, 0.0, "a"), (1, "a", nan, None), (1, "a", nan, None), (None, None, None, None), (None, None, None, None)]
    rows += [(k % 50, f"s{k % 60}", float(k % 40), "x") for k in range(900)] + [(7, "hot", 1.0, "hot")] * 500
    return spark.createDataFrame(rows, "i int, s string, d double, t string").repartition(6)


def test_duplicates_by_digest(spark):
    df = wide(spark)
    want = df.groupBy("i", "s", "d", "t").count()
    n = want.count()
    assert tuple(Q.duplicate_count(df).first()) == (df.count() - n, n)
    got = Counter(map(str, Q.drop_duplicates(df).collect()))
    assert sum(got.values()) == n and max(got.values()) == 1
    single = df.dropDuplicates()
    assert tuple(Q.duplicate_count(single).first()) == (0, n) and Q.drop_duplicates(single).count() == n
    assert tuple(Q.duplicate_count(df.limit(0)).first()) == (0, 0) and Q.drop_duplicates(df.limit(0)).count() == 0


def test_a_saturated_filter_still_gives_exact_duplicates(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_WORDS", 1)
    df = wide(spark)
    n = df.groupBy("i", "s", "d", "t").count().count()
    assert tuple(Q.duplicate_count(df).first()) == (df.count() - n, n)


def test_bloom_filter_keeps_every_key_and_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = K.Bloom.of(keys, ["k"])
    df = spark.range(50_000).select(F.concat(F.lit("k"), "id").alias("k")).unionAll(spark.createDataFrame([(None,)], "k string"))
    n = bloom.mark(df, "hit").agg(*map(F.expr, ["count_if(hit and cast(substring(k, 2) as int) < 5000)", "count_if(hit)", "count_if(k is null and hit)"])).first()
    assert n[0] == 5000 and n[1] < 5000 + 0.03 * 45_000 and n[2] == 0
    assert K.Bloom.of(keys.limit(0), ["k"]) is None


def test_client_flags_join_only_what_passes_the_filter(spark):
    t = tx(spark, SF_SMALL)
    ids = {r[0] for r in t.filter("isFraud = 1").select("nameOrig").distinct().collect()}
    out = R.fraud_client_flag(t)
    assert {(r.txn_id, r.is_fraud_client) for r in out.select("txn_id", "is_fraud_client").collect()} == {(r.txn_id, int(r.nameOrig in ids)) for r in t.collect()}
    out.collect()
    assert out.columns == [*t.columns, "is_fraud_client"]
    bloom = K.Bloom.of(t.filter("isFraud = 1").select("nameOrig").distinct(), ["nameOrig"])
    joined = bloom.mark(t, "hit").filter("hit").count()
    with_fraud = t.filter(F.col("nameOrig").isin(sorted(ids))).count()
    assert with_fraud <= joined <= with_fraud + 0.05 * t.count()
    assert {r.is_fraud_client for r in R.fraud_client_flag(t.filter("isFraud = 0")).collect()} == {0}


@pytest.mark.parametrize("cells", [1 << 16, 8])
def test_top_values_are_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(K, "CELLS", cells)
    rng = np.random.default_rng(4)
    v = [None if x == 3 else f"v{x}" for x in (rng.zipf(1.5, 4000) % 700).tolist()] + ["hot"] * 2000
    df = spark.createDataFrame([(x,) for x in v], "v string").repartition(5)
    want = sorted(Counter(v).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    for n in (1, 10, 200, 5000):
        assert [tuple(r) for r in K.top_values(df, "v", n).collect()] == want[:n]
    assert K.top_values(df.limit(0), "v", 5).collect() == []


def test_sketches_merge_to_the_whole(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("day"), F.concat(F.lit("a"), F.col("id") % 9000).alias("s"), F.sqrt("id").alias("x"), F.lit(None).cast("string").alias("e"))
    by_day = K.distinct_sketches(df, ["s", "e"], ["day"])
    merged = {r.column: r.n_distinct for r in K.distinct_estimates(by_day).collect()}
    whole = {r.column: r.n_distinct for r in K.distinct_estimates(K.distinct_sketches(df, ["s", "e"])).collect()}
    assert abs(merged["s"] / 9000 - 1) < 0.03 and abs(merged["s"] - whole["s"]) < 0.02 * 9000 and merged["e"] == 0
    q = K.quantile_estimates(K.quantile_sketches(df, ["x"], ["day"]), [0.0, 0.1, 0.5, 0.9, 1.0]).collect()
    for r in q:
        assert abs(r.quantile ** 2 / 30_000 - r.prob) < 0.012
    for none in (K.quantile_sketches(df.limit(0), ["x"], ["day"]), K.quantile_sketches(df.limit(0), ["x"]), K.quantile_sketches(df, ["e"])):
        assert K.quantile_estimates(none, [0.5]).collect() == []


# ---------------------------------------------------------------- models and preparation

def test_parallel_folds_equal_sequential_ones(spark):
    train = P.prepare(feat(spark, "/root/testdata/sf0.01")).split("train")
    fit = M.balanced(lambda d: M.fit_logistic(d, max_iter=20))
    one = sorted(map(tuple, M.fold_counts(train, fit, k=3, parallelism=1).collect()))
    all_ = sorted(map(tuple, M.fold_counts(train, fit, k=3).collect()))
    assert one == all_ and sum(r[1] + r[3] for r in one) == train.filter("isFraud = 1").count()


def test_prepare_observes_sizes_and_leaves_models_serialisable(spark):
    p = P.prepare(feat(spark, SF_SMALL))
    want = {(r.split, r.isFraud): r["count"] for r in p.data.groupBy("split", "isFraud").count().collect()}
    assert p.sizes == {s: (want.get((s, 0), 0), want.get((s, 1), 0)) for s in ("train", "val", "test")}
    model = M.fit_logistic(P.with_weight(p.split("train"), p.weights), max_iter=5)
    assert model.transform(p.data).count() == sum(want.values())
    lazy = P.prepare(feat(spark, SF_SMALL), checkpoint=False)
    assert lazy.sizes == p.sizes and lazy.scaler.keys() == p.scaler.keys()


def test_boxes_are_met_in_blocks():
    rng = np.random.default_rng(3)
    x, low = rng.normal(size=(300, 5)), rng.normal(size=(16_384, 5))
    tracemalloc.start()
    step = max(1, N.BLOCK_CELLS // len(low))
    parts = [N.box_distance(x[a:a + step], low, low + 0.1) for a in range(0, len(x), step)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.concatenate(parts), N.box_distance(x, low, low + 0.1)) and peak < 500e6


# ---------------------------------------------------------------- storage

def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("txn_id"), (F.col("id") * 2).alias("a"))
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    for n in names:
        IO.write_bucketed(rows, n, str(tmp_path / n))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        j = spark.table(names[0]).join(spark.table(names[1]), "txn_id")
        assert "Exchange" not in _plan(j) and j.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for n in names:
            spark.sql(f"DROP TABLE {n}")


def test_splits_written_again_replace_only_themselves(spark, tmp_path):
    data = P.prepare(feat(spark, SF_SMALL)).data
    count = lambda: {r.split: r["count"] for r in IO.load_prepared(spark, str(tmp_path)).groupBy("split").count().collect()}
    IO.write_splits(data, str(tmp_path))
    first = count()
    IO.write_splits(data.filter("split = 'val'"), str(tmp_path))
    IO.write_splits(data, str(tmp_path))
    assert count() == first == {r.split: r["count"] for r in data.groupBy("split").count().collect()}
    IO.write_train_normal(data, str(tmp_path))
    normal = IO.load_train_normal(spark, str(tmp_path))
    assert normal.columns == data.columns and normal.filter("isFraud = 1 or split <> 'train'").count() == 0
    assert normal.count() == data.filter("split = 'train' and isFraud = 0").count()


def test_bad_rows_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "bad.csv")
    with open(path, "w") as f:
        f.write("id, name ,x\n1,a,1.5\n2,b,oops\nthree,c,2\n4,d\n5,e,6,7\n6,,\n")
    good, bad = IO.read_quarantined(spark, path, "id bigint, name string, x double")
    assert {tuple(r) for r in good.collect()} == {(1, "a", 1.5), (6, None, None)}
    assert {r.raw for r in bad.collect()} == {"2,b,oops", "three,c,2", "4,d", "5,e,6,7"}
    assert all(r.file.endswith("bad.csv") for r in bad.collect())
    with pytest.raises(ValueError):
        IO.read_quarantined(spark, path)
    with pytest.raises(Exception):
        IO.read_delimited(spark, path, "id bigint, name string, x double").collect()


def test_plot_rows_take_normal_training_rows(spark):
    data = P.prepare(feat(spark, SF_SMALL)).data
    got = CH.plot_rows(data, 50).groupBy("part").agg(F.count("*").alias("n"), F.max("isFraud").alias("y")).collect()
    n = {r.part: r.n for r in got}
    assert n["train_normal"] == 50 and {r.y for r in got if r.part != "val_fraud"} == {0}
    assert n["val_legit"] + n.get("val_fraud", 0) == data.filter("split = 'val'").count()
    assert os.path.isdir(SF_SMALL) and len(FEATURE_COLS) == 14
