"""Scale guards on physical plans: no window runs over a whole table in one task.

Bucket thresholds are shrunk so that the small fixture takes the same (bucketed) code
paths as large data; then any ``Window`` fed by ``Exchange SinglePartition`` would put a
whole table into one task.  Threshold grids (≤ 200 rows by construction) are not checked.
"""

import contextlib
import io
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskloom.operators import ordered as O
from riskloom.operators import prepare as P
from riskloom.operators import sampling as SA
from riskloom.plans.inputs import feat
from riskloom.schema import FEATURE_COLS

from .conftest import SF_SMALL

CHECKED = ["stratified_split", "stratified_sample", "stratified_kfold", "random_sample_n", "score_curve",
           "optimal_threshold", "fraud_metrics", "describe", "fraud_by_amount_decile", "boxplot_stats",
           "frauds_per_client", "type_mix", "tail_validation_split", "amount_summary"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return buf.getvalue()


def single_task_windows(plan: str) -> list:
    """Window nodes whose input exchange is ``SinglePartition``."""
    lines = plan.splitlines()
    bad = []
    for i, ln in enumerate(lines):
        if "Window [" not in ln:
            continue
        for nxt in lines[i + 1:]:
            if "Exchange" in nxt or "Window [" in nxt:
                if "Exchange SinglePartition" in nxt:
                    bad.append(ln.strip()[:120])
                break
    return bad


@pytest.fixture
def bucketed(monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 50)
    monkeypatch.setattr(SA, "ROWS_PER_BUCKET", 50)


def test_guard_detects_a_global_window(spark):
    df = spark.range(100).withColumn("r", F.row_number().over(Window.orderBy("id")))
    assert single_task_windows(_plan(df))


@pytest.mark.parametrize("name", CHECKED)
def test_no_window_over_whole_table(spark, bucketed, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not single_task_windows(plan), plan


def test_smote_neighbours_partitioned(spark, bucketed):
    p = P.prepare(feat(spark, SF_SMALL))
    minority = p.split("train").filter(F.col("isFraud") == 1).select("txn_id", *FEATURE_COLS)
    plan = _plan(P.minority_neighbours(minority, FEATURE_COLS, 5))
    assert not single_task_windows(plan), plan


def test_flagship_scan_is_pruned(spark):
    plan = _plan(E.entry(spark))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("value" not in s and "props" not in s for s in schemas), schemas
