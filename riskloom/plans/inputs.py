"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import build_features
from ..sources.fixture import table, transactions


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir)


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(transactions(spark, sf_dir))


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)
