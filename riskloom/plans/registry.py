"""Registry of named queries: ``name -> (spark callable, DuckDB oracle SQL | None)``.

Every query reads the driver's tables (``transactions`` is derived from ``events``), so
its work grows with the data.  Oracle SQL runs on DuckDB over the same parquet views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # Importing the query modules fills REGISTRY.
    from . import q_features, q_quality, q_stats, q_sampling  # noqa: F401
    from . import q_evaluate, q_charts, q_models, q_io  # noqa: F401
    return REGISTRY
