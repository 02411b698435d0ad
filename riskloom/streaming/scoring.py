"""Structured Streaming surface: the row-local operators on a stream.

The reference has no stream runtime; its authors select features "usable in real time".
Those operators (fixture derivation, B1-B15, scaling with fitted literals, fixed-weight
scoring, B23, B24, H11 in ``train`` mode) are pure column expressions, so the same
functions apply to ``readStream`` DataFrames.  ``run_available`` drives a file-source
stream to completion with an ``availableNow`` trigger into a parquet file sink,
checkpointing under the session's checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators.prepare import apply_scaler
from ..operators.text import explanation_prompt
from ..schema import TYPE_LEVELS
from ..session import ensure_checkpoint_dir
from ..sources.fixture import transactions_from_events

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def stream_features(events: DataFrame, scaler: dict | None = None) -> DataFrame:
    """events → transactions → features → one-hot/log → (scaled) model columns."""
    feats = FE.build_features(transactions_from_events(events))
    kept = feats.withColumns({"amount_raw": F.col("amount"), "type_name": F.col("type")})
    enc = FE.encode_type(FE.log_transform_amount(kept), TYPE_LEVELS, check=False)
    return apply_scaler(enc, scaler) if scaler else enc


def score_stream(df: DataFrame, coefficients: dict, intercept: float, threshold: float = 0.5) -> DataFrame:
    z = sum((F.col(c) * F.lit(float(w)) for c, w in coefficients.items()), F.lit(float(intercept)))
    scored = df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    scored = FE.threshold_classify(scored, threshold)
    return explanation_prompt(scored.withColumn("amount", F.col("amount_raw")), "score", type_col="type_name")


def run_available(stream: DataFrame, name: str | None = None, out_dir: str | None = None) -> DataFrame:
    """Process everything available (``availableNow``) into a parquet file sink and return
    the written table.  The sink is distributed and exactly-once through the stream's
    checkpoint; both live under the session's checkpoint folder unless ``out_dir`` is given.
    """
    spark = stream.sparkSession
    name = name or f"stream_{uuid.uuid4().hex[:8]}"
    base = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/data")

