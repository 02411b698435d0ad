"""Sources and sinks.

Readers return lazy DataFrames with an explicit schema where one is known; writers use
Spark's distributed writers (one file per partition, never a driver-side concatenation).
"""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURE_COLS, KEY, RAW_SCHEMA, TARGET, require_columns
from ..session import cut_lineage


def strip_column_names(df: DataFrame) -> DataFrame:                                   # A4
    return df.toDF(*[c.strip() for c in df.columns])


def _header(spark: SparkSession, path: str, schema):
    """(names in the header, delimiter, {column: type} or None if the types must be inferred)."""
    first = spark.read.text(path).limit(1).collect()        # one line
    header = first[0][0] if first else ""
    sep = ","
    if "," not in header:
        if ";" in header:
            sep = ";"
        elif "\t" in header:
            sep = "\t"
    names = [c.strip().strip('"').strip() for c in header.split(sep)]
    if schema is None and {f.name for f in RAW_SCHEMA} <= set(names) <= {f.name for f in RAW_SCHEMA} | {KEY}:
        schema = T.StructType([*RAW_SCHEMA.fields, *([T.StructField(KEY, T.LongType())] if KEY in names else [])])
    if schema is None:
        return names, sep, None
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    types = {f.name.strip(): f.dataType for f in schema}
    missing = [c for c in types if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {missing} in the header {names}")
    return names, sep, types


def read_delimited(spark: SparkSession, path: str, schema=None) -> DataFrame:         # A1
    """CSV with header; when the header parses as one column containing ';' or a tab,
    re-read with that delimiter (the header line is sniffed with a one-line read).

    A given schema is matched to the header by name: columns may stand in any order, one that is missing is refused, and
    a cell that doesn't parse fails the read.  Without one, the transaction table's own schema serves where the header names
    its columns (plus ``txn_id``); else types are inferred by a scan.
    """
    names, sep, types = _header(spark, path, schema)
    if types is None:
        return strip_column_names(spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path))
    in_file = T.StructType([T.StructField(f"_{k}", types.get(c, T.StringType())) for k, c in enumerate(names)])
    df = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").schema(in_file).csv(path)
    return df.select(*[F.col(f"_{names.index(c)}").alias(c) for c in types])


def read_quarantined(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, DataFrame]:        # A1
    """(good rows, bad rows) of a CSV with header: bad rows, where a cell doesn't parse or the number of cells is wrong, come as
    ``raw`` text with the ``file`` they are from.  Both are cut from one read, so they always add up to the file."""
    names, sep, types = _header(spark, path, schema)
    if types is None:
        raise ValueError(f"{path}: a schema is needed to tell bad cells")
    in_file = T.StructType([*(T.StructField(f"_{k}", types.get(c, T.StringType())) for k, c in enumerate(names)), T.StructField("_raw", T.StringType())])
    df = (spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").schema(in_file).csv(path)
          .withColumn("_file", F.input_file_name()))
    df = cut_lineage(df)
    good = df.filter("_raw is null").select(*[F.col(f"_{names.index(c)}").alias(c) for c in types])
    return good, df.filter("_raw is not null").select(F.col("_raw").alias("raw"), F.col("_file").alias("file"))


def load_table(spark: SparkSession, path: str, schema=None) -> DataFrame:             # A2
    ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if ext == "csv":
        return read_delimited(spark, path, schema)
    if ext == "parquet":
        return strip_column_names(spark.read.parquet(path))
    if ext == "json":
        r = spark.read.schema(schema).option("mode", "FAILFAST") if schema is not None else spark.read
        return strip_column_names(r.json(path))
    raise ValueError(f"unsupported format {ext!r}: use csv, parquet or json")


def write_splits(prepared: DataFrame, out_dir: str, fmt: str = "parquet") -> None:    # A6
    """Prepared rows partitioned by ``split`` (train/val/test).  Only the splits that are written again are replaced, so a rerun of
    one of them, or of all, gives the same table."""
    prepared.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").format(fmt).save(f"{out_dir}/prepared")


def write_train_normal(prepared: DataFrame, out_dir: str) -> None:                    # A6
    """The normal training rows as a set of their own."""
    prepared.filter((F.col("split") == "train") & (F.col(TARGET) == 0)).write.mode("overwrite").parquet(f"{out_dir}/train_normal")


def load_train_normal(spark: SparkSession, out_dir: str) -> DataFrame:                # A12
    return spark.read.parquet(f"{out_dir}/train_normal")


def write_bucketed(df: DataFrame, table: str, path: str, key: str = KEY, buckets: int | None = None) -> None:      # A6 / A14
    """An external table bucketed and sorted by ``key``: tables of as many buckets join on it without an exchange."""
    buckets = buckets or df.sparkSession.sparkContext.defaultParallelism
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def write_smote(smoted: DataFrame, out_dir: str) -> None:                             # A6
    smoted.write.mode("overwrite").parquet(f"{out_dir}/train_smote")


def load_prepared(spark: SparkSession, out_dir: str, feature_cols=None) -> DataFrame:  # A12
    feature_cols = list(FEATURE_COLS if feature_cols is None else feature_cols)
    df = spark.read.parquet(f"{out_dir}/prepared")
    require_columns(df, [KEY, TARGET, "split", *feature_cols], "load_prepared")
    return df.select(KEY, "split", F.col(TARGET).cast("int").alias(TARGET),
                     *[F.col(c).cast("double").alias(c) for c in feature_cols])


def write_json_row(df: DataFrame, path: str) -> None:                                 # A7-A9, A11
    """A small report DataFrame (one or few rows) as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:                                      # A10
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scores(scored: DataFrame, path: str) -> None:                               # A14
    scored.select(KEY, "split", "score").write.mode("overwrite").partitionBy("split").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:                              # A13
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:                                           # A13
    return PipelineModel.load(path)


def save_params(spark: SparkSession, params: dict, path: str) -> None:                # A13 (scaler, AE)
    spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(path).first()["params"])

