"""SparkSession helpers.

The library never creates a session behind the caller's back: every operator takes
DataFrames.  ``build_session`` is for scripts, tests and the benchmark; on a cluster
the user's session (and its ``spark.checkpoint.dir``) is used as it is.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "riskloom") -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, setting it once.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting is always respected.  Where it is
    unset, a local session gets a scratch folder that goes when Python exits, and a session on a cluster is
    refused: executors could not read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master: {sc.master})")
        path = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df):
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage.

    Uses ``DataFrame.checkpoint`` into the session's checkpoint directory, never
    ``localCheckpoint``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_observed(df, metrics) -> tuple:
    """(``cut_lineage(df)``, {name: value}): aggregates gathered in the very pass that writes the checkpoint.

    By name, not by an ``Observation``: registering one leaves an object in the session that the training summary of a
    fitted logistic regression, which holds the session, can't be serialised with.
    """
    seen = df.observe("seen", *metrics)
    cut = cut_lineage(seen)
    row = seen._jdf.queryExecution().observedMetrics().apply("seen")
    names = [f for f in row.schema().fieldNames()]
    return cut, {name: None if row.isNullAt(k) else row.get(k) for k, name in enumerate(names)}


def cluster_conf(input_bytes: int, total_cores: int, target_partition_mb: int = 256,
                 broadcast_mb: int = 64) -> dict:
    """Spark settings sized for a cluster run over ``input_bytes`` of parquet.

    * shuffle partitions: enough that each holds ~``target_partition_mb`` of (compressed)
      input, and at least 3 waves of the cluster's cores; AQE then coalesces small ones;
    * file splits of 256 MB keep scan tasks few but memory-safe;
    * skew join splitting kicks in for partitions 5x the median and over 1 GB, so a key
      holding a third of all rows is split across tasks instead of landing in one;
    * the broadcast threshold is an explicit cap: only tables known to be small (bucket
      plans, quotas, 1-row aggregates, grids) are broadcast above it by hint.
    """
    mb = 1024 * 1024
    by_size = max(1, int(input_bytes // (target_partition_mb * mb)))
    partitions = max(3 * total_cores, by_size)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 * mb),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_mb * mb),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_mb * mb),
        "spark.sql.session.timeZone": "UTC",
    }
