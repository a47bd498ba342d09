"""Session helpers: checkpoint folder, checked broadcasts, table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when the optimizer's size estimate is below this.
BROADCAST_LIMIT_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size (an upper guess for filtered scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast if the estimated size is within ``limit``; else leave the join to the
    optimizer (sort-merge with adaptive skew splitting)."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def counted_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Hint a broadcast if ``df`` holds at most ``rows`` rows of a few narrow columns, counted by a job of its own;
    else leave the join to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; set a local one only if unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="slatewing-checkpoint-")
    sc.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a table of fewer partitions than the cluster has cores one partition a core.

    Large tables have more input partitions than that and pass without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
