"""Where jobs put their intermediate and side-effect tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only on one machine a local one is chosen where none is named, once per
    application, and set as checkpoint folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="buildlens-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/buildlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys into the session's number of shuffle partitions.

    For Python work per group: adaptive execution judges partitions by size and
    would put small but compute-heavy groups into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def append_by_period(df: DataFrame, path: str, time_column: str = "created_at", period: str = "day") -> None:
    """Append to a table partitioned by the day (week, month) of its time column.

    The rebalance hint brings the rows of a period together before writing, so
    that a task does not leave one small file per period, and lets adaptive
    execution split a period that is too large for one task.
    """
    start = F.to_date(F.date_trunc(period, time_column))
    df.withColumn(period, start).hint("rebalance", F.col(period)) \
        .write.mode("append").partitionBy(period).parquet(path)
