"""Session factory and the few settings every job shares."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    A temporary folder is set up only where a local session names none, as in
    tests; on a cluster, where each machine would write to its own disk, a
    missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    Rows that leave here survive the loss of any executor.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan at least as many partitions as there are cores.

    Only a scan that comes as fewer partitions than the cluster has cores is
    redistributed (small inputs in one file); at scale the scan's own splits
    hold and nothing is shuffled.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)


def small(df: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """A local copy of a DataFrame of at most ``limit`` rows, computed once; else itself, and whether it is local."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def once(scan: DataFrame, key: str, *columns: str, limit: int = 200_000) -> DataFrame:
    """(key, columns) of a scan of Parquet files, each key once: of several rows the first by file and place.

    Only keys and places are grouped; the other columns stay where they are read.
    The repeated keys are sent to the tasks below ``limit``; beyond that they are
    joined by whatever way the engine picks.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    repeated = scan.select(F.col(key).alias("_key"), place.alias("_p")).groupBy("_key").agg(F.count("*").alias("_n"), F.min("_p").alias("_first")).where("_n > 1").select("_key", "_first")
    first, local = small(repeated, limit)
    rows = scan.select(key, *columns, place.alias("_place"))
    rows = rows.join(F.broadcast(first) if local else first, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.where(F.col("_first").isNull() | (F.col("_place") == F.col("_first"))).select(key, *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
