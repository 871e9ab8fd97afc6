"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable.

    A cluster names a folder all executors share in ``spark.checkpoint.dir``; only where that
    setting is missing (tests, one machine) a temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder, without their lineage."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; no frame made from it may be read any more."""
    at = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if at.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def small(df: DataFrame, limit: int = 1_000_000) -> tuple[DataFrame, bool]:
    """``df`` for the lookup side of a join, and whether it is broadcast.

    It is written once and counted; with at most ``limit`` (narrow) rows it gets a broadcast hint, and
    beyond that it stays an ordinary join side.
    """
    df = cut(df)
    fits = df.count() <= limit
    return (F.broadcast(df) if fits else df), fits
