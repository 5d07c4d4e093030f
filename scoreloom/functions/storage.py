"""The folder that driver and executors share, and checkpoints there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Without it a local master gets a temporary folder; a cluster must name one."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="scoreloom-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def pieces(df: DataFrame, each: int = 100_000) -> int:
    """The number of partitions that hold about ``each`` rows of ``df``."""
    return max(1, -(-df.count() // each))


def spread(df: DataFrame, *keys: str, each: int = 100_000) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of about ``each`` rows, however many rows there are; adaptive execution doesn't merge them."""
    return df.repartition(pieces(df, each), *keys)
