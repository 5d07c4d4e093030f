"""Shared plumbing of the training-data operators: tables, checkpoints and ordering helpers."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder; only Spark's own reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Without it a local master gets a temporary one."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known:
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="scoreloom-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    """A column's name for expressions, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def every(df: DataFrame, but: tuple = ()) -> list[Column]:
    """All columns of ``df`` in order, without those named in ``but`` (in any case)."""
    left_out = {b.lower() for b in but}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in left_out]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` begins with it in any case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def search_tree(value: Column, splits: list, low: int = 0) -> Column:
    """Index of the interval of sorted ``splits`` that holds ``value``: a balanced tree of comparisons."""
    if not splits:
        return F.lit(low)
    mid = len(splits) // 2
    return F.when(value < F.lit(splits[mid]), search_tree(value, splits[:mid], low)).otherwise(
        search_tree(value, splits[mid + 1 :], low + mid + 1)
    )


def tasks_for(rows: int, each: int = 50_000) -> int:
    """Tasks for ``rows`` small rows."""
    return max(1, -(-rows // each))


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """``df`` of at most ``rows`` rows, broadcast in joins where that fits."""
    return F.broadcast(df) if fits(rows, bytes_per_row) else df


def forget(*frames: DataFrame) -> None:
    """Deletes the files of checkpointed frames that nothing reads any more, and lets go of old shuffle files."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = df._jdf.queryExecution().analyzed().collectLeaves().head().rdd().getCheckpointFile()
        if path.isDefined():
            gone = sc._jvm.org.apache.hadoop.fs.Path(path.get())
            gone.getFileSystem(sc._jsc.hadoopConfiguration()).delete(gone, True)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()  # Spark deletes shuffles whose handles are collected


def fits(rows: int, bytes_per_row: int, limit: int = 8 << 20) -> bool:
    """Whether a side of ``rows`` known rows may be broadcast."""
    return rows * bytes_per_row <= limit


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, after which the worker, which outlives its task, gives freed memory back to the machine."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if give_back:
            give_back(0)

    return wrapped
