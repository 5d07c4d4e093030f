"""Capped samples of series, fold tables, and deduplication by order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions.columns import SEED, seed64
from scoreloom.functions.storage import cut


def sample_indices(series: str, length: int, cap: int, version: str) -> np.ndarray:
    """Sorted positions without replacement, the same for one (version, series); all of them without a cap."""
    if not cap or length <= cap:
        return np.arange(length)
    return np.sort(np.random.default_rng(seed64(version, series)).choice(length, size=cap, replace=False))


def replicate_version(version: str, replicate: int) -> str:
    return version if replicate == 0 else f"{version}|replicate={replicate}"


def capped_sample(points: DataFrame, cap: int, version: str) -> DataFrame:
    """``points`` (with t = 0, 1, ...) of the sampled positions of each series.

    Positions depend on a series' length alone, so only lengths are grouped; the points join.
    """
    lengths = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    kind = dict(points.dtypes)["series_id"]

    def drawn(frames):
        for pdf in frames:
            for s, n in zip(pdf["series_id"], pdf["n"]):
                yield pd.DataFrame({"series_id": s, "t": sample_indices(str(s), int(n), cap, version).astype(np.int32)})

    picked = lengths.where(F.col("n") > cap).mapInPandas(drawn, f"series_id {kind}, t int") if cap else None
    if picked is None:
        return points
    whole = points.join(lengths.where(F.col("n") <= cap).select("series_id"), "series_id", "left_semi")
    return points.join(picked, ["series_id", "t"], "left_semi").unionByName(whole)


def hash_sample(points: DataFrame, cap: int, version: str) -> DataFrame:
    """A capped sample by the order of a hash of (version, series, t): all in the JVM, and in SQL."""
    key = F.md5(F.concat_ws("|", F.lit(version), F.col("series_id").cast("string"), F.col("t").cast("string")))
    order = Window.partitionBy("series_id").orderBy("h", "t")
    return points.withColumn("h", key).withColumn("k", F.row_number().over(order)).where(F.col("k") <= cap).drop("h", "k")


def series_folds(series: list, k: int, seed: int = SEED) -> list[tuple]:
    """(series, fold): shuffled k folds over series, sizes differing by one at most."""
    order = np.random.RandomState(seed).permutation(len(series))
    ranked = sorted(series)
    return [(ranked[i], f) for f, part in enumerate(np.array_split(order, k)) for i in part]


def numbered(rows: DataFrame, order: str, each: int = 100_000) -> DataFrame:
    """``rows`` with ``rank`` (from 0) in the order of a column without repeats: ranges are numbered apart, and only their sizes meet."""
    n = rows.count()
    parts = max(1, -(-n // each))
    ranged = rows.repartitionByRange(parts, order) if parts > 1 else rows.coalesce(1)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()))
    sizes, starts, at = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}, [], 0  # a row for each range
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part int, __start long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return ranged.withColumn("rank", place.cast("long")).join(known, "__part").withColumn("rank", F.col("rank") + F.col("__start")).drop("__part", "__start")


def fold_table(series: DataFrame, k: int, seed: int = SEED, column: str = "series_id", each: int = 100_000) -> DataFrame:
    """(series_id, k): ``series_folds`` of the distinct series, as a table: no list of series comes to the driver.

    A task takes a range of the permutation and says which rank stands there; ranks join the numbered series.
    """
    ranked = numbered(series.select(column).distinct(), column, each)
    n = ranked.count()

    def dealt(frames):
        for frame in frames:
            for first in frame["id"]:
                order = np.random.RandomState(seed).permutation(n)[first * each : (first + 1) * each]
                place = np.arange(len(order)) + first * each
                big, size = n % k, n // k  # the first folds have one more
                fold = np.where(place < big * (size + 1), place // (size + 1), (place - big) // max(size, 1))
                yield pd.DataFrame({"rank": order.astype(np.int64), "k": fold.astype(np.int32)})

    slices = series.sparkSession.range(max(1, -(-n // each)))
    return ranked.join(slices.mapInPandas(dealt, "rank long, k int"), "rank").select(column, "k")


def keep_one(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order) if last else F.asc(order))
    return rows.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")
