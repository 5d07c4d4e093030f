"""Column functions of the evaluation: losses, rank normalisation, hashing and seeds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Probabilities are held this far from 0 and 1; the seed of all resampling.
EPS = 1e-7
SEED = 2024


def rounded(value: Column | str, places: int = 6) -> Column:
    """``value`` rounded, with -0.0 as 0.0."""
    return F.round(F.col(value) if isinstance(value, str) else value, places) + F.lit(0.0)


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))


def log_loss_bits(positive: Column, total: Column, p: Column) -> Column:
    """Summed binary log-loss in bits of ``positive`` ones among ``total`` points, all given probability p."""
    q = clipped(p)
    return -(positive * F.log2(q) + (total - positive) * F.log2(1 - q))


def exact_sum(value: Column, places: int = 24) -> Column:
    """The sum of ``value`` at a fixed number of places: the same in any order of the rows."""
    return F.sum(value.cast(f"decimal(38,{places})"))


def average_rank(value: str, *keys: str) -> Column:
    """1-based rank with ties averaged, within ``keys``; first and last place of a tie share one window, so one sort."""
    order = Window.partitionBy(*keys).orderBy(value)
    first, last = F.rank().over(order), F.count(F.lit(1)).over(order)
    return first + (last - first) / F.lit(2.0)


def rank01(value: str, *keys: str) -> Column:
    """(average rank - 1/2) / n within ``keys``; a constant curve is 1/2 everywhere."""
    return (average_rank(value, *keys) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def minmax(value: str, *keys: str) -> Column:
    within = Window.partitionBy(*keys)
    low, high = F.min(value).over(within), F.max(value).over(within)
    return F.when(high == low, F.lit(0.5)).otherwise((F.col(value) - low) / (high - low))


def zscore(value: str, *keys: str) -> Column:
    """Population z-score within ``keys``; 0 for a constant curve."""
    within = Window.partitionBy(*keys)
    low, high = F.min(value).over(within), F.max(value).over(within)
    return F.when(high == low, F.lit(0.0)).otherwise((F.col(value) - F.avg(value).over(within)) / F.stddev_pop(value).over(within))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """The standard normal distribution function."""
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2.0)))


def zscore_cdf(value: str, *keys: str) -> Column:
    return normal_cdf(zscore(value, *keys))


def source_token(series: Column) -> Column:
    """The source in a series name like 001_NAME_id_1_..., an error if there is none."""
    token = F.regexp_extract(series, r"^\d+_([^_]+)_", 1)
    return F.when(token == "", F.raise_error(F.concat(F.lit("no source in "), series))).otherwise(token)


def train_cut(series: Column) -> Column:
    """The training prefix in a series name: the third token from the end of its stem."""
    stem = F.regexp_replace(series, r"\.[^.]*$", "")
    return F.element_at(F.split(stem, "_"), -3).cast("long")


@F.pandas_udf(T.StringType())
def array_sha256(values: pd.Series) -> pd.Series:
    """SHA-256 of an array's little-endian float64 bytes."""
    return values.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f8").tobytes()).hexdigest())


def seed64(*parts: str) -> int:
    """A seed from text: the first eight bytes of its SHA-256, little endian."""
    return int.from_bytes(hashlib.sha256("|".join(parts).encode()).digest()[:8], "little")


def seed64_column(key: Column) -> Column:
    """``seed64`` of a column as decimal(20, 0)."""
    digest = F.sha2(key, 256)
    turned = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")
