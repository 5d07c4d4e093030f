"""Kendall's tau by inversions against all pairs, and fold tables against the plain permutation."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import inference, sampling


def all_pairs(a, b):
    i, j = np.triu_indices(len(a), 1)
    x, y = np.sign(a[i] - a[j]), np.sign(b[i] - b[j])
    whole = np.sqrt(np.abs(x).sum() * np.abs(y).sum())
    return (x * y).sum() / whole if whole else None, len(i)


@pytest.mark.parametrize(("part", "n", "ties"), [(50_000, 200, 5), (20, 300, 3), (20, 300, 1000), (7, 150, 40), (20, 1, 1), (20, 40, 1)])
def test_tau_equals_all_pairs(spark, monkeypatch, part, n, ties):
    monkeypatch.setattr(inference, "PART", part)
    monkeypatch.setattr(inference, "SPREAD", 0)
    rng = np.random.default_rng(n + ties)
    a = rng.integers(0, ties, n).astype(float)
    b = np.where(rng.random(n) < 0.5, a + rng.integers(0, 3, n), rng.integers(0, ties, n)).astype(float)
    b[: n // 3] = b[0]  # a value that a third of all items has
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i long, a double, b double")
    got, (tau, pairs) = inference.kendall(df, "i", "a", "b").first(), all_pairs(a, b)
    assert got["pairs"] == pairs and (got["tau"] == pytest.approx(tau, abs=1e-12) if tau is not None else got["tau"] is None)


def test_tau_of_items_without_a_value(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 2.0, None), (4, 5.0, 1.0)], "i long, a double, b double")
    assert tuple(inference.kendall(df, "i", "a", "b").first()) == (-1.0, 1)
    assert tuple(inference.kendall(df.limit(0), "i", "a", "b").first()) == (None, 0)


def test_tau_of_a_million_items(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.xxhash64("id").cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.xxhash64("id", F.lit(1)).cast("double")).alias("b"))
    began = time.perf_counter()
    got = inference.kendall(df, "id", "a", "b").first()
    assert abs(got["tau"]) < 0.01 and got["pairs"] == n * (n - 1) // 2 and time.perf_counter() - began < 120


@pytest.mark.parametrize(("n", "k", "each"), [(50, 5, 100_000), (53, 5, 7), (10, 10, 3), (101, 10, 10)])
def test_fold_table_equals_the_permutation(spark, n, k, each):
    rng = np.random.default_rng(n)
    ids = rng.choice(10_000, n, replace=False).tolist()
    got = {r[0]: r[1] for r in sampling.fold_table(spark.createDataFrame([(i,) for i in ids + ids[:5]], "series_id long"), k, each=each).collect()}
    assert got == dict(sampling.series_folds(ids, k)) and len(got) == n
