"""Curves of long series by chunks against the kernel over whole series."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import basis, longseries


def test_chunks_and_counted_ranks_equal_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(longseries, "RANGE", 700)
    rng, rows = np.random.default_rng(3), []
    for s, n in enumerate((1, 5, 200, 640, 641, 959, 960, 1500, 2000)):
        x = np.cumsum(rng.normal(size=n))
        if s == 7:
            x[300:1100] = 4.0  # a stretch of equal values, across a border
        rows += [(s, t, float(v), s % 3, t % 2) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id long, t int, x double, source_id int, y int")
    got = longseries.chunked_basis(df, chunk=640).toPandas()
    ranked = longseries.ranked_long(df, chunk=640).toPandas()
    assert len(got) == len(rows) and len(ranked) == len(rows)
    for s in range(9):
        x = np.array([r[2] for r in rows if r[0] == s])
        m = basis.basis_matrix(x)
        one = got[got.series_id == s].sort_values("t")
        assert (one.t == np.arange(len(x))).all() and np.allclose(np.array(one.basis.tolist()), m, rtol=1e-9, atol=1e-9)
        if s != 7:  # where rounding can't make ties
            want = np.column_stack([basis.ranks01(m[:, j]) for j in range(m.shape[1])])
            assert np.allclose(np.array(ranked[ranked.series_id == s].sort_values("t").basis.tolist()), want, atol=1e-9)


def test_ranks_of_a_value_that_most_rows_have(spark, monkeypatch):
    monkeypatch.setattr(longseries, "RANGE", 5)
    rng = np.random.default_rng(1)
    v = np.where(rng.random(400) < 0.5, 3.0, rng.integers(0, 40, 400).astype(float))
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "k int, v double")
    got = {(r["k"], r["v"]): r["r"] for r in longseries.value_ranks(df, ["k"], "v").collect()}
    for k in (0, 1):
        part = v[k::2]
        want = basis.ranks01(part)
        assert all(got[k, x] == pytest.approx(r, abs=1e-12) for x, r in zip(part, want))


def test_chunks_have_to_hold_the_halo(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "series_id long, t int, x double")
    for chunk in (64, 321):
        with pytest.raises(ValueError, match="chunks"):
            longseries.chunked_basis(df, keep=(), chunk=chunk)


def test_one_long_series_is_many_tasks(spark):
    n = 400_000
    df = spark.range(n).select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("t"), F.sin("id").alias("x"))
    began = time.perf_counter()
    found = longseries.chunked_basis(df, ("Var-256", "Range-8", "SpecEnt-64"), (), 32_768)
    assert found.groupBy(F.floor(F.col("t") / 32_768)).count().count() == -(-n // 32_768) and found.count() == n
    assert time.perf_counter() - began < 90


def test_edges_are_filled_in_linear_time(spark):
    df = spark.range(200_000).select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("t"), F.sin("id").alias("x"))
    began = time.perf_counter()
    got = basis.with_feature(df, "Range-32").agg(F.count("Range-32").alias("n"), F.min("Range-32").alias("low")).first()
    assert got["n"] == 200_000 and got["low"] > 1 and time.perf_counter() - began < 60
