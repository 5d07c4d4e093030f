"""Whitening against numpy's own eigenvectors and whole-number sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from scoreloom.llm import whitening
from scoreloom.llm.queries import op13_whitening

FIELDS = "vec_id long, embedding array<float>"


def plain(rows):
    """Eigenvalues, eigenvectors, exact deviations and centred rows of the remaining vectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    y = np.array([[n * a - s for a, s in zip(r, sums)] for r in x], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, dev, y, e[::-1], u[:, ::-1]


def check(got, rows, components=32):
    ids, n, dev, y, e, u = plain(rows)
    k = min(components, len(e))
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    place = {i: j for j, i in enumerate(ids)}
    w = np.full((n, k), np.nan)
    for r in got:
        j, c = place[r["vec_id"]], r["component"] - 1
        w[j, c] = r["whitened"]
        assert r["deviation"] == dev[j] and abs(r["explained"] - e[c] / e.sum()) <= 1e-9 * e[c] / e.sum() and r["identity_error"] <= 1e-4
    want = y @ u[:, :k] / np.sqrt(e[:k])
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w * signs - want).max() < 1e-7
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_whitening_equals_numpy(spark, d):
    rng = np.random.default_rng(d)
    mix = rng.normal(size=(d, d))
    rows = [(i, [float(np.float32(c)) for c in mix @ rng.normal(size=d) + 3]) for i in range(300)]
    rows += [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] * d)]
    check(whitening.whiten_vectors(spark.createDataFrame(rows, FIELDS).repartition(40)).collect(), rows)


def test_whitening_of_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(op13_whitening(spark, sf).collect(), rows)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 70])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.eye(n), np.zeros((n, n)), np.diag(np.arange(n)), np.ones((n, n)), 1e150 * np.ones((n, n))):
        a = a + a.T
        values, vectors = whitening.symmetric_qr(a)
        scale = max(1e-300, np.abs(a).max())
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12 * max(1, n)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * scale * max(1, n)
        assert np.abs(values - np.sort(np.linalg.eigvalsh(a))[::-1]).max() < 1e-12 * scale * max(1, n)


def test_moments_merge_like_one_stream():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(500, 6)) + 1e6
    one, parts = whitening.Moments(6), [whitening.Moments(6) for _ in range(7)]
    one.add(rows)
    for i, p in enumerate(parts):
        p.add(rows[i * 80 : (i + 1) * 80])
    total = whitening.Moments(6)
    for p in parts:
        total.merge(p)
    assert total.n == one.n == 500 and np.allclose(total.covariance(), np.cov(rows.T, bias=True), rtol=1e-8, atol=1e-10)
    assert np.allclose(total.covariance(), one.covariance(), rtol=1e-8, atol=1e-10)


def test_whitening_cases(spark):
    of = lambda rows: whitening.whiten_vectors(spark.createDataFrame(rows, FIELDS)).collect()
    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [])]) == [] and of([(1, [0.5, 2.0])]) == []
    assert of([(i, [1.0, 2.0]) for i in range(5)]) == []  # equal vectors have no direction
    line = of([(i, [float(i), 2.0 * i]) for i in range(6)] + [(None, [7.0, 14.0]), (8, [1.0]), (9, [1e30, 0.0])])
    assert {r["component"] for r in line} == {1} and len(line) == 7 and {r["vec_id"] for r in line} == {0, 1, 2, 3, 4, 5, None}
    twice = of([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0])])
    assert len(twice) == 8 and {r["n"] for r in twice} == {4}


def test_whitening_of_wide_deviations(spark):
    """Exact to 64 bits, null beyond."""
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 1000)) for _ in range(3)]) for i in range(40)]
    rows += [(50, [2.0**30, 0.0, 1.0]), (51, [-(2.0**30), 1.0, 0.0])]
    ids, n, dev, *_ = plain(rows)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten_vectors(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {i: s if s < 2**63 else None for i, s in zip(ids, dev)} and None in got.values() and any(got.values())


def test_whitening_reads_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(30)]
    df = spark.createDataFrame(rows, FIELDS).select("*", *(F.lit(1).alias(c) for c in ("v", "d", "n", "sums", "mean", "component", "b`c", "a.b")))
    check(whitening.whiten_vectors(df).collect(), rows)
