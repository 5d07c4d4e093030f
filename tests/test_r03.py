"""Findings of round 3: bounded rank tasks, sums that no order changes."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import columns as C
from scoreloom.functions.storage import spread
from scoreloom.operators import basis as B
from scoreloom.operators import losses as L
from scoreloom.operators import probes as P
from scoreloom.operators import regression


def test_ranks_sort_once_a_column_and_tasks_hold_bounded_rows(spark):
    rows = spark.range(250_000).select((F.col("id") % 400).alias("s"), *(F.hash("id", F.lit(i)).alias(f"v{i}") for i in range(4)))
    dealt = spread(rows, "s", each=50_000)
    ranked = dealt.select("s", *(C.rank01(f"v{i}", "s").alias(f"u{i}") for i in range(4)))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 4
    assert ranked.groupBy(F.spark_partition_id()).count().count() == 5  # adaptive execution would merge them into one


def test_cells_are_joined_in_tasks_of_as_many_points_as_the_ranks(spark, monkeypatch):
    """Without a broadcast the counts of cells are sorted for their join; merged by bytes, a task held those of millions of points."""
    monkeypatch.setattr(L, "pieces", lambda df: 9, raising=False)
    rows = spark.range(6000).select(
        (F.col("id") % 60).alias("series_id"), (F.col("id") % 4).alias("source_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.hash("id").cast("double").alias("x"), F.hash("id", F.lit(1)).cast("double").alias("a")
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        losses = L.four_losses(rows, ["a"])
        assert losses.count() == 60
        plan = losses._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = re.findall(r"hashpartitioning\(source_id#\d+L?, series_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)
    assert dealt and set(dealt) == {"9"}


def test_shared_losses_are_the_same_in_any_order(spark):
    rng = np.random.default_rng(5)
    points = [(int(s), int(s) % 5, float(rng.normal()), int(rng.random() < 0.2), *map(float, rng.integers(0, 11, 2))) for s in range(400) for _ in range(int(rng.integers(30, 60)))]
    df = spark.createDataFrame(points, "series_id long, source_id long, x double, y int, a double, b double")
    found = []
    for parts, detectors in ((1, ["a"]), (7, ["b"]), (13, ["a", "b"])):
        rows = L.four_losses(df.repartition(parts, F.rand(parts)), detectors)
        found.append({r[0]: (r[1], r[2]) for r in rows.select("series_id", "L_null", "L_basis").collect()})
    assert found[0] == found[1] == found[2]


def test_blocks_hold_ranks_as_whole_numbers(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 600, 33_000):
        x = np.column_stack([B.ranks01(rng.integers(0, max(2, n // 3), n)) for _ in range(4)] + [rng.normal(size=n)])
        packed = P.block(1, 1, x, np.zeros(n), np.ones(n), 4)
        assert len(packed["x"]) == n * (4 * (2 if n < 32768 else 4) + 8)
        assert np.array_equal(P.unpacked(packed["x"], n, 5, 4), x)


def test_reconstruction_of_blocks_equals_that_of_rows(spark):
    rng = np.random.default_rng(3)
    series = [(g, 10 * g + i, B.ranks01(rng.normal(size=n)), B.ranks01(rng.normal(size=n))) for g in range(4) for i, n in enumerate((30, 50))]
    series[0] = (*series[0][:3], np.full(30, 0.5))  # a constant target
    blocks = spark.createDataFrame([P.block(g, s, np.column_stack([u, v]), np.zeros(len(u)), np.ones(len(u)), 2) | {"u": 0.5} for g, s, u, v in series], P.block_schema("long", "long"))
    rows = spark.createDataFrame([(g, s, 0.5 / len(u), float(a), float(b)) for g, s, u, v in series for a, b in zip(u, v)], "source_id long, series_id long, w double, u double, s double")
    found = {r["series_id"]: r for r in regression.block_reconstruction(blocks, 2, (0,), {"d": 1}).collect()}
    both = rows.join(regression.simple_ridge(rows), "source_id").withColumn("p", F.col("intercept") + F.col("slope") * F.col("u"))
    for r in regression.reconstruction_quality(both, "s", "p", "series_id").collect():
        got = found[r["series_id"]]
        assert got["n_points"] == r["n_points"] and got["MSE"] == pytest.approx(r["MSE"])
        assert got["R2"] is None if r["R2"] is None else got["R2"] == pytest.approx(r["R2"])
    assert found[0]["R2"] is None


def test_trees_count_three_features_at_once_and_one_child():
    rng = np.random.default_rng(2)
    x = rng.random((31_000, 5))
    y, w = (rng.random(len(x)) < 0.6 * x[:, 0]).astype(float), rng.random(len(x))
    model = P.Trees(trees=2)
    b = model.binned(x)
    coded, rows = model._coded(b), np.flatnonzero(y > 0)
    assert len(coded[2]) == 2
    found = model._histogram(coded, w, w * w, rows)
    for f in range(5):
        assert np.array_equal(found[0, f], np.bincount(b[f, rows], minlength=31))
        assert np.allclose(found[1, f], np.bincount(b[f, rows], w[rows], 31)) and np.allclose(found[2, f], np.bincount(b[f, rows], (w * w)[rows], 31))
    one = P.Trees(trees=2, bins=31)
    one._coded = lambda b: (b, [range(f, f + 1) for f in range(len(b))], [v.astype(np.uint16) for v in b])
    assert np.allclose(model.fit(b, y, w).predict(b), one.fit(b, y, w).predict(b), atol=1e-12)


def test_folds_start_from_the_groups_sums(spark, monkeypatch):
    """No pass at the joint solution, a start on some series, and still each fold's own minimum."""
    rng = np.random.default_rng(8)
    made = []
    for s in range(64):
        x = np.column_stack([B.ranks01(rng.normal(size=120)) for _ in range(2)])
        made.append(P.block(s % 4, s, x, (rng.random(120) < x[:, 0]).astype(float), np.full(120, 1 / 120), 2))
    blocks = spark.createDataFrame(made, P.block_schema("long", "long")).repartition(2)
    trials, fold_pass = [], P._fold_pass
    monkeypatch.setattr(P, "_fold_pass", lambda width, probes, sent: trials.append(sent.value[0][0][1].copy()) or fold_pass(width, probes, sent))
    probe, folds = P.Probe("p", (0, 1)), P.held_out([0, 1, 2, 3])
    plain = P.fit(blocks, 2, [probe], folds)[0]
    assert not np.allclose(trials[0][0], trials[0][1], rtol=0, atol=1e-9)
    monkeypatch.setattr(P, "ENOUGH", 10)
    assert np.allclose(P.fit(blocks, 2, [probe], folds)[0], plain, atol=1e-6)
    for k, beta in enumerate(plain):
        rows = [m for m in made if m["g"] != k]
        z = np.concatenate([P.design(P.unpacked(m["x"], 120, 2, 2), "linear") for m in rows])
        y = np.concatenate([np.frombuffer(m["y"]) for m in rows])
        gradient = z.T @ (P.sigmoid(z @ beta) - y) + beta / probe.c
        assert np.abs(gradient).max() < 1e-4
