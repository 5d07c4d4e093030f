"""Findings of round 4: shared folds, packed bootstraps, kernels of the curves."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import basis as B
from scoreloom.operators import inference as I
from scoreloom.operators import probes as P
from scoreloom.plans import learned
from scoreloom.sources import files


def test_a_bootstrap_of_many_sources_counts_in_packed_pieces(spark, monkeypatch):
    """A row for each drawn place, in one task, was 6e8 rows for 60,000 series; pieces are a row each and are dealt out."""
    monkeypatch.setattr(I, "PLACES", 64)
    monkeypatch.setattr(I, "RUN_DRAWS", 5000)
    rng = np.random.default_rng(3)
    v = {"a": rng.normal(size=300), "b": rng.normal(size=300), "c": rng.normal(size=7)}
    rows = spark.createDataFrame([(c, i, float(x)) for c, xs in v.items() for i, x in enumerate(xs)], "condition string, source_id long, v double")
    found = I.resampled_means(rows, ["condition"], 200, 2024, "numpy").collect()
    got = {(r["condition"], r["rep"]): r["m"] for r in found}
    assert len(found) == len(got) == 600
    for c, xs in v.items():
        drawn = np.random.default_rng(2024).integers(0, len(xs), (200, len(xs)))
        assert np.allclose([got[c, k] for k in range(200)], xs[drawn].mean(axis=1), rtol=0, atol=1e-12)
    counts = I._runs(rows.groupBy("condition").agg(F.count("v").alias("n")).select("n"), 200, 2024)
    assert counts.rdd.getNumPartitions() == I.DEALT
    plain = {(r["n"], r["rep"], r["pos"]): r["k"] for r in I.numpy_draws(spark.createDataFrame([(7,)], "n long"), 30).collect()}
    assert plain == {(7, k, p): n for k, row in enumerate(np.random.default_rng(2024).integers(0, 7, (30, 7))) for p, n in zip(*np.unique(row, return_counts=True))}


def test_folds_of_two_numbers_share_one_fit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = []
    for s in range(24):
        x = np.column_stack([B.ranks01(rng.normal(size=60)) for _ in range(2)])
        made.append(P.block(0, s, x, (rng.random(60) < x[:, 0]).astype(float), np.full(60, 1 / 60), 2) | {"g2": s % 2, "g3": s % 3})
    blocks = spark.createDataFrame(made, P.block_schema("int", "long") + ", g2 int, g3 int").repartition(2).cache()
    cell, held, names = learned.crossed((2, 3))
    shared = {(names[r["fold"]], r["series_id"]): r["L_p"] for r in P.fold_losses(blocks.withColumn("g", cell), 2, [P.Probe("p", (0, 1))], held).collect()}
    assert len(shared) == 48
    for k in (2, 3):
        for r in P.fold_losses(blocks.withColumn("g", F.col(f"g{k}")), 2, [P.Probe("p", (0, 1))], P.held_out(list(range(k)))).collect():
            assert shared[(k, r["fold"]), r["series_id"]] == pytest.approx(r["L_p"], abs=1e-9)


def test_curves_are_those_of_plain_windows():
    rng = np.random.default_rng(6)
    view = np.lib.stride_tricks.sliding_window_view
    for x in (rng.normal(size=700), rng.integers(0, 9, 300).astype(float), rng.normal(size=40)):
        for w in (1, 2, 5, 32, 96, 128):
            if len(x) >= w:
                v = view(x, w)
                assert np.array_equal(B.sliding_mad(x, w), np.median(np.abs(v - np.median(v, axis=1)[:, None]), axis=1))
                assert np.array_equal(B.sliding_range(x, w, {}), np.ptp(v, axis=1))
    holed = np.where(np.arange(300) == 200, np.nan, rng.normal(size=300))
    v = view(holed, 32)
    assert np.array_equal(B.sliding_mad(holed, 32), np.median(np.abs(v - np.median(v, axis=1)[:, None]), axis=1), equal_nan=True)
    m = np.column_stack([rng.integers(0, 5, 50).astype(float), rng.normal(size=50), np.where(np.arange(50) % 7, 1.0, np.nan)])
    for j, got in enumerate(B.column_ranks01(m).T):
        _, where, counts = np.unique(m[:, j], return_inverse=True, return_counts=True)
        ends = np.cumsum(counts)
        assert np.array_equal(got, ((ends - counts + 1 + ends) / 2 - 0.5)[where] / 50)


def test_trees_of_each_fold_are_fitted_in_a_task_of_their_own(spark):
    """Dealt by a hash of the fold's number, two folds could meet in one task, and the longest task took twice as long."""
    rng = np.random.default_rng(9)
    made = []
    for s in range(20):
        x = np.column_stack([B.ranks01(rng.normal(size=40)) for _ in range(2)])
        made.append(P.block(s % 10, s, x, (rng.random(40) < x[:, 0]).astype(float), np.full(40, 1 / 40), 2))
    blocks = spark.createDataFrame(made, P.block_schema("long", "long")).repartition(2)
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    found = P.tree_losses(blocks, 2, [P.Probe("p", (0, 1), "trees")], P.held_out(list(range(10))), {**P.TREES, "trees": 2, "least": 10})
    assert {(r["g"], r["fold"]) for r in found.collect()} == {(g, g) for g in range(10)}
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in set(tracker.getJobIdsForGroup()) - before for s in tracker.getJobInfo(j).stageIds]
    assert 10 in {tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)}


def test_a_split_that_leaves_too_few_rows_gives_way_to_the_next(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.random((900, 3))
    y = (x[:, 0] > 0.97).astype(float)  # the best split leaves 27 rows
    model = P.Trees(trees=3, least=100)
    b = model.binned(x)
    model.fit(b, y, np.ones(900))
    for nodes, _ in model.model:
        left = b[nodes[0][0]] <= nodes[0][1]
        assert 100 <= left.sum() <= 800
    every, histogram = [], P.Trees._histogram
    monkeypatch.setattr(P.Trees, "_histogram", lambda self, *a: every.append(len(a) < 5 or a[4]) or histogram(self, *a))
    P.Trees(trees=1, least=1).fit(b, y, np.ones(900))
    assert every and not any(every)  # rows are counted by bin only where the best split is too uneven


def test_many_rows_are_counted_by_two_features_in_blocks(monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.random((2500, 5))
    y, w = (rng.random(2500) < x[:, 0]).astype(float), rng.random(2500)
    plain = P.Trees(trees=2)
    b = plain.binned(x)
    monkeypatch.setattr(P, "WIDE", 2000)
    monkeypatch.setattr(P, "BLOCK", 700)
    coded, rows = plain._coded(b), np.flatnonzero(y > 0)
    assert len(coded[2]) == 3
    for chosen in (rows, slice(None)):
        found = plain._histogram(coded, w, w * w, chosen)
        for f in range(5):
            assert np.array_equal(found[0, f], np.bincount(b[f, chosen], minlength=31))
            assert np.allclose(found[1, f], np.bincount(b[f, chosen], w[chosen], 31)) and np.allclose(found[2, f], np.bincount(b[f, chosen], (w * w)[chosen], 31))


def test_files_larger_than_a_binary_value_are_hashed(spark, tmp_path):
    """Spark refuses content beyond ``maxLength``, 2 GB at most: files are read piece by piece instead."""
    big = bytes(range(256)) * 40_000  # more than one piece
    for name, data in (("a b%20c.bin", big), ("small.bin", b"one"), ("packed.gz", b"not unpacked")):
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = {r["file"]: (r["bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}


def test_windows_of_mad_go_over_batches_and_end_with_their_series(spark):
    """Sorting an array for each point took minutes; windows are sorted by blocks, over batches smaller than a window too."""
    rng = np.random.default_rng(13)
    sizes = {1: 1, 2: 127, 3: 128, 4: 129, 5: 700, 6: 40, 7: 300}
    series = {s: rng.integers(0, 50, n).astype(float) for s, n in sizes.items()}
    rows = [(s, t, float(v), None if s == 7 and t == 150 else float(v)) for s, xs in series.items() for t, v in enumerate(xs)]
    points = spark.createDataFrame(rows, "series_id long, t int, x double, holed double").orderBy("x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        plan = B.with_feature(points, "MAD-128")
        assert "array_sort" not in plan._jdf.queryExecution().executedPlan().toString()
        got = {(r["series_id"], r["t"]): r["MAD-128"] for r in plan.collect()}
        raw = {(r["series_id"], r["t"]): r["MAD-32"] for r in B.with_feature(points, "MAD-32", "holed", filled=False).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(raw) == len(rows)
    for s, xs in series.items():
        assert np.array_equal([got[s, t] for t in range(len(xs))], B.basis_matrix(xs, ("MAD-128",))[:, 0])
    for s, xs in series.items():
        for t in range(len(xs)):
            part = [v for u, v in enumerate(xs[max(0, t - 16) : t + 16], max(0, t - 16)) if not (s == 7 and u == 150)]
            assert raw[s, t] == (np.median(np.abs(part - np.median(part))) if 16 <= t <= len(xs) - 16 else None)


def test_nan_is_the_greatest_value_in_windows_of_mad(spark):
    values = [float(v) for v in np.random.default_rng(14).normal(size=90)]
    values[40] = float("nan")
    got = [r["MAD-32"] for r in B.with_feature(spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "series_id long, t int, x double"), "MAD-32", filled=False).orderBy("t").collect()]
    for t in range(16, 75):
        part = np.sort(values[t - 16 : t + 16])
        far = np.sort(np.abs(part - 0.5 * (part[15] + part[16])))
        assert got[t] == 0.5 * (far[15] + far[16])


def test_passes_over_all_rows_leave_hessians_to_a_sample(spark, monkeypatch):
    rng = np.random.default_rng(15)
    made = []
    for s in range(160):
        x = np.column_stack([B.ranks01(rng.normal(size=100)) for _ in range(2)])
        made.append(P.block(s % 4, s, x, (rng.random(100) < x[:, 0]).astype(float), np.full(100, 1 / 100), 2))
    blocks = spark.createDataFrame(made, P.block_schema("long", "long")).repartition(2).cache()
    probes, folds, passes, joint_pass = [P.Probe("p", (0, 1), "spline")], P.held_out([0, 1, 2, 3]), [], P._joint_pass
    plain = P.fit(blocks, 2, probes, folds)[0]
    monkeypatch.setattr(P, "_joint_pass", lambda width, probes, sent: passes.append(sent.value[2:]) or joint_pass(width, probes, sent))
    monkeypatch.setattr(P, "ENOUGH", 10)
    begun = P.joint_fit(blocks, 2, probes)
    assert (1, False) in passes and (P.START, True) in passes and (P.START, False) not in passes and (1, True) not in passes
    done = len(passes)
    assert np.allclose(P.fit(blocks, 2, probes, folds, begun=begun)[0], plain, atol=1e-6)
    assert len(passes) == done  # a joint solution serves several fits
