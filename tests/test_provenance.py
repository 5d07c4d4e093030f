"""Contracts that fail, changed bytes, broken score links, and scorers that are not deterministic."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scoreloom.operators import contracts as K
from scoreloom.operators import metrics
from scoreloom.sources import files


def test_each_rule_can_fail(spark):
    tables = {
        "good": spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"),
        "bad": spark.createDataFrame([(1, 1, None), (1, 1, "x"), (2, 9, None), (None, None, "y")], "a int, ref int, v string"),
    }

    def load(name):
        if name not in tables:
            raise AnalysisException("[PATH_NOT_FOUND] no such path")
        return tables[name]

    contracts = [
        K.Contract("good", ("k",), ("v",), 2, (K.Reference(("k",), "good", ("k",)),)),
        K.Contract("bad", ("a",), ("v", "w"), 6, (K.Reference(("ref",), "good", ("k",)), K.Reference(("ref",), "gone", ("k",)))),
        K.Contract("gone", ("k",), ("v",)),
        K.Contract("good", ("z",)),
    ]
    got = {(r["table_name"], r["rule"]): (r["bad"], r["passed"]) for r in K.evaluate(spark, load, contracts).collect()}
    assert all(got["good", r] == (0, True) for r in ("present", "rows>=2", "unique:k", "filled:v", "reference:k->good"))
    assert got["good", "unique:z"] == (None, False)
    assert got["bad", "rows>=6"] == (2, False) and got["bad", "unique:a"] == (1, False) and got["bad", "filled:v"] == (2, False)
    assert got["bad", "filled:w"] == (None, False) and got["bad", "reference:ref->good"] == (1, False) and got["bad", "reference:ref->gone"] == (None, False)
    assert {k: v for k, v in got.items() if k[0] == "gone"} == {("gone", r): (None, False) for r in ("present", "rows>=1", "unique:k", "filled:v")}


def test_empty_table_breaks_only_its_least_rows(spark):
    got = K.evaluate(spark, lambda _: spark.createDataFrame([], "k int, v string"), [K.Contract("t", ("k",), ("v",))]).collect()
    assert {r["rule"]: (r["bad"], r["passed"]) for r in got} == {"present": (0, True), "rows>=1": (1, False), "unique:k": (0, True), "filled:v": (0, True)}


def test_a_changed_byte_shows(spark, tmp_path):
    for name, text in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / name).write_bytes(text)
    audit = spark.createDataFrame([tuple(r) for r in files.file_digests(spark, str(tmp_path)).collect()], "file string, bytes long, sha256 string")
    status = lambda: {r["file"]: r["status"] for r in files.compared(files.file_digests(spark, str(tmp_path)), audit, "file").collect()}
    assert status() == dict.fromkeys(("a.bin", "b.bin", "c.bin"), "SAME")
    (tmp_path / "a.bin").write_bytes(b"onE")
    (tmp_path / "b.bin").unlink()
    (tmp_path / "d.bin").write_bytes(b"new")
    assert status() == {"a.bin": "CHANGED", "b.bin": "MISSING", "c.bin": "SAME", "d.bin": "UNKNOWN"}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, float(rng.normal()), 50) for s in range(6) for t in range(200)]
    return spark.createDataFrame(rows, "series_id long, t int, x double, train_cut int").cache()


def test_scores_are_linked_to_their_hashes(spark, points):
    made = metrics.sweep(points, "robust_z").cache()
    assert all(r["linked"] and r["n_points"] == 200 for r in metrics.linked(made, made).collect())
    moved = made.withColumn("scores", F.when(F.col("series_id") == 3, F.transform("scores", lambda v, i: v + (i == 7).cast("double") * 1e-15)).otherwise(F.col("scores")))
    got = {r["series_id"]: r["linked"] for r in metrics.linked(moved.where("series_id <> 5"), made).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False}


def test_unseeded_and_remembering_scorers_are_caught(spark, points):
    metrics.register("unseeded", lambda train, test, config, seed: np.random.default_rng().normal(size=len(test)))
    metrics.register("seeded", lambda train, test, config, seed: np.random.default_rng(seed).normal(size=len(test)))
    calls = itertools.count()
    metrics.register("remembers", lambda train, test, config, seed: test + next(calls))
    assert {r["status"] for r in metrics.rerun(points, "unseeded").collect()} == {"FAIL"}
    assert {r["status"] for r in metrics.rerun(points, "seeded").collect()} == {"PASS"}
    assert "FAIL" in {r["status"] for r in metrics.rerun(points, "remembers").collect()}


def test_sweeps_resume_and_retry(spark, points):
    def fails(train, test, config, seed):
        if test[0] > np.float64(config.get("most", -9)):
            raise ValueError("too much")
        return test

    metrics.register("fails", fails)
    first = metrics.sweep(points.where("series_id < 4"), "fails", {"most": 0}).cache()
    told = {r["series_id"]: r["status"] for r in first.collect()}
    assert set(told.values()) == {"PASS", "FAIL"}
    kept = {r["series_id"]: r for r in metrics.resumed_sweep(points, "fails", first, config={"most": 9}).collect()}
    assert len(kept) == 6 and {s: kept[s]["status"] for s in told} == told and {kept[4]["status"], kept[5]["status"]} == {"PASS"}
    again = metrics.resumed_sweep(points, "fails", first, retry_failed=True, config={"most": 9}).collect()
    assert {r["status"] for r in again} == {"PASS"} and len(again) == 6
    assert len({r["config_hash"] for r in again}) == 2 and all(r["score_length"] == 200 and r["finite_ratio"] == 1 for r in again)
