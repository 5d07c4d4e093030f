"""Runs that stop and resume, their refusals, and bootstrap draws cut into runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import controls, inference, runs

WANTED = [(f, f"s{f}_{i}") for f in range(6) for i in range(4)]


@pytest.fixture()
def wanted(spark):
    return spark.createDataFrame(WANTED, "fold long, series_id string")


def computed(spark, calls):
    def compute(folds):
        calls.append(list(folds))
        return spark.createDataFrame([(f, s, f + len(s) / 7) for f, s in WANTED if f in folds], "fold long, series_id string, loss double")

    return compute


def values(df):
    return sorted(map(tuple, df.select("fold", "series_id", "loss").collect()))


def test_a_stopped_run_resumes_with_the_others_alone(spark, wanted, tmp_path):
    calls: list = []
    first = runs.resume(runs.Run(spark, str(tmp_path), "a"), wanted, "series_id", computed(spark, calls), most=2)
    assert calls == [[0], [1]] and len(values(first)) == 8
    again = runs.Run(spark, str(tmp_path), "a")
    assert not again.complete(wanted, "series_id")
    whole = runs.resume(again, wanted, "series_id", computed(spark, calls), at_once=3)
    assert calls[2:] == [[2, 3, 4], [5]] and again.complete(wanted, "series_id")
    direct = runs.resume(runs.Run(spark, str(tmp_path / "direct"), "a"), wanted, "series_id", computed(spark, []), at_once=6)
    assert values(whole) == values(direct) and len(values(whole)) == len(WANTED)
    assert runs.resume(again, wanted, "series_id", computed(spark, calls)) is not None and len(calls) == 4


def test_files_without_a_manifest_line_are_not_done(spark, wanted, tmp_path):
    run, calls = runs.Run(spark, str(tmp_path), "a"), []
    runs.resume(run, wanted, "series_id", computed(spark, calls), most=1)
    spark.createDataFrame([(1, "half", 0.0)], "fold long, series_id string, loss double").write.mode("append").partitionBy("fold").parquet(f"{tmp_path}/folds")
    assert {r[0] for r in run.rows().select("fold").collect()} == {0}
    whole = runs.resume(runs.Run(spark, str(tmp_path), "a"), wanted, "series_id", computed(spark, calls), at_once=9)
    assert "half" not in {r["series_id"] for r in whole.collect()} and whole.count() == len(WANTED)


def test_refusals(spark, wanted, tmp_path):
    run = runs.Run(spark, str(tmp_path), "a")
    runs.resume(run, wanted, "series_id", computed(spark, []), most=2)
    with pytest.raises(ValueError, match="another signature"):
        runs.Run(spark, str(tmp_path), "b")
    with pytest.raises(ValueError, match="not valid"):  # another population
        runs.resume(run, wanted.where("series_id <> 's1_2'"), "series_id", computed(spark, []))
    spark.createDataFrame([(0, "s0_9", 1.0)], "fold long, series_id string, loss double").write.mode("append").partitionBy("fold").parquet(f"{tmp_path}/folds")
    checks = {r["fold"]: r for r in run.checked(wanted, "series_id").collect()}
    assert checks["0"]["published"] and not checks["0"]["same_digest"] and not checks["0"]["same_keys"] and checks["1"]["same_digest"]
    with pytest.raises(ValueError, match="fold 0"):
        run.require(wanted, "series_id")


def test_a_fold_that_is_not_finite_is_refused(spark, wanted, tmp_path):
    run = runs.Run(spark, str(tmp_path), "a")
    with pytest.raises(ValueError, match="not valid"):
        runs.resume(run, wanted, "series_id", lambda folds: computed(spark, [])(folds).withColumn("loss", F.lit(float("nan"))), most=1)
    assert not run.complete(wanted, "series_id")


def test_signatures_follow_settings_and_rows(spark):
    df = spark.range(50).withColumn("x", F.col("id") / 3)
    one = runs.signature({"a": 1}, {"t": df})
    assert one == runs.signature({"a": 1}, {"t": df.repartition(7).select("x", "id")})
    assert one != runs.signature({"a": 2}, {"t": df}) and one != runs.signature({"a": 1}, {"t": df.where("id <> 7")})
    assert one != runs.signature({"a": 1}, {"t": df.union(df.limit(1))}) and runs.table_digest(df.limit(0)) == "0:0:0"


def gate(spark, **change):
    names, series = ["duplicate", "noise", "alpha_0p5", "alpha_2p0"], [(s, f"s{s}{i}") for s in range(3) for i in range(2)]
    rows = [(c, s, x, 0.5, 0.1 * k) for k, c in enumerate(names) for s, x in series]
    fields = "control string, source_id long, series_id string, L_basis double, CDU double"
    at = {
        "series": rows, "resumed": rows, "summary": [("duplicate", 0.0, -1.0, 1.0), ("noise", 0.0, -1.0, 1.0), ("alpha_0p5", 0.2, 0.1, 0.3), ("alpha_2p0", 0.4, 0.3, 0.5)],
        "audit": [(s, True) for s in range(3)], "population": [(x,) for _, x in series],
    } | change
    df = lambda k, schema: spark.createDataFrame(at[k], schema)
    got = controls.acceptance(
        df("series", fields), df("summary", "control string, cdu double, ci_low double, ci_high double"), df("audit", "source_id long, passed boolean"),
        names, df("resumed", fields), df("population", "series_id string"),
    )
    return {r["check"] for r in got.collect() if not r["passed"]}


def test_every_check_of_the_gate_can_fail(spark):
    assert gate(spark) == set()
    rows = [("duplicate", 0, "s00", 0.5, 0.0)]
    names = ["duplicate", "noise", "alpha_0p5", "alpha_2p0"]
    whole = [(c, s, f"s{s}{i}", 0.5, 0.1 * k) for k, c in enumerate(names) for s in range(3) for i in range(2)]
    assert gate(spark, series=whole + rows) == {"series_once", "resumed_equal"}
    assert gate(spark, series=whole[1:], resumed=whole[1:]) == {"series_once"}
    assert gate(spark, resumed=whole[1:]) == {"resumed_equal"} == gate(spark, series=whole, resumed=[*whole[1:], (*whole[0][:4], 9.0)])
    assert gate(spark, resumed=[(c, s, x, 0.6, v) for c, s, x, _, v in whole]) == {"one_baseline", "resumed_equal"}
    assert gate(spark, series=[(c, s, x, b, float("nan")) for c, s, x, b, _ in whole], resumed=[(c, s, x, b, float("nan")) for c, s, x, b, _ in whole]) == {"all_finite"}
    assert gate(spark, audit=[(0, True), (1, False)]) == {"folds_pass"}
    low = [("duplicate", 0.0, -1.0, 1.0), ("noise", 0.5, 0.1, 1.0), ("alpha_0p5", 0.2, 0.1, 0.3), ("alpha_2p0", 0.1, -0.3, 0.5)]
    assert gate(spark, summary=low) == {"noise_covers_zero", "negative_not_positive", "largest_positive", "increase"}
    assert "controls_complete" in gate(spark, summary=low[1:]) and "duplicate_covers_zero" in gate(spark, summary=low[1:])


@pytest.mark.parametrize("reps", [1, 7, 1000])
def test_draws_are_one_stream_however_it_is_cut(spark, monkeypatch, reps):
    monkeypatch.setattr(inference, "RUN_REPS", reps)
    sizes, draws = spark.createDataFrame([(5,), (23,)], "n long"), 30
    got = inference.numpy_draws(sizes, draws, 2024).toPandas()
    for n in (5, 23):
        one = got[got.n == n]
        counts = np.zeros((draws, n), int)
        counts[one.rep, one.pos] = one.k
        drawn = np.random.default_rng(2024).integers(0, n, (draws, n))
        assert (counts == np.array([np.bincount(r, minlength=n) for r in drawn])).all()


@pytest.mark.parametrize("drawn", ["numpy", "hash"])
def test_means_are_of_n_draws_each(spark, drawn):
    rng = np.random.default_rng(1)
    rows = [("f", c, s, float(rng.normal())) for c in ("a", "b") for s in range(40)]
    df = spark.createDataFrame(rows, "family string, condition string, source_id long, v double")
    counts = inference.DRAWN[drawn](df.groupBy("condition").agg(F.count("v").alias("n")), 200).groupBy("rep").agg(F.sum("k").alias("k")).collect()
    assert len(counts) == 200 and {r["k"] for r in counts} == {40}
    wide = inference.simultaneous_intervals(df, draws=2000, drawn=drawn).collect()
    for r in wide:
        v = np.array([x[3] for x in rows if x[1] == r["condition"]])
        se = v.std(ddof=1) / np.sqrt(40)
        assert r["mean"] == pytest.approx(v.mean()) and r["se"] == pytest.approx(se) and 1.8 < r["q"] < 2.9
        assert r["ci_low"] == pytest.approx(v.mean() - 1.96 * se, abs=0.2 * se) and r["positive"] == (v > 0).sum()
    with pytest.raises(Exception, match="lacks a source"):
        inference.simultaneous_intervals(df.where("not (condition = 'a' and source_id = 3)"), draws=10, drawn=drawn).collect()
