"""Operators against plain numpy, and the properties that hold for any input."""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.functions import columns as C
from scoreloom.operators import basis as B
from scoreloom.operators import controls, metrics, probes, regression, sampling
from scoreloom.operators import inference as I
from scoreloom.operators import losses as L
from scoreloom.sources import files


@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_ranks_lie_inside_and_average_half(values):
    u = B.ranks01(np.array(values, float))
    assert (u > 0).all() and (u < 1).all() and u.mean() == pytest.approx(0.5)


def test_constant_curve_is_half(spark):
    df = spark.createDataFrame([(1, 3.0)] * 4, "series_id int, x double")
    got = df.select(C.rank01("x", "series_id").alias("r"), C.minmax("x", "series_id").alias("m"), C.zscore_cdf("x", "series_id").alias("z")).distinct().collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5, 0.5)]


def test_window_features_equal_kernel(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, float(v)) for s in (1, 2) for t, v in enumerate(rng.normal(size=90).round(2))]
    df = spark.createDataFrame(rows, "series_id int, t int, x double")
    for name in ("Var-8", "Range-16", "Last-3", "Centered-16", "AbsDiff-1", "AbsDiff-4", "MAD-32", "Var-96"):
        got = {(r["series_id"], r["t"]): r[name] for r in B.with_feature(df, name).collect()}
        for s in (1, 2):
            want = B.basis_matrix(np.array([x for k, _, x in rows if k == s]), (name,))[:, 0]
            np.testing.assert_allclose([got[s, t] for t in range(90)], want, atol=1e-9, err_msg=name)


def test_spectral_entropy_of_a_constant_is_zero():
    assert not B.basis_matrix(np.ones(300), ("SpecEnt-64",)).any()


def test_weights_share_equally(spark):
    rows = [("A", 1, 2), ("A", 2, 6), ("B", 3, 4)]
    w = L.hierarchical_weights(spark.createDataFrame(rows, "source_id string, series_id int, n int"))
    by = {r["source_id"]: r["s"] for r in w.groupBy("source_id").agg(F.sum(F.col("w") * F.col("n")).alias("s")).collect()}
    assert by == {"A": pytest.approx(6), "B": pytest.approx(6)}


def test_prior_by_subtraction_equals_recomputation(spark):
    rng = np.random.default_rng(1)
    rows = [(g, 10 * g + s, 20, int(rng.integers(0, 20))) for g in range(5) for s in range(3)]
    got = {r["source_id"]: r["prior"] for r in L.loso_prior(spark.createDataFrame(rows, "source_id int, series_id int, n int, pos int")).collect()}
    for g in range(5):
        other = [np.mean([p / n for h, _, n, p in rows if h == k]) for k in range(5) if k != g]
        assert got[g] == pytest.approx(np.mean(other))


def test_holm_against_definition(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = {r["i"]: r["holm"] for r in I.holm(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    order, running = np.argsort(p), 0.0
    for k, i in enumerate(order):
        running = max(running, p[i] * (len(p) - k))
        assert got[i] == pytest.approx(min(1, running))


def test_sample_is_stable_unique_and_whole_without_cap():
    a, b = (sampling.sample_indices("s1", 9000, 2048, "v") for _ in range(2))
    assert (a == b).all() and len(set(a)) == 2048 and (np.diff(a) > 0).all()
    assert (sampling.sample_indices("s1", 5, 0, "v") == np.arange(5)).all()
    assert sampling.replicate_version("v", 2) != sampling.replicate_version("v", 0) == "v"


def test_seed_column_equals_python(spark):
    got = spark.createDataFrame([("v|a",), ("v|b",)], "k string").select("k", C.seed64_column(F.col("k")).alias("s")).collect()
    assert {r["k"]: int(r["s"]) for r in got} == {k: C.seed64(*k.split("|")) for k in ("v|a", "v|b")}


def _probe_rows(spark, n=400, signal=2.0):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(4):
        for s in range(2):
            y = rng.integers(0, 2, n // 8)
            x = np.clip(rng.random((n // 8, 2)) * 0.5 + signal * 0.2 * y[:, None], 0, 1)
            rows += [(g, 10 * g + s, int(a), [float(v) for v in b], 1 / (2 * (n // 8))) for a, b in zip(y, x)]
    return rows, spark.createDataFrame(rows, "source_id int, series_id int, y int, x array<double>, w double")


@pytest.mark.parametrize("kind", ["linear", "spline"])
def test_newton_reaches_the_optimum_of_each_fold(spark, kind):
    rows, df = _probe_rows(spark)
    fitted = probes.fit_loso(df, [0, 1, 2, 3], 2, kind)
    for fold in range(4):
        part = [r for r in rows if r[0] != fold]
        z, y = probes.design(np.array([r[3] for r in part]), kind), np.array([r[2] for r in part])
        w = np.array([r[4] for r in part])
        w *= len(w) / w.sum()
        b = fitted[fold, probes.C]
        gradient = z.T @ (w * (probes.sigmoid(z @ b) - y)) + b / probes.C
        assert np.abs(gradient).max() < 1e-5


def test_probes_gain_on_a_signal(spark):
    _, df = _probe_rows(spark)
    nulls = 1.0
    linear = probes.mean_losses(probes.predict_loso(df, [0, 1, 2, 3], probes.fit_loso(df, [0, 1, 2, 3], 2), 2), "l").agg(F.avg("l")).first()[0]
    blocks, folds = probes.blocks_of(df), probes.held_out([0, 1, 2, 3])
    trees = probes.tree_losses(blocks, 2, [probes.Probe("l", (0, 1))], folds, probes.TREES | {"least": 10}).agg(F.avg("L_l")).first()[0]
    direct = probes.fold_losses(blocks, 2, [probes.Probe("l", (0, 1))], folds).agg(F.avg("L_l")).first()[0]
    assert direct == pytest.approx(linear, abs=1e-7)
    assert linear < nulls - 0.1 and trees < nulls - 0.1


def test_spline_columns_sum_to_one_less_the_last():
    u = np.linspace(0, 1, 7)
    full = probes.spline_columns(u)
    assert full.shape == (7, 5) and (full.sum(axis=1) <= 1 + 1e-12).all() and full.sum(axis=1)[0] == pytest.approx(1)
    assert np.allclose(probes.spline_columns(np.array([-1.0, 2.0])), full[[0, -1]])


def test_ridge_folds_equal_closed_form(spark):
    rng = np.random.default_rng(4)
    rows = [(g, 10 * g, float(w), float(x), float(2 * x + rng.normal() * 0.1)) for g in range(3) for w, x in zip(rng.random(40) + 0.5, rng.random(40))]
    df = spark.createDataFrame(rows, "source_id int, series_id int, w double, u double, s double")
    one = {r["source_id"]: (r["slope"], r["intercept"]) for r in regression.simple_ridge(df).collect()}
    many = regression.ridge_folds(df.select("source_id", "w", F.array("u").alias("x"), F.array("s").alias("s")), 1, 1).collect()
    for r in many:
        assert (r["coef"][0], r["intercept"][0]) == pytest.approx(one[r["source_id"]])


def test_controls_are_seeded_and_ranked(spark):
    df = spark.createDataFrame([(1, 7, t, t % 2) for t in range(50)], "source_id int, series_id int, t int, y int")
    a = controls.control_scores(df, "v").orderBy("t").toPandas()
    assert a.equals(controls.control_scores(df, "v").orderBy("t").toPandas())
    assert a["noise"].between(0, 1).all() and a.groupby("y")["alpha_2p0"].mean().diff().iloc[-1] > 0.2


def test_period_and_fallbacks():
    assert metrics.period(np.sin(np.arange(2000) * 2 * np.pi / 25)) == 25
    assert metrics.period(np.ones(100)) == metrics.FALLBACK
    assert metrics.period(np.arange(5.0), 0) == 1


def test_vus_orders_good_and_bad_scores():
    y = np.zeros(300, int)
    y[100:110] = 1
    assert metrics.vus_pr(y, y + 0.01 * np.arange(300) / 300, 10) > metrics.vus_pr(y, np.arange(300.0), 10)
    assert metrics.vus_pr(y, np.ones(300), 10) == 0.0


def test_a_failing_scorer_is_a_row(spark):
    metrics.register("broken", lambda train, test, config, seed: np.full(len(test), np.nan))
    df = spark.createDataFrame([(1, t, float(t), 3) for t in range(10)], "series_id int, t int, x double, cut int")
    r = metrics.sweep(df, "broken", train="cut").first()
    assert r["status"] == "FAIL" and "not finite" in r["error"]


def test_file_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"series_to_source": {"a": "A", "b": "B"}, "n_series": 2, "unresolved_series": []}')
    assert files.read_source_map(spark, str(tmp_path / "m.json")).count() == 2
    np.savez(tmp_path / "b.npz", basis=np.arange(6, dtype=np.float32).reshape(2, 3), label=np.array([0, 1]))
    got = {r["name"]: (r["shape"], r["values"]) for r in files.read_arrays(spark, str(tmp_path)).collect()}
    assert got["basis"][0] == [2, 3] and got["label"][1] == [0.0, 1.0]
    content = spark.createDataFrame([([1.0, 2.5],)], "v array<double>").select(files.npy_bytes("v").alias("b")).first()["b"]
    assert np.load(io.BytesIO(bytes(content))).tolist() == [1.0, 2.5]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "s.csv").write_text("v,Label\n1,0\n,0\n2.5,1\n")
    assert [tuple(r) for r in files.read_series_csv(spark, str(tmp_path / "raw"), "v").orderBy("t").select("t", "x", "y").collect()] == [(0, 1.0, 0), (1, 2.5, 1)]
    df = spark.createDataFrame([("a_b", 0.5)], "k string, v double")
    assert files.markdown(df, 2).splitlines()[-1] == "| a_b | 0.50 |" and "a-b & 0.50" in files.latex(df, 2)


def test_array_hash(spark):
    want = hashlib.sha256(np.array([1.0, 2.0], "<f8").tobytes()).hexdigest()
    assert spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(C.array_sha256("v").alias("h")).first()["h"] == want


def test_series_folds_balance():
    folds = pd.Series(dict(sampling.series_folds(list(range(23)), 5)))
    assert folds.value_counts().max() - folds.value_counts().min() <= 1
    with pytest.raises(ValueError):
        probes.grouped_folds([1, 2], 5)


def test_learned_queries_are_the_whole_job():
    from scoreloom.operators import basis, controls
    from scoreloom.plans import learned

    assert learned.REFERENCE == basis.NAMES and len(learned.REFERENCE) == 31 and learned.CAP == 2048
    assert learned.C_GRID == (0.01, 0.1, 1.0, 10.0) and learned.SERIES_FOLDS == (5, 10)
    assert controls.DUPLICATE in learned.REFERENCE
