"""Negative and positive controls, as scores beside the detectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions.columns import seed64
from scoreloom.operators.basis import column_ranks01

#: Dose-response strengths, and the basis curve that the duplicate control repeats.
ALPHAS = (0.0, 0.25, 0.5, 1.0, 2.0)
DUPLICATE = "Var-96"
#: Fixed value: the least rank correlation of dose and response.
TREND = 0.8


def noise(version: str, series: str, name: str, n: int) -> np.ndarray:
    return np.random.default_rng(seed64(version, series, name)).standard_normal(n)


def control_curves(series: str, y: np.ndarray, version: str, alphas=ALPHAS) -> list[tuple[str, np.ndarray]]:
    """The ranked control scores of one series by name: noise, and noise plus alpha times the label."""
    z = noise(version, series, "complementary_base", len(y))
    names = ["noise", *(f"alpha_{str(a).replace('.', 'p')}" for a in alphas)]
    ranked = column_ranks01(np.column_stack([noise(version, series, "independent_noise", len(y)), *(z + a * y for a in alphas)]))
    return list(zip(names, ranked.T))


def control_scores(points: DataFrame, version: str, alphas=ALPHAS) -> DataFrame:
    """(source_id, series_id, t, y, noise, alpha_<a>...): ranked noise, and ranked noise plus alpha times the label."""
    kinds = dict(points.dtypes)
    names = ["noise", *(f"alpha_{str(a).replace('.', 'p')}" for a in alphas)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        found = control_curves(str(pdf["series_id"].iloc[0]), pdf["y"].to_numpy(float), version, alphas)
        return pdf[["source_id", "series_id", "t", "y"]].assign(**dict(found))

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("source_id", "series_id", "t", "y")), *(f"{c} double" for c in names)])
    return points.select("source_id", "series_id", "t", "y").groupBy("series_id").applyInPandas(run, schema)


def acceptance(series: DataFrame, summary: DataFrame, audit: DataFrame, expected: list[str], resumed: DataFrame, population: DataFrame) -> DataFrame:
    """(check, passed): the gate over a run of controls.

    ``series``: (control, series_id, L_basis, CDU); ``summary``: (control, cdu, ci_low, ci_high); ``audit``: (source_id, passed) of
    each fold; ``expected``: the controls that the run must hold; ``resumed``: the rows of ``series`` of a second run that was
    stopped and resumed; ``population``: (series_id), what each control must hold, from the data and not from the run.
    Complete and sound: every control is there, no fold saw its test source, and a run that starts again gives the same rows.
    Meaning: negative controls cover zero and are not above it, dose and response rise together, the largest dose is above zero.
    Data: one baseline for all controls and both runs, finite losses, each series of the population once in each control.
    """
    alpha = F.regexp_replace(F.regexp_extract("control", r"^alpha_(.*)$", 1), "p", ".").try_cast("double")
    dose = F.col("alpha").isNotNull()
    among = Window.partitionBy(dose)  # a row for each control
    rows = summary.withColumn("alpha", alpha)
    rows = rows.withColumns({"ra": F.rank().over(among.orderBy("alpha")), "rc": F.rank().over(among.orderBy("cdu"))})
    covers = lambda c: F.bool_or(F.when(F.col("control") == c, (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)))
    by_summary = rows.agg(
        (F.size(F.array_intersect(F.collect_set("control"), F.lit(expected))) == len(expected)).alias("controls_complete"),
        covers("duplicate").alias("duplicate_covers_zero"),
        covers("noise").alias("noise_covers_zero"),
        F.bool_and(F.when(F.col("control").isin("duplicate", "noise"), F.col("ci_low") <= 0)).alias("negative_not_positive"),
        (F.max_by("ci_low", "alpha") > 0).alias("largest_positive"),
        (F.corr(F.when(dose, F.col("ra")), F.when(dose, F.col("rc"))) >= TREND).alias("increase"),
    )
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    wanted = population.select("series_id").distinct().crossJoin(F.broadcast(series.select("control").distinct()))  # a row for each control
    counted = series.groupBy("control", "series_id").agg(F.count(F.lit(1)).alias("times"))
    covered = wanted.withColumn("w", F.lit(1)).join(counted, ["control", "series_id"], "full")
    covered = covered.agg((F.count_if(F.col("w").isNull() | ~F.coalesce(F.col("times") == 1, F.lit(False))) == 0).alias("series_once"))
    runs = series.select("series_id", "L_basis").unionByName(resumed.select("series_id", "L_basis"))
    same = runs.groupBy("series_id").agg(F.min("L_basis").eqNullSafe(F.max("L_basis")).alias("same")).agg(F.bool_and("same").alias("one_baseline"))
    finite = series.agg((F.count_if(bad("L_basis") | bad("CDU")) == 0).alias("all_finite"))
    folds = audit.agg(F.bool_and("passed").alias("folds_pass"))
    columns = ["control", "series_id", "L_basis", "CDU"]
    one_way = lambda a, b: a.select(columns).exceptAll(b.select(columns)).agg(F.count(F.lit(1)).alias("n"))
    again = one_way(series, resumed).unionByName(one_way(resumed, series)).agg((F.sum("n") == 0).alias("resumed_equal"))
    one = by_summary.crossJoin(covered).crossJoin(same).crossJoin(finite).crossJoin(folds).crossJoin(again)  # one row each
    checks = [F.struct(F.lit(k).alias("check"), F.coalesce(k, F.lit(False)).alias("passed")) for k in one.columns]
    return one.select(F.explode(F.array(*checks)).alias("r")).select("r.*")
