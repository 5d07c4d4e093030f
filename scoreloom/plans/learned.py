"""Queries on learned probes, reconstruction and their sweeps."""

from __future__ import annotations

import itertools
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import columns as C
from scoreloom.functions.storage import cut, shared_folder
from scoreloom.operators import basis as B
from scoreloom.operators import controls, regression, runs, sampling
from scoreloom.operators import inference as I
from scoreloom.operators import losses as L
from scoreloom.operators import probes as P
from scoreloom.plans import oracle as O
from scoreloom.plans.catalog import query
from scoreloom.plans.evaluation import tidy
from scoreloom.sources import tables as S

#: The reference's whole basis and its cap on a series' training points.
REFERENCE = tuple(B.NAMES)
CAP = 2048
#: The values of C that inner folds choose from, and the numbers of folds over series.
C_GRID = (0.01, 0.1, 1.0, 10.0)
SERIES_FOLDS = (5, 10)
VERSION = "matched-v1"


def weighted(rows: DataFrame) -> DataFrame:
    """``rows`` with w = 1 / (n_g m_s) of the rows at hand."""
    counts = rows.groupBy("source_id", "series_id").agg(F.count(F.lit(1)).alias("m"))
    groups = counts.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_series"))
    small = counts.join(groups, "source_id").select("series_id", (1 / (F.col("n_series") * F.col("m"))).alias("w"))
    return rows.join(small, "series_id")


#: Columns of the blocks: the reference, then the ranked detectors, then what a query asks for.
BASIS = tuple(range(len(REFERENCE)))
DETECTORS = {d: len(REFERENCE) + i for i, d in enumerate(S.DETECTORS)}
EXTRA = len(REFERENCE) + len(DETECTORS)
#: The controls by name, with the basis curve that the duplicate repeats.
CONTROLS = ("noise", *(f"alpha_{str(a).replace('.', 'p')}" for a in controls.ALPHAS))


def _minmax(v):
    return (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.full(len(v), 0.5)


def _zscore_cdf(v):
    z = (v - v.mean()) / v.std() if v.max() > v.min() else np.zeros(len(v))
    return np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])


def series_blocks(spark: SparkSession, sf_dir: str, extra: tuple = (), versions: tuple = (VERSION,), cap: int = CAP, folds: dict | None = None) -> DataFrame:
    """A block for each series, checkpointed: its ranked reference, ranked detectors and ``extra`` columns, all of its points.

    Training weights are 1 / (n_g m_s) on the seeded sample of at most ``cap`` points. With ``folds`` (k: (series_id, k)) they are
    1 / m_s, and column g<k> has the series' fold. Samples of further ``versions`` are w1, w2, ..., null where they are the first.
    """
    points, ks = S.points(spark, sf_dir), tuple(folds or ())
    for k, table in (folds or {}).items():  # numbers travel with the points, which are dealt by series anyway: packed blocks are not shuffled
        points = points.join(table.withColumnRenamed("k", f"g{k}"), "series_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n, s, y = len(pdf), str(pdf["series_id"].iloc[0]), pdf["y"].to_numpy(float)
        raw = B.basis_matrix(pdf["x"].to_numpy())
        columns = [B.column_ranks01(np.column_stack([raw, *(pdf[d].to_numpy(float) for d in S.DETECTORS)]))]
        if "minmax" in extra:
            columns += [_minmax(pdf[d].to_numpy(float)) for d in S.DETECTORS]
        if "zscore_cdf" in extra:
            columns += [_zscore_cdf(pdf[d].to_numpy(float)) for d in S.DETECTORS]
        if "legacy" in extra:
            columns += [_minmax(raw[:, j]) for j in range(raw.shape[1])]
        if "controls" in extra:
            columns += [v for _, v in controls.control_curves(s, y, "controls-v1")]
        samples = []
        for version in versions:
            w, picked = np.zeros(n), sampling.sample_indices(s, n, cap, version)
            w[picked] = 1 / len(picked)
            samples.append(w)
        out = P.block(pdf["source_id"].iloc[0], pdf["series_id"].iloc[0], np.column_stack(columns), y, samples[0], EXTRA)
        out |= {f"w{i}": None if np.array_equal(w, samples[0]) else w.tobytes() for i, w in enumerate(samples) if i}
        return pd.DataFrame([out | {f"g{k}": pdf[f"g{k}"].iloc[0] for k in ks}])

    kinds = dict(points.dtypes)
    schema = [P.block_schema(kinds["source_id"], kinds["series_id"]), *(f"w{i} binary" for i in range(1, len(versions))), *(f"g{k} int" for k in ks)]
    blocks = points.groupBy("series_id").applyInPandas(run, ", ".join(schema))
    if not folds:
        counts = S.series_dim(spark, sf_dir).join(points.select("series_id").distinct(), "series_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("k"))
        blocks = blocks.join(counts, F.col("g") == F.col("source_id")).withColumn("u", 1 / F.col("k")).drop("k", "source_id")
    return cut(blocks)


def width_of(extra: tuple = ()) -> int:
    sizes = {"minmax": len(DETECTORS), "zscore_cdf": len(DETECTORS), "legacy": len(REFERENCE), "controls": len(CONTROLS)}
    return EXTRA + sum(sizes[x] for x in extra)


def sources_of(spark: SparkSession, sf_dir: str) -> list:
    """The sources, sorted: a dimension, a few dozen."""
    rows = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id")).distinct().join(S.series_dim(spark, sf_dir), "series_id")
    return sorted(r[0] for r in rows.select("source_id").distinct().collect())


def matrix(kind: str, detectors=DETECTORS, basis=BASIS, name: str = "") -> list[P.Probe]:
    """The conditions of one probe: the basis, and each detector alone and beside the basis."""
    out = [P.Probe(f"{name}basis", basis, kind)]
    for d, at in detectors.items():
        out += [P.Probe(f"{name}{d}_alone", (at,), kind), P.Probe(f"{name}{d}_joint", (*basis, at), kind)]
    return out


def long_losses(found: DataFrame, names) -> DataFrame:
    """(source_id, series_id, detector, L_basis, L_detector, L_basis_detector, CDU) from a column for each condition."""
    each = [
        F.struct(F.lit(d).alias("detector"), F.col("L_basis").alias("L_basis"), F.col(f"L_{d}_alone").alias("L_detector"), F.col(f"L_{d}_joint").alias("L_basis_detector"))
        for d in names
    ]
    rows = found.select(F.col("g").alias("source_id"), "series_id", F.explode(F.array(*each)).alias("r")).select("source_id", "series_id", "r.*")
    return rows.withColumn("CDU", F.col("L_basis") - F.col("L_basis_detector"))


def probe_losses(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Held-out losses of every condition: trained on the capped sample, tested on every point."""
    blocks, probes, folds = series_blocks(spark, sf_dir), matrix(kind), P.held_out(sources_of(spark, sf_dir))
    scored = P.tree_losses if kind == "trees" else P.fold_losses
    return long_losses(scored(blocks, width_of(), probes, folds), DETECTORS)


@query()
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_losses(spark, sf_dir, "linear")


@query()
def spline_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_losses(spark, sf_dir, "spline")


@query()
def tree_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe_losses(spark, sf_dir, "trees")


@query()
def shared_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basis-only losses by source, one fit for each fold, whatever detectors follow."""
    found = P.fold_losses(series_blocks(spark, sf_dir), width_of(), [P.Probe("basis", BASIS)], P.held_out(sources_of(spark, sf_dir)))
    return found.groupBy(F.col("g").alias("source_id")).agg(F.avg("L_basis").alias("L_basis"))


@query()
def detector_only_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = [P.Probe(d, (at,)) for d, at in DETECTORS.items()]
    found = P.fold_losses(series_blocks(spark, sf_dir), width_of(), probes, P.held_out(sources_of(spark, sf_dir)))
    nulls = L.null_losses(L.series_counts(S.unordered_points(spark, sf_dir))).select("series_id", "L_null")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(f"L_{d}").alias("L_detector")) for d in DETECTORS)))
    rows = found.select(F.col("g").alias("source_id"), "series_id", each.alias("r")).select("source_id", "series_id", "r.*")
    return rows.join(nulls, "series_id").withColumn("detector_utility", F.col("L_null") - F.col("L_detector"))


def sweep(spark: SparkSession, sf_dir: str, bases: dict) -> DataFrame:
    """(setting, detector, L_basis, L_basis_detector, CDU): macro values of each reference in ``bases``, each with its own baseline."""
    probes = []
    for name, columns in bases.items():
        probes.append(P.Probe(f"{name}_basis", columns))
        probes += [P.Probe(f"{name}_{d}", (*columns, at)) for d, at in DETECTORS.items()]
    found = P.fold_losses(series_blocks(spark, sf_dir), width_of(), probes, P.held_out(sources_of(spark, sf_dir)))
    return macro_cdu(found, {(name, d): (f"L_{name}_basis", f"L_{name}_{d}") for name in bases for d in DETECTORS})


def macro_cdu(found: DataFrame, pairs: dict) -> DataFrame:
    """(setting, detector, L_basis, L_basis_detector, CDU): points, then series, then sources averaged."""
    each = [
        F.struct(F.lit(s).alias("setting"), F.lit(d).alias("detector"), F.col(base).alias("L_basis"), F.col(joint).alias("L_basis_detector"))
        for (s, d), (base, joint) in pairs.items()
    ]
    rows = found.select("g", F.explode(F.array(*each)).alias("r")).select("g", "r.*")
    by_source = rows.groupBy("setting", "detector", "g").agg(F.avg("L_basis").alias("L_basis"), F.avg("L_basis_detector").alias("L_basis_detector"))
    macro = by_source.groupBy("setting", "detector").agg(F.avg("L_basis").alias("L_basis"), F.avg("L_basis_detector").alias("L_basis_detector"))
    return macro.withColumn("CDU", F.col("L_basis") - F.col("L_basis_detector"))


@query()
def family_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro losses and CDU with each family of the basis removed, and with none removed (the symmetric-rank run)."""
    every = set(B.FAMILIES.values())
    return sweep(spark, sf_dir, {"none": BASIS} | {f: B.columns_of(every - {B.FAMILIES[f]}) for f in B.FAMILIES})


@query()
def strength_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro losses and CDU against the cumulative references, each with its own baseline, and the whole one."""
    return sweep(spark, sf_dir, {s: B.columns_of(f) for s, f in B.STRENGTHS.items()} | {"all": BASIS})


@query()
def normalisation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro losses and CDU of detectors under other normalisations, against the one baseline of ranked curves."""
    extra, probes, pairs = ("minmax", "zscore_cdf"), [P.Probe("basis", BASIS)], {}
    for k, name in enumerate(("rank", *extra)):
        for i, d in enumerate(DETECTORS):
            probes.append(P.Probe(f"{name}_{d}", (*BASIS, len(BASIS) + k * len(DETECTORS) + i)))
            pairs[name, d] = ("L_basis", f"L_{name}_{d}")
    found = P.fold_losses(series_blocks(spark, sf_dir, extra), width_of(extra), probes, P.held_out(sources_of(spark, sf_dir)))
    return macro_cdu(found, pairs)


@query()
def seed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro losses and CDU for the original training sample and four more seeds."""
    versions = tuple(sampling.replicate_version(VERSION, k) for k in range(5))
    blocks = series_blocks(spark, sf_dir, versions=versions)
    own = blocks.agg(*(F.count(f"w{k}").alias(str(k)) for k in range(1, 5))).first().asDict()  # series that a seed samples in its own way
    probes, held, out, first = [P.Probe("basis", BASIS), *(P.Probe(d, (*BASIS, at)) for d, at in DETECTORS.items())], P.held_out(sources_of(spark, sf_dir)), None, None
    for k in range(5):
        if not k:
            found = first = cut(P.fold_losses(blocks, width_of(), probes, held))
        elif own[str(k)]:
            found = P.fold_losses(blocks.withColumn("w", F.coalesce(f"w{k}", "w")), width_of(), probes, held)
        else:  # the same sample to the last point, so the same fits
            found = first
        one = macro_cdu(found, {(f"replicate={k}", d): ("L_basis", f"L_{d}") for d in DETECTORS})
        out = one if out is None else out.unionByName(one)
    return out


@query()
def nested_c_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regularisation that inner folds over sources choose, for each outer fold: fitted on the capped sample, scored on every point."""
    sources = sources_of(spark, sf_dir)
    folds = [(outer, P.Fold(frozenset([outer, *inner]), frozenset(inner))) for outer in sources for inner in P.grouped_folds([s for s in sources if s != outer])]
    probes = [P.Probe(f"c{i}", BASIS, c=c) for i, c in enumerate(C_GRID)]
    found = P.fold_losses(series_blocks(spark, sf_dir), width_of(), probes, [f for _, f in folds])
    outer = F.get(F.lit([o for o, _ in folds]), F.col("fold"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"L_c{i}").alias("loss")) for i, c in enumerate(C_GRID))))
    rows = found.select(outer.alias("fold"), F.col("g").alias("source_id"), "series_id", each.alias("r"))
    return P.select_c(rows.select("fold", "r.c", "source_id", "series_id", "r.loss"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folds, fold, interface, series_id, L_prior, L_basis): folds over series, for ranked and for min-max curves."""
    series = S.series_dim(spark, sf_dir).join(S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id")), "series_id", "left_semi")
    blocks = series_blocks(spark, sf_dir, ("legacy",), folds={k: sampling.fold_table(series, k) for k in SERIES_FOLDS})
    probes = [P.Probe("symmetric_rank", BASIS), P.Probe("legacy", tuple(range(EXTRA, EXTRA + len(REFERENCE)))), P.Probe("prior", ())]
    cells, held, names = crossed(SERIES_FOLDS)
    found = P.fold_losses(blocks.withColumn("g", cells), width_of(("legacy",)), probes, held)
    folds, fold = (F.get(F.lit([x[i] for x in names]), F.col("fold")) for i in (0, 1))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("interface"), F.col(f"L_{i}").alias("L_basis")) for i in ("symmetric_rank", "legacy"))))
    return found.select(folds.alias("folds"), fold.alias("fold"), "series_id", F.col("L_prior"), each.alias("r")).select("folds", "fold", "r.interface", "series_id", "L_prior", "r.L_basis")


def crossed(numbers: tuple) -> tuple:
    """The cell of a series from its folds g<k> of several ``numbers`` of folds, all folds as sets of cells, and their (k, fold).

    Folds of every number share one fit: a pass serves them all, and the joint solution is found once."""
    every = list(itertools.product(*map(range, numbers)))
    cell = F.lit(0)
    for k in numbers:
        cell = cell * k + F.col(f"g{k}")
    names = [(k, fold) for k in numbers for fold in range(k)]
    return cell, P.held_out([[c for c, at in enumerate(every) if at[numbers.index(k)] == fold] for k, fold in names]), names


@query()
def series_cv_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basis utility under 5 and 10 folds over series, both interfaces: trained on the capped sample, tested on every point."""
    return bridge(spark, sf_dir).withColumn("basis_utility", F.col("L_prior") - F.col("L_basis"))


@query()
def series_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean basis utility of each number of folds and interface, with an interval from resampled series."""
    rows = series_cv_bridge(spark, sf_dir)
    values = rows.select(F.concat_ws("/", F.col("folds").cast("string"), "interface").alias("condition"), F.col("series_id").alias("source_id"), F.col("basis_utility").alias("v"))
    counts = values.groupBy("condition").agg(F.count_if(F.col("v") > 0).alias("positive_series"))
    return I.cluster_bootstrap(values).withColumnRenamed("n_sources", "n_series").join(counts, "condition")


def control_probes() -> list[P.Probe]:
    columns = {"duplicate": REFERENCE.index(controls.DUPLICATE)} | {c: EXTRA + i for i, c in enumerate(CONTROLS)}
    return [P.Probe("basis", BASIS), *(P.Probe(c, (*BASIS, at)) for c, at in columns.items())]


def control_losses(spark: SparkSession, sf_dir: str, blocks: DataFrame | None = None, sources: list | None = None, held: list | None = None, begun: P.Joint | None = None) -> DataFrame:
    """(control, fold, source_id, series_id, L_basis, CDU) of noise, the duplicate and every positive control.

    ``held``: the folds to compute, by their held-out sources (all); ``fold`` is the source that a fold holds out, and
    ``source_id`` where the points came from. ``begun``: the joint solution, if it is known."""
    probes = control_probes()
    blocks = series_blocks(spark, sf_dir, ("controls",)) if blocks is None else blocks
    held = held or sources or sources_of(spark, sf_dir)
    found = P.fold_losses(blocks, width_of(("controls",)), probes, P.held_out(held), begun)
    each = F.explode(F.array(*(F.struct(F.lit(c.name).alias("control"), (F.col("L_basis") - F.col(f"L_{c.name}")).alias("CDU")) for c in probes[1:])))
    rows = found.select(F.get(F.lit(held), F.col("fold")).alias("fold"), F.col("g").alias("source_id"), "series_id", "L_basis", each.alias("r"))
    return rows.select("r.control", "fold", "source_id", "series_id", "L_basis", "r.CDU")


def control_summary(rows: DataFrame) -> DataFrame:
    by_source = rows.groupBy(F.col("control").alias("condition"), "source_id").agg(F.avg("CDU").alias("v"))
    return I.cluster_bootstrap(by_source)


@query()
def control_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDU of noise, the duplicate and every positive control, with bootstrap intervals."""
    return control_summary(control_losses(spark, sf_dir))


@query()
def control_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acceptance gate on a run of all controls, with a second run that stops after a third of its folds and is resumed."""
    blocks, sources = series_blocks(spark, sf_dir, ("controls",)), sources_of(spark, sf_dir)
    begun = P.joint_fit(blocks, width_of(("controls",)), control_probes())  # the folds of each run go on from it
    rows = cut(control_losses(spark, sf_dir, blocks, sources, begun=begun))
    summary = control_summary(rows).select(F.col("condition").alias("control"), F.col("mean").alias("cdu"), "ci_low", "ci_high")
    # a fold passes if what it scored is what it held out, and nothing else
    held = spark.createDataFrame([(s,) for s in sources], "fold long")
    seen = rows.groupBy("fold").agg(F.bool_and(F.col("source_id") == F.col("fold")).alias("own"))
    audit = held.join(seen, "fold", "left").select(F.col("fold").alias("source_id"), F.coalesce("own", F.lit(False)).alias("passed"))
    population = S.series_dim(spark, sf_dir).join(S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id")), "series_id", "left_semi")
    wanted = population.select(F.col("source_id").alias("fold"), "series_id").crossJoin(spark.createDataFrame([(c,) for c in ("duplicate", *CONTROLS)], "control string"))
    wanted = wanted.select("fold", F.concat_ws("/", "control", F.col("series_id").cast("string")).alias("key"))  # a handful of controls
    folder = f"{shared_folder(spark)}/controls-{uuid.uuid4().hex}"
    marked = runs.signature({"version": "controls-v1", "alphas": controls.ALPHAS, "cap": CAP}, {"blocks": blocks.select("series_id", "n", "x", "y", "w")})

    def compute(folds: list) -> DataFrame:
        found = control_losses(spark, sf_dir, blocks, sources, folds, begun)
        return found.withColumn("key", F.concat_ws("/", "control", F.col("series_id").cast("string")))

    third = max(1, len(sources) // 3)
    runs.resume(runs.Run(spark, folder, marked), wanted, "key", compute, most=third, at_once=third)
    again = runs.resume(runs.Run(spark, folder, marked), wanted, "key", compute, at_once=len(sources))
    return controls.acceptance(rows, summary, audit, ["duplicate", *CONTROLS], again, population)


_RIDGE = f"""WITH {O.UNITS}, w AS (SELECT u.*, 1 / (n_series * n) AS w FROM units u JOIN counts USING (source_id, series_id) JOIN per_source USING (source_id)),
s AS (SELECT source_id, sum(w) AS w, sum(w * u) AS wx, sum(w * u_qty) AS wy, sum(w * u * u) AS wxx, sum(w * u * u_qty) AS wxy, count(*) AS k FROM w GROUP BY source_id),
f AS (SELECT a.source_id, sum(b.w) AS w, sum(b.wx) AS wx, sum(b.wy) AS wy, sum(b.wxx) AS wxx, sum(b.wxy) AS wxy, sum(b.k) AS k FROM s a JOIN s b ON a.source_id <> b.source_id GROUP BY a.source_id),
m AS (SELECT source_id, ((wxy - wx * wy / w) * k / w) / ((wxx - wx * wx / w) * k / w + 1) AS slope, w, wx, wy FROM f),
fit AS (SELECT source_id, slope, (wy - slope * wx) / w AS intercept FROM m)"""


@query(_RIDGE + f" SELECT source_id, {O.r('slope', 7)} AS slope, {O.r('intercept', 7)} AS intercept FROM fit")
def ridge_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = regression.simple_ridge(_ridge_rows(spark, sf_dir))
    return fitted.select("source_id", C.rounded("slope", 7).alias("slope"), C.rounded("intercept", 7).alias("intercept"))


def _ridge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = S.unordered_points(spark, sf_dir)
    return weighted(points.select("source_id", "series_id", C.rank01("x", "series_id").alias("u"), C.rank01("qty", "series_id").alias("s")))


@query(_RIDGE + f""", p AS (SELECT u.source_id, u.series_id, u_qty AS s, intercept + slope * u AS p FROM units u JOIN fit USING (source_id))
SELECT source_id, series_id, count(*) AS n_points, {O.r('1 - sum((s - p) * (s - p)) / (count(*) * var_pop(s))')} AS R2, {O.r('avg((s - p) * (s - p))')} AS MSE FROM p GROUP BY ALL""")
def reconstruction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 and MSE of each held-out series."""
    rows = _ridge_rows(spark, sf_dir)
    both = rows.join(regression.simple_ridge(rows), "source_id").withColumn("p", F.col("intercept") + F.col("slope") * F.col("u"))
    return tidy(regression.reconstruction_quality(both, "s", "p", "source_id", "series_id"))


@query(_RIDGE + f""", p AS (SELECT u.source_id, u.series_id, u_qty AS s, intercept + slope * u AS p FROM units u JOIN fit USING (source_id)),
q AS (SELECT source_id, series_id, avg((s - p) * (s - p)) AS MSE FROM p GROUP BY ALL), g AS (SELECT source_id, avg(MSE) AS MSE FROM q GROUP BY source_id)
SELECT {O.r('avg(MSE)')} AS MSE, count(*) AS n_sources FROM g""")
def reconstruction_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ridge_rows(spark, sf_dir)
    both = rows.join(regression.simple_ridge(rows), "source_id").withColumn("p", F.col("intercept") + F.col("slope") * F.col("u"))
    q = regression.reconstruction_quality(both, "s", "p", "source_id", "series_id")
    return tidy(q.groupBy("source_id").agg(F.avg("MSE").alias("MSE")).agg(F.avg("MSE").alias("MSE"), F.count(F.lit(1)).alias("n_sources")))


@query()
def ridge_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector scores predicted from the ranked reference, several targets at once, by held-out source."""
    blocks = series_blocks(spark, sf_dir)
    return regression.block_reconstruction(blocks, width_of(), BASIS, DETECTORS)


@query(f"""WITH {O.POINTS}, u AS (SELECT series_id, 3 * {O.rank01('x')} AS z FROM points)
SELECT series_id, {O.r('avg(CASE WHEN z <= 1 THEN pow(1 - z, 3) / 6 ELSE 0 END)')} AS first,
{O.r('avg(CASE WHEN z < 1 THEN pow(z, 3) / 6 WHEN z < 2 THEN (-3 * pow(z - 1, 3) + 3 * pow(z - 1, 2) + 3 * (z - 1) + 1) / 6 ELSE (3 * pow(z - 2, 3) - 6 * pow(z - 2, 2) + 4) / 6 END)')} AS fourth
FROM u GROUP BY series_id""")
def spline_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of two of the cubic B-splines of each series' ranked curve, by the probe's own recursion."""
    rows = S.unordered_points(spark, sf_dir).select("series_id", C.rank01("x", "series_id").alias("u"))

    def run(frames):
        for f in frames:
            v = P.spline_columns(f["u"].to_numpy(float))
            yield pd.DataFrame({"series_id": f["series_id"], "first": v[:, 0], "fourth": v[:, 3]})

    columns = rows.mapInPandas(run, f"series_id {dict(rows.dtypes)['series_id']}, first double, fourth double")
    return tidy(columns.groupBy("series_id").agg(F.avg("first").alias("first"), F.avg("fourth").alias("fourth")))
