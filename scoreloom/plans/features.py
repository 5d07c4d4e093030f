"""Queries on normalisation, windowed features, sampling and per-series kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions import columns as C
from scoreloom.operators import basis as B
from scoreloom.operators import controls, longseries, metrics, sampling
from scoreloom.plans import oracle as O
from scoreloom.plans.catalog import query
from scoreloom.plans.evaluation import tidy
from scoreloom.sources import tables as S

ORDER = "PARTITION BY series_id ORDER BY t"


@query(f"WITH {O.POINTS} SELECT series_id, t, {O.r(O.rank01('qty'))} AS u FROM points")
def rank_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.points(spark, sf_dir).select("series_id", "t", C.rounded(C.rank01("qty", "series_id")).alias("u"))


@query(f"WITH {O.POINTS} SELECT series_id, t, CASE WHEN max(x) OVER w = min(x) OVER w THEN 0.5 ELSE {O.r('(x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w)')} END AS u FROM points WINDOW w AS (PARTITION BY series_id)")
def minmax_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.points(spark, sf_dir).select("series_id", "t", C.rounded(C.minmax("x", "series_id")).alias("u"))


@query(f"WITH {O.POINTS} SELECT series_id, t, {O.r('(x - avg(x) OVER w) / stddev_pop(x) OVER w', 5)} AS z FROM points WINDOW w AS (PARTITION BY series_id)")
def z_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.points(spark, sf_dir).select("series_id", "t", C.rounded(C.zscore("x", "series_id"), 5).alias("z"))


@query()
def gaussianised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.points(spark, sf_dir).select("series_id", "t", C.zscore_cdf("x", "series_id").alias("p"))


def _window_query(feature: str, value: str, frame: str, width: int) -> str:
    full = f"CASE WHEN count(*) OVER f = {width} THEN {value} END"
    return f"""WITH {O.POINTS}, raw AS (SELECT series_id, t, {full} AS v FROM points WINDOW f AS ({ORDER} ROWS BETWEEN {frame}), o AS ({ORDER})),
filled AS (SELECT series_id, t, coalesce(last_value(v IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(v IGNORE NULLS) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM raw WINDOW b AS ({ORDER}))
SELECT series_id, count(*) AS n, {O.r('avg(sqrt(v))', 3)} AS mean_root, {O.r('max(sqrt(v))', _places(feature))} AS max_root FROM filled GROUP BY series_id"""


def _places(feature: str) -> int:
    """Means of cents over a power of two end within eight decimals, so no rounding falls on a half there."""
    return 8 if B.family_of(feature) == "Last" else 3


def _feature_query(name: str) -> None:
    family, w = name.split("-")[0], int(name.split("-")[1])
    centred = f"{w // 2} PRECEDING AND {w - 1 - w // 2} FOLLOWING"
    sql = {
        "Var": _window_query(name, "var_pop(x) OVER f", centred, w),
        "Range": _window_query(name, "max(x) OVER f - min(x) OVER f", centred, w),
        "Last": _window_query(name, "pow(avg(x) OVER f - x, 2)", f"{w} PRECEDING AND 1 PRECEDING", w),
        "MAD": _window_query(name, "mad(x) OVER f", centred, w),
    }[family]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = B.with_feature(S.points(spark, sf_dir), name)
        return rows.groupBy("series_id").agg(
            F.count(F.lit(1)).alias("n"), C.rounded(F.avg(F.sqrt(name)), 3).alias("mean_root"), C.rounded(F.max(F.sqrt(name)), _places(name)).alias("max_root")
        )

    query(sql, f"basis_{family.lower()}_{w}")(run)


for _name in B.NAMES:
    if B.family_of(_name) in ("Var", "Range", "Last", "MAD"):
        _feature_query(_name)


def _centered_sql(w: int) -> str:
    return f"""WITH {O.POINTS}, e AS (SELECT series_id, t, CASE WHEN count(*) OVER f = {w} THEN pow(avg(x) OVER f - x, 2) END AS e FROM points
WINDOW f AS ({ORDER} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)), raw AS (SELECT series_id, t, lead(e, {w - w // 2}) OVER ({ORDER}) AS v FROM e),
filled AS (SELECT series_id, t, coalesce(last_value(v IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(v IGNORE NULLS) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM raw WINDOW b AS ({ORDER}))
SELECT series_id, {O.r('avg(sqrt(v))', 3)} AS mean_root, {O.r('sum(sqrt(v) * t) / sum(t)', 3)} AS by_place FROM filled GROUP BY series_id"""


def _diff_sql(w: int) -> str:
    same = f"sum(d) OVER ({ORDER} ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING) / {w}"
    return f"""WITH {O.POINTS}, e AS (SELECT series_id, t, abs(x - lag(x) OVER ({ORDER})) AS d FROM points), raw AS (
SELECT series_id, t, CASE WHEN d IS NOT NULL THEN {same if w > 1 else 'd'} END AS v FROM e),
filled AS (SELECT series_id, t, coalesce(v, first_value(v IGNORE NULLS) OVER ({ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM raw)
SELECT series_id, {O.r('avg(v)', 3)} AS mean, {O.r('sum(v * t) / sum(t)', 3)} AS by_place FROM filled GROUP BY series_id"""


def _placed_query(name: str, sql: str, root: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = F.sqrt(name) if root else F.col(name)
        return B.with_feature(S.points(spark, sf_dir), name).groupBy("series_id").agg(
            C.rounded(F.avg(v), 3).alias("mean_root" if root else "mean"), C.rounded(F.sum(v * F.col("t")) / F.sum("t"), 3).alias("by_place")
        )

    query(sql, f"basis_{name.lower().replace('-', '_')}")(run)


for _w in B.WIDTHS["Centered"]:
    _placed_query(f"Centered-{_w}", _centered_sql(_w), True)
for _w in B.WIDTHS["AbsDiff"]:
    _placed_query(f"AbsDiff-{_w}", _diff_sql(_w), False)


@query()
def basis_spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.ranked_basis(S.points(spark, sf_dir), ("SpecEnt-64", "SpecEnt-256"), raw=True)
    return rows.groupBy("series_id").agg(F.avg(F.col("basis")[0]).alias("entropy_64"), F.avg(F.col("basis")[1]).alias("entropy_256"))


@query()
def ranked_basis_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 31 ranked curves: their number and means (always 1/2) for each series."""
    rows = B.ranked_basis(S.points(spark, sf_dir))
    total = F.aggregate("basis", F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("basis")).alias("curves"), F.avg(total / F.size("basis")).alias("mean"))


@query(f"""WITH {O.POINTS}, v AS (SELECT series_id, t, max(x) OVER f - min(x) OVER f AS r, abs(x - lag(x, 1, x) OVER ({ORDER})) AS d FROM points
WINDOW f AS ({ORDER} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)) SELECT series_id, t, {O.r(O.rank01('r'))} AS range_8, {O.r(O.rank01('d'))} AS step FROM v""")
def ranked_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two curves ranked within their series, by window functions alone."""
    order = B.series_window()
    f = B.centred_frame(8, order)
    rows = S.points(spark, sf_dir).select(
        "series_id", "t", (F.max("x").over(f) - F.min("x").over(f)).alias("r"), F.abs(F.col("x") - F.lag("x", 1).over(order)).alias("d")
    ).withColumn("d", F.coalesce("d", F.lit(0.0)))
    return rows.select("series_id", "t", C.rounded(C.rank01("r", "series_id")).alias("range_8"), C.rounded(C.rank01("d", "series_id")).alias("step"))


@query("""WITH p AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events),
raw AS (SELECT *, CASE WHEN count(*) OVER f = 32 THEN max(x) OVER f - min(x) OVER f END AS v FROM p WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING))
SELECT series_id, t, round(coalesce(last_value(v IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(v IGNORE NULLS) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) + 0.0 AS v FROM raw WINDOW b AS (PARTITION BY series_id ORDER BY t)""")
def edge_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature of short series with its edges filled."""
    return B.with_feature(S.event_points(spark, sf_dir), "Range-32").select("series_id", "t", C.rounded("Range-32").alias("v"))


@query(f"""WITH {O.POINTS}, d AS (SELECT series_id, t, x - avg(x) OVER w AS d, count(*) OVER w AS n FROM points WHERE t < 20000 WINDOW w AS (PARTITION BY series_id)),
r AS (SELECT a.series_id, g.lag, sum(a.d * b.d) AS r FROM d a CROSS JOIN (SELECT unnest(range(3, 401)) AS lag) g JOIN d b ON b.series_id = a.series_id AND b.t = a.t + g.lag GROUP BY ALL),
m AS (SELECT series_id, lag, r, lag(r) OVER o AS before, lead(r) OVER o AS behind FROM r WINDOW o AS (PARTITION BY series_id ORDER BY lag)),
best AS (SELECT series_id, arg_max(lag, r) AS lag FROM m WHERE r > before AND r > behind GROUP BY series_id)
SELECT series_id, CAST(CASE WHEN lag BETWEEN 6 AND 300 THEN lag ELSE 125 END AS INTEGER) AS period FROM (SELECT DISTINCT series_id FROM points) LEFT JOIN best USING (series_id)""")
def period_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.series_periods(S.points(spark, sf_dir))


@query()
def volume_under_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each series' estimated period."""
    return metrics.series_vus(S.points(spark, sf_dir), "qty")


@query()
def detector_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row for each series and scorer; the last scorer's sweep goes on from a manifest that holds its even series."""
    points, out = S.points(spark, sf_dir).withColumn("train_cut", F.lit(100)), None
    for d in ("robust_z", "local_variance", "next_point"):
        one = metrics.sweep(points, d)
        if d == "next_point":
            one = metrics.resumed_sweep(points, d, metrics.sweep(points.where("series_id % 2 = 0"), d))
        out = one if out is None else out.unionByName(one)
    return out.select("series_id", "detector", "label_length", "score_length", "finite_ratio", "config_hash", "status", "error", "score_hash")


@query()
def control_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the noise and dose-response control scores by label."""
    rows = controls.control_scores(S.points(spark, sf_dir), "controls-v1")
    return rows.groupBy("series_id", "y").agg(F.avg("noise").alias("noise"), *(F.avg(c).alias(c) for c in rows.columns if c.startswith("alpha_")))


_DUPLICATE = f"""WITH {O.POINTS}, raw AS (SELECT series_id, t, CASE WHEN count(*) OVER f = 96 THEN max(x) OVER f - min(x) OVER f END AS v FROM points WINDOW f AS ({ORDER} ROWS BETWEEN 48 PRECEDING AND 47 FOLLOWING)),
filled AS (SELECT series_id, t, coalesce(last_value(v IGNORE NULLS) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM raw WINDOW b AS ({ORDER}))
SELECT series_id, t, {O.r(O.rank01('v'))} AS score FROM filled"""


@query(_DUPLICATE)
def duplicate_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A control that repeats one ranked basis curve as a score."""
    rows = B.with_feature(S.points(spark, sf_dir), "Range-96").withColumnRenamed("Range-96", "v")
    return rows.select("series_id", "t", C.rounded(C.rank01("v", "series_id")).alias("score"))


@query(_DUPLICATE)
def chunked_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curve by chunks with a halo, and ranks from counts of values: no series stands in one task."""
    rows = longseries.ranked_long(S.points(spark, sf_dir), ("Range-96",), (), 512)
    return rows.select("series_id", "t", C.rounded(F.get("basis", F.lit(0))).alias("score"))



@query(f"""WITH {O.POINTS}, h AS (SELECT series_id, t, md5(concat_ws('|', 'v1', CAST(series_id AS VARCHAR), CAST(t AS VARCHAR))) AS h FROM points)
SELECT series_id, t FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h, t) AS k FROM h) WHERE k <= 128""")
def hash_capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(S.points(spark, sf_dir), 128, "v1").select("series_id", "t")


@query()
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded sample of at most 256 points a series."""
    return sampling.capped_sample(S.points(spark, sf_dir), 256, "matched-v1").select("series_id", "t", "y")


@query()
def seed_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives in the seeded sample of each replicate."""
    points, parts = S.points(spark, sf_dir), None
    for k in range(5):
        rows = sampling.capped_sample(points, 128, sampling.replicate_version("matched-v1", k))
        one = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).withColumn("replicate", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query()
def series_fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled five folds over series."""
    return sampling.fold_table(S.series_dim(spark, sf_dir), 5).withColumnRenamed("k", "fold")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_one(S.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", last=True)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_one(S.table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id")


@query(f"""WITH {O.COUNTS}, k AS (SELECT source_id, series_id, pos / n AS v, rank() OVER (PARTITION BY source_id ORDER BY round(pos / n, 9), series_id) AS family_rank, count(*) OVER (PARTITION BY source_id) AS family_n FROM counts)
SELECT source_id, series_id, {O.r('v')} AS v, family_rank, family_n, family_rank <= ceil(0.2::DOUBLE * family_n) AS hard20, family_rank <= ceil(0.3::DOUBLE * family_n) AS hard30 FROM k""")
def family_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of a series within its source, and the hardest fifth and three tenths."""
    from scoreloom.operators.losses import series_counts

    rows = series_counts(S.unordered_points(spark, sf_dir)).withColumn("v", F.col("pos") / F.col("n"))
    order = Window.partitionBy("source_id").orderBy(F.round("v", 9), "series_id")
    rows = rows.withColumns({"family_rank": F.rank().over(order).cast("long"), "family_n": F.count(F.lit(1)).over(Window.partitionBy("source_id"))})
    hard = lambda share: F.col("family_rank") <= F.ceil(F.lit(share) * F.col("family_n"))
    return tidy(rows.select("source_id", "series_id", "v", "family_rank", "family_n", hard(0.2).alias("hard20"), hard(0.3).alias("hard30")))
