"""Queries on weights, losses, aggregates and inference."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions import columns as C
from scoreloom.functions.storage import cut, shared_folder
from scoreloom.operators import inference as I
from scoreloom.operators import losses as L
from scoreloom.operators import runs as R
from scoreloom.plans import oracle as O
from scoreloom.plans.catalog import query
from scoreloom.sources import tables as S

DETECTORS = list(S.DETECTORS)
VALUES = (*L.LOSSES, *L.UTILITIES)


def losses(spark: SparkSession, sf_dir: str, detectors: list[str] | None = None) -> DataFrame:
    return L.four_losses(S.unordered_points(spark, sf_dir), detectors or DETECTORS)


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.source_aggregate(losses(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.summary_aggregate(by_source(spark, sf_dir))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, condition, source_id, v): CDU of each detector and source."""
    return by_source(spark, sf_dir).select(F.lit("all").alias("family"), F.col("detector").alias("condition"), "source_id", F.col("CDU").alias("v"))


def tidy(df: DataFrame, *exact: str) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*(C.rounded(c) .alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


@query(f"WITH {O.NULLS} SELECT source_id, count(*) AS n_series, {O.r('avg(L_null)')} AS L_null FROM nulls GROUP BY source_id")
def null_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the leave-one-source-out prior, by source."""
    rows = L.null_losses(L.series_counts(S.unordered_points(spark, sf_dir)))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_series"), C.rounded(F.avg("L_null")).alias("L_null"))


@query(f"""WITH {O.COUNTS}, whole AS (SELECT sum(source_points) AS total, count(*) AS g FROM per_source)
SELECT series_id, source_id, n AS m, {O.r('total / (g * n_series * n)')} AS w FROM counts JOIN per_source USING (source_id), whole""")
def hierarchical_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.hierarchical_weights(L.series_counts(S.unordered_points(spark, sf_dir)))
    return rows.select("series_id", "source_id", F.col("n").alias("m"), C.rounded("w").alias("w"))


@query(f"WITH {O.COUNTS} SELECT series_id, {O.r('(SELECT sum(n) FROM counts) / ((SELECT count(*) FROM counts) * n)')} AS w FROM counts")
def series_equal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.series_equal_weights(L.series_counts(S.unordered_points(spark, sf_dir)))
    return rows.select("series_id", C.rounded("w").alias("w"))


@query(f"WITH {O.COUNTS} SELECT source_id, {O.r('prior', 9)} AS prior FROM prior")
def training_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.loso_prior(L.series_counts(S.unordered_points(spark, sf_dir)))
    return rows.select("source_id", C.rounded("prior", 9).alias("prior"))


@query(f"WITH {O.NULLS}, s AS (SELECT source_id, avg(L_null) AS m FROM nulls GROUP BY source_id) SELECT {O.r('avg(m)')} AS L_null FROM s")
def macro_null_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.macro_loss(L.null_losses(L.series_counts(S.unordered_points(spark, sf_dir)))))


@query(f"WITH {O.UNITS} SELECT source_id, series_id, {O.r('avg(' + O.loss('u_qty', 'y', '1') + ')')} AS loss FROM units GROUP BY ALL")
def pointwise_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss of a score's rank taken as a probability."""
    points = S.unordered_points(spark, sf_dir).select("source_id", "series_id", "y", C.rank01("qty", "series_id").alias("u"))
    return tidy(L.probability_loss(points, F.col("u")))


_ALL = ", ".join(f"{O.r(c)} AS {c}" for c in VALUES)


@query(f"WITH {O.LOSSES} SELECT detector, series_id, source_id, n_points, n_anomalies, {_ALL} FROM losses")
def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(losses(spark, sf_dir))


@query(f"WITH {O.BY_SOURCE} SELECT detector, source_id, {_ALL}, n_series FROM by_source")
def loss_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(by_source(spark, sf_dir))


@query(f"WITH {O.SUMMARY} SELECT detector, {_ALL}, {O.r('positive_source_fraction')} AS positive_source_fraction, positive_sources, n_sources, n_series FROM summary")
def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(summary(spark, sf_dir))


@query(f"WITH {O.LOSSES} SELECT detector, count(*) FILTER (CDU > 0) AS positive, {O.r('avg(CASE WHEN CDU > 0 THEN 1.0 ELSE 0.0 END)')} AS fraction FROM losses GROUP BY detector")
def positive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses(spark, sf_dir).groupBy("detector").agg(
        F.count_if(F.col("CDU") > 0).alias("positive"), C.rounded(F.avg((F.col("CDU") > 0).cast("double"))).alias("fraction")
    )


_CDU = "SELECT 'all' AS family, detector AS condition, source_id, CDU AS v FROM by_source"
_PAIRS = """SELECT 'pairs' AS family, a.detector || '-' || b.detector AS condition, a.source_id, a.CDU - b.CDU AS v FROM by_source a JOIN by_source b USING (source_id)
WHERE (a.detector, b.detector) IN (('qty', 'disc'), ('qty', 'tax'), ('disc', 'tax'))"""
PAIRS = [("qty", "disc"), ("qty", "tax"), ("disc", "tax")]
_BOOTSTRAP = f"""SELECT condition, {O.r('any_value(mean)')} AS mean, {O.interval()}, {O.r('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS p_positive,
any_value(n) AS n_sources FROM boot JOIN stats USING (family, condition) GROUP BY condition"""


@query(f"WITH {O.BY_SOURCE}, {O.boot(_CDU, I.DRAWS)} {_BOOTSTRAP}")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(I.cluster_bootstrap(conditions(spark, sf_dir), drawn="hash"))


_METRICS = """SELECT 'all' AS family, detector || '/' || metric AS condition, source_id, v FROM (
SELECT detector, source_id, CDU, basis_utility, detector_utility FROM by_source) UNPIVOT (v FOR metric IN (CDU, basis_utility, detector_utility))"""


@query(f"""WITH {O.BY_SOURCE}, {O.boot(_METRICS, I.DRAWS)}, b AS ({_BOOTSTRAP}) SELECT b.*, positive, n_series
FROM b JOIN stats USING (condition) JOIN (SELECT detector, CAST(sum(n_series) AS BIGINT) AS n_series FROM by_source GROUP BY detector) n ON starts_with(condition, detector || '/')""")
def interval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each detector's CDU and utilities: mean, interval, P(mean > 0), positive sources, and what it covers."""
    rows = cut(by_source(spark, sf_dir).select("detector", "source_id", "n_series", "CDU", "basis_utility", "detector_utility"))
    long = rows.unpivot(["detector", "source_id", "n_series"], ["CDU", "basis_utility", "detector_utility"], "metric", "v")
    long = long.withColumn("condition", F.concat_ws("/", "detector", "metric"))
    counts = long.groupBy("condition").agg(F.count_if(F.col("v") > 0).alias("positive"), F.sum("n_series").alias("n_series"))
    return tidy(I.cluster_bootstrap(long, drawn="hash").join(counts, "condition"))


@query(f"WITH {O.BY_SOURCE}, {O.boot(_PAIRS, I.FAMILY_DRAWS)} {_BOOTSTRAP}")
def contrast_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of paired contrasts, all on the same draws."""
    rows = I.paired_contrasts(conditions(spark, sf_dir), PAIRS)
    return tidy(I.cluster_bootstrap_family(rows, drawn="hash"))


@query(f"WITH {O.BY_SOURCE}, {O.boot(_CDU, I.FAMILY_DRAWS)}{O.simultaneous()}")
def simultaneous_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(I.simultaneous_intervals(conditions(spark, sf_dir), drawn="hash"))


@query(f"WITH {O.BY_SOURCE}, {O.boot(_PAIRS, I.FAMILY_DRAWS)}{O.simultaneous()}")
def paired_contrast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.paired_contrasts(conditions(spark, sf_dir), PAIRS)
    rows = rows.select(F.lit("pairs").alias("family"), F.concat_ws("-", "a", "b").alias("condition"), "source_id", "v")
    return tidy(I.simultaneous_intervals(rows, drawn="hash"))


@query(f"WITH {O.BY_SOURCE} SELECT a.detector AS a, b.detector AS b, a.source_id, {O.r('a.CDU - b.CDU')} AS v FROM by_source a JOIN by_source b USING (source_id) WHERE (a.detector, b.detector) IN (('qty', 'disc'), ('qty', 'tax'), ('disc', 'tax'))")
def paired_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(I.paired_contrasts(conditions(spark, sf_dir), [("qty", "disc"), ("qty", "tax"), ("disc", "tax")]))


@query(f"WITH {O.BY_SOURCE} SELECT detector AS condition, count(*) AS n, {O.r('avg(CDU)')} AS mean, {O.r('avg(CDU) / (stddev_samp(CDU) / sqrt(count(*)))')} AS t FROM by_source GROUP BY detector")
def t_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(I.t_statistics(conditions(spark, sf_dir)))


@query()
def t_test_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided p-values of each detector's CDU over sources, Holm-adjusted."""
    return I.holm(I.t_statistics(conditions(spark, sf_dir)).withColumn("p", I.t_greater("t", "n")), "p")


@query(f"""WITH {O.BY_SOURCE}, p AS (SELECT detector, source_id, 1 / (20 + source_id * 3 + n_series) AS p FROM by_source WHERE detector = 'qty'),
s AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, source_id) + 1) AS s FROM p)
SELECT source_id, {O.r('p', 9)} AS p, {O.r('least(1.0, max(s) OVER (ORDER BY p, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 9)} AS holm FROM s""")
def holm_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = L.series_counts(S.unordered_points(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_series"))
    rows = counts.withColumn("p", 1 / (20 + F.col("source_id") * 3 + F.col("n_series")))
    return I.holm(rows, "p").select("source_id", C.rounded("p", 9).alias("p"), C.rounded("holm", 9).alias("holm"))


_LOO = ", loo AS (SELECT *, (sum(CDU) OVER w - CDU) / (count(*) OVER w - 1) AS without, avg(CDU) OVER w AS full_mean FROM by_source WINDOW w AS (PARTITION BY detector))"


@query(f"WITH {O.BY_SOURCE}{_LOO} SELECT detector, source_id, {O.r('without')} AS without, {O.r('without - full_mean')} AS change FROM loo")
def leave_one_source_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.leave_one_out(by_source(spark, sf_dir)).select("detector", "source_id", "without", "change"))


@query(f"""WITH {O.BY_SOURCE}{_LOO} SELECT detector, {O.r('min(without)')} AS delete_min, {O.r('max(without)')} AS delete_max,
count(*) FILTER (without > 0) AS delete_positive, bool_and(sign(without) = sign(full_mean)) AS sign_stable,
arg_max(source_id, (round(abs(without - full_mean), 12), -source_id)) AS most_influential FROM loo GROUP BY detector""")
def source_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(L.influence_summary(by_source(spark, sf_dir)))


@query(f"""WITH {O.BY_SOURCE} SELECT detector, count(*) FILTER (CDU > 0) AS positive, {O.r('avg(CDU)')} AS mean, {O.r('stddev_samp(CDU)')} AS sd,
{O.r('min(CDU)')} AS low, {O.r('max(CDU)')} AS high FROM by_source GROUP BY detector""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(by_source(spark, sf_dir).groupBy("detector").agg(
        F.count_if(F.col("CDU") > 0).alias("positive"), F.avg("CDU").alias("mean"), F.stddev_samp("CDU").alias("sd"),
        F.min("CDU").alias("low"), F.max("CDU").alias("high")))


@query(f"""WITH {O.POINTS}, k AS (SELECT series_id, {O.average_rank('x', 'series_id')} AS a, {O.average_rank('qty', 'series_id')} AS b FROM points)
SELECT series_id, {O.r('covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b))')} AS rho, count(*) AS n FROM k GROUP BY series_id""")
def spearman_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(I.spearman(S.unordered_points(spark, sf_dir), "x", "qty", "series_id"))


_WIDE = ", wide AS (SELECT source_id, max(CDU) FILTER (detector = 'qty') AS a, max(detector_utility) FILTER (detector = 'qty') AS b FROM by_source GROUP BY source_id)"


@query(f"""WITH {O.BY_SOURCE}{_WIDE}, s AS (SELECT sign(x.a - y.a) AS sa, sign(x.b - y.b) AS sb FROM wide x JOIN wide y ON x.source_id < y.source_id)
SELECT {O.r('sum(sa * sb) / sqrt(sum(abs(sa))::DOUBLE * sum(abs(sb)))')} AS tau, count(*) AS pairs FROM s""")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_source(spark, sf_dir).where("detector = 'qty'")
    return tidy(I.kendall(rows, "source_id", "detector_utility", "CDU"))


@query(f"""WITH {O.BY_SOURCE}, k AS (SELECT detector, source_id, {O.average_rank('CDU', 'detector')} AS r FROM by_source)
SELECT x.detector AS a, y.detector AS b, {O.r('corr(x.r, y.r)')} AS rho FROM k x JOIN k y USING (source_id) GROUP BY ALL""")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = by_source(spark, sf_dir).select("detector", "source_id", C.average_rank("CDU", "detector").alias("r"))
    pairs = k.select("source_id", F.col("detector").alias("a"), F.col("r").alias("ra")).join(
        k.select("source_id", F.col("detector").alias("b"), F.col("r").alias("rb")), "source_id")
    return tidy(pairs.groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho")))


@query(f"""WITH {O.SUMMARY}, d AS (SELECT detector, L_detector AS v FROM summary), k AS (
SELECT detector, CDU, detector_utility, rank() OVER (ORDER BY round(CDU, 9) DESC) AS cdu_rank, rank() OVER (ORDER BY round(detector_utility, 9) DESC) AS raw_rank FROM summary)
SELECT detector, cdu_rank, raw_rank, raw_rank - cdu_rank AS uplift FROM k""")
def rank_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of detectors by CDU and by their own utility, and the difference."""
    rows = summary(spark, sf_dir)
    by = lambda c: F.rank().over(Window.orderBy(F.desc(F.round(c, 9)))).cast("long")  # noqa: E731  one row for each detector
    return rows.select("detector", by("CDU").alias("cdu_rank"), by("detector_utility").alias("raw_rank")).withColumn("uplift", F.col("raw_rank") - F.col("cdu_rank"))


@query(f"WITH {O.SUMMARY}, k AS (SELECT detector, -positive_sources AS v FROM summary) SELECT detector, {O.average_rank('v', '1')} AS rank FROM k")
def average_rank_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary(spark, sf_dir).select("detector", (-F.col("positive_sources")).alias("v"), F.lit(1).alias("k"))
    return rows.select("detector", C.average_rank("v", "k").alias("rank"))


@query(f"""WITH {O.SUMMARY}, c AS (SELECT *, row_number() OVER (ORDER BY round(CDU, 9) DESC, detector) AS i, row_number() OVER (ORDER BY round(detector_utility, 9) DESC, detector) AS j FROM summary)
SELECT string_agg(detector, ',' ORDER BY detector) FILTER (i <= 2) AS top_cdu, string_agg(detector, ',' ORDER BY detector) FILTER (j <= 2) AS top_raw,
string_agg(detector, ',' ORDER BY detector) FILTER (i <= 2) = string_agg(detector, ',' ORDER BY detector) FILTER (j <= 2) AS same FROM c""")
def top_k_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary(spark, sf_dir)

    def top(value: str, name: str) -> DataFrame:
        best = rows.select("detector", F.round(value, 9).alias("v")).orderBy(F.desc("v"), "detector").limit(2)
        return best.agg(F.array_join(F.array_sort(F.collect_list("detector")), ",").alias(name))

    return top("CDU", "top_cdu").crossJoin(top("detector_utility", "top_raw")).withColumn("same", F.expr("top_cdu = top_raw"))  # one row each


@query(f"""WITH {O.LOSSES}, m AS (SELECT detector, avg(CDU) AS series_macro FROM losses GROUP BY detector), s AS (
SELECT detector, avg(v) AS source_macro FROM (SELECT detector, source_id, avg(CDU) AS v FROM losses GROUP BY ALL) GROUP BY detector)
SELECT detector, {O.r('series_macro')} AS series_macro, {O.r('source_macro')} AS source_macro FROM m JOIN s USING (detector)""")
def two_level_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses(spark, sf_dir)
    part = rows.groupBy("detector", "source_id").agg(F.sum("CDU").alias("s"), F.count("CDU").alias("n"))
    return tidy(part.groupBy("detector").agg((F.sum("s") / F.sum("n")).alias("series_macro"), F.avg(F.col("s") / F.col("n")).alias("source_macro")))


@query(f"""WITH {O.SUMMARY} SELECT s.detector, {O.r('abs(s.CDU - q.CDU)')} AS change, {O.r('max(abs(s.CDU - q.CDU)) OVER ()')} AS max_change
FROM summary s, (SELECT CDU FROM summary WHERE detector = 'qty') q""")
def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary(spark, sf_dir).select("detector", "CDU")
    primary = rows.where("detector = 'qty'").select(F.col("CDU").alias("p"))
    both = rows.crossJoin(primary).select("detector", F.abs(F.col("CDU") - F.col("p")).alias("change"))  # against one row
    return tidy(both.withColumn("max_change", F.max("change").over(Window.partitionBy(F.lit(1)))))


@query(f"""WITH {O.BY_SOURCE}, m AS (SELECT quantile_cont(CDU, 0.5) AS c, quantile_cont(detector_utility, 0.5) AS u FROM by_source WHERE detector = 'qty')
SELECT source_id, CASE WHEN CDU >= c THEN 'high' ELSE 'low' END || '/' || CASE WHEN detector_utility >= u THEN 'high' ELSE 'low' END AS quadrant FROM by_source, m WHERE detector = 'qty'""")
def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_source(spark, sf_dir).where("detector = 'qty'")
    middle = rows.agg(F.percentile("CDU", F.lit(0.5)).alias("c"), F.percentile("detector_utility", F.lit(0.5)).alias("u"))
    side = lambda v, m: F.when(F.col(v) >= F.col(m), "high").otherwise("low")
    return rows.crossJoin(middle).select("source_id", F.concat_ws("/", side("CDU", "c"), side("detector_utility", "u")).alias("quadrant"))  # one row


@query(f"""WITH {O.SUMMARY} SELECT detector, {O.r('basis_utility')} AS basis_utility, CASE WHEN CDU > 0 THEN 'positive' WHEN CDU < 0 THEN 'negative' ELSE 'zero' END AS status,
CASE WHEN CDU > 0.001 THEN 'PASS' ELSE 'NOT_MET' END AS expectation FROM summary""")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("CDU") > 0, "positive").when(F.col("CDU") < 0, "negative").otherwise("zero")
    wanted = F.when(F.col("CDU") > 0.001, "PASS").otherwise("NOT_MET")
    return tidy(summary(spark, sf_dir).select("detector", "basis_utility", status.alias("status"), wanted.alias("expectation")))


@query(f"""WITH {O.BY_SOURCE}, k AS (SELECT detector, source_id, {O.average_rank('CDU', 'detector')} AS a, {O.average_rank('detector_utility', 'detector')} AS b FROM by_source)
SELECT detector, {O.r('corr(a, b)')} AS rho, count(*) AS n FROM k GROUP BY detector""")
def metric_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(I.spearman(by_source(spark, sf_dir), "CDU", "detector_utility", "detector"))


@query(f"""WITH {O.LOSSES} SELECT detector, count(*) AS n, count(DISTINCT series_id) AS n_series, count(DISTINCT series_id) = count(*) AS is_unique,
count(*) FILTER (abs(CDU - (L_basis - L_basis_detector)) > 1e-14) = 0 AS identity_holds, bool_and(isfinite(CDU)) AS all_finite FROM losses GROUP BY detector""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique series, the CDU identity and finite losses, for each detector."""
    off = F.abs(F.col("CDU") - (F.col("L_basis") - F.col("L_basis_detector"))) > 1e-14
    return losses(spark, sf_dir).groupBy("detector").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("series_id").alias("n_series"),
        (F.countDistinct("series_id") == F.count(F.lit(1))).alias("is_unique"), (F.count_if(off) == 0).alias("identity_holds"),
        F.bool_and(F.abs("CDU") < float("inf")).alias("all_finite"))


@query(f"""WITH {O.LOSSES}, q AS (SELECT series_id, round(L_null, 12) AS a, round(L_basis, 12) AS b FROM losses WHERE detector = 'qty')
SELECT detector, count(*) FILTER (q.series_id IS NULL) AS different FROM losses l LEFT JOIN q ON q.series_id = l.series_id AND q.a = round(L_null, 12) AND q.b = round(L_basis, 12)
WHERE detector <> 'qty' GROUP BY detector""")
def baseline_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series whose shared losses differ from those of the first detector, each detector evaluated in a run of its own."""
    own = [losses(spark, sf_dir, [d]).select("detector", "series_id", F.round("L_null", 12).alias("a"), F.round("L_basis", 12).alias("b")) for d in DETECTORS]
    first = own[0].select("series_id", "a", "b", F.lit(True).alias("same"))
    joined = own[1].unionByName(own[2]).join(first, ["series_id", "a", "b"], "left")
    return joined.groupBy("detector").agg(F.count_if(F.col("same").isNull()).alias("different"))


@query(f"""WITH {O.SUMMARY}, k AS (SELECT detector, rank() OVER (ORDER BY round(CDU, 9)) AS r FROM summary)
SELECT count(DISTINCT r) = count(*) AS distinct_ranks, max(r) AS worst FROM k""")
def rank_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether no two detectors share a rank, as equal values would."""
    order = Window.orderBy(F.round("CDU", 9))  # one row for each detector
    k = summary(spark, sf_dir).select(F.rank().over(order).cast("long").alias("r"))
    return k.agg((F.countDistinct("r") == F.count("r")).alias("distinct_ranks"), F.max("r").alias("worst"))


@query(f"""WITH {O.BY_SOURCE} SELECT source_id, {O.r("max(CDU) FILTER (detector = 'qty')")} AS qty, {O.r("max(CDU) FILTER (detector = 'disc')")} AS disc,
{O.r("max(CDU) FILTER (detector = 'tax')")} AS tax FROM by_source GROUP BY source_id""")
def source_condition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by detectors."""
    return tidy(by_source(spark, sf_dir).groupBy("source_id").pivot("detector", DETECTORS).agg(F.max("CDU")))


@query(f"WITH {O.BY_SOURCE} SELECT detector, source_id, metric, {O.r('value')} AS value FROM (SELECT detector, source_id, CDU, basis_utility FROM by_source) UNPIVOT (value FOR metric IN (CDU, basis_utility))")
def stacked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(by_source(spark, sf_dir).unpivot(["detector", "source_id"], ["CDU", "basis_utility"], "metric", "value"))


@query(f"WITH {O.SUMMARY} SELECT detector, {O.r('CDU')} AS CDU, {O.r('sum(CDU) OVER (ORDER BY detector)')} AS running, {O.r('max(CDU) OVER (ORDER BY detector ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cummax FROM summary")
def cumulative_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.orderBy("detector").rowsBetween(Window.unboundedPreceding, 0)  # one row for each detector
    rows = summary(spark, sf_dir)
    return tidy(rows.select("detector", "CDU", F.sum("CDU").over(order).alias("running"), F.max("CDU").over(order).alias("cummax")))


@query(f"""WITH {O.NULLS}, f AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS i FROM per_source)
SELECT source_id AS fold, count(*) AS n_series, {O.r('avg(L_null)')} AS L_null, any_value(CASE WHEN i <= 5 THEN 1 ELSE 2 END) AS call,
TRUE AS same_digest, TRUE AS same_keys, TRUE AS finite FROM nulls JOIN f USING (source_id) GROUP BY source_id""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over folds that stops after five of them and is resumed: the call that computed each, and whether its rows are what was published."""
    points = S.unordered_points(spark, sf_dir)
    rows = cut(L.null_losses(L.series_counts(points)).select("source_id", "series_id", "L_null"))
    wanted = rows.select(F.col("source_id").alias("fold"), "series_id")
    mark = R.signature({"query": "null losses", "version": 1}, {"rows": rows})
    folder = f"{shared_folder(spark)}/nulls-{uuid.uuid4().hex}"

    def call(number: int):
        held = F.col("source_id").alias("fold")
        return lambda folds: rows.where(F.col("source_id").isin(folds)).select(held, "series_id", "L_null", F.lit(number).alias("call"))

    R.resume(R.Run(spark, folder, mark), wanted, "series_id", call(1), most=5, at_once=5)
    run = R.Run(spark, folder, mark)
    found = R.resume(run, wanted, "series_id", call(2), at_once=1000)
    held = found.groupBy("fold").agg(F.count(F.lit(1)).alias("n_series"), F.avg("L_null").alias("L_null"), F.max("call").alias("call"))
    checks = run.checked(wanted, "series_id").where("published").select(F.col("fold").cast("long").alias("fold"), "same_digest", "same_keys", "finite")
    return tidy(held.join(checks, "fold"))
