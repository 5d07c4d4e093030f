"""Hierarchical weights, leave-one-source-out priors, binned probes, four losses and their aggregates.

Everything here works on counts: points are reduced once to (series, bin) counts, and any
statistic of a fold's training set is the total less the held-out source's share. No fold
sees a copy of the points, so the cost does not grow with the number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions.columns import clipped, exact_sum, log_loss_bits, rank01
from scoreloom.functions.storage import pieces

LOSSES = ("L_null", "L_basis", "L_detector", "L_basis_detector")
UTILITIES = ("basis_utility", "detector_utility", "CDU")


def series_counts(points: DataFrame) -> DataFrame:
    """(source_id, series_id, n, pos)."""
    return points.groupBy("source_id", "series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def hierarchical_weights(counts: DataFrame, size: str = "n") -> DataFrame:
    """w = N / (G n_g m_s): every source has one weight, every series of it a like share, every point too."""
    per_source = counts.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_series"), F.sum(size).alias("source_points"))
    whole = per_source.agg(F.sum("source_points").alias("all_points"), F.count(F.lit(1)).alias("n_sources"))
    return (
        counts.join(per_source, "source_id")
        .crossJoin(F.broadcast(whole))  # one row
        .withColumn("w", F.col("all_points") / (F.col("n_sources") * F.col("n_series") * F.col(size)))
    )


def series_equal_weights(counts: DataFrame, size: str = "n") -> DataFrame:
    """w = N / (number of series * m_s)."""
    whole = counts.agg(F.sum(size).alias("all_points"), F.count(F.lit(1)).alias("all_series"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("w", F.col("all_points") / (F.col("all_series") * F.col(size)))


def source_means(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Mean over a source's series of ``value``: (source_id, *keys, m)."""
    return rows.groupBy("source_id", *keys).agg(F.avg(value).alias("m"))


def loso_prior(counts: DataFrame) -> DataFrame:
    """(source_id, prior): the weighted share of positives of all other sources, by subtraction."""
    shares = counts.groupBy("source_id").agg(exact_sum(F.col("pos") / F.col("n")).cast("double").alias("s"), F.count(F.lit(1)).alias("k"))
    means = shares.select("source_id", (F.col("s") / F.col("k")).alias("m"))
    whole = means.agg(exact_sum(F.col("m")).cast("double").alias("s"), F.count(F.lit(1)).alias("g"))
    return means.crossJoin(F.broadcast(whole)).select("source_id", ((F.col("s") - F.col("m")) / (F.col("g") - 1)).alias("prior"))


def null_losses(counts: DataFrame) -> DataFrame:
    """(source_id, series_id, n, pos, prior, L_null)."""
    return counts.join(loso_prior(counts), "source_id").withColumn(
        "L_null", log_loss_bits(F.col("pos"), F.col("n"), F.col("prior")) / F.col("n")
    )


def bin_of(unit: str, bins: int) -> Column:
    return F.floor(F.col(unit) * bins)


def binned_losses(binned: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, source_id, series_id, loss) of the probe that gives each bin its training share of positives.

    ``binned``: (*keys, source_id, series_id, bin, n, pos); ``keys`` tell probes apart, which are
    all fitted together. Weights of a point are 1 / (n_g T_s). A bin that no training series
    has gets the prior. Sums are exact, so a probe's losses don't depend on what is fitted beside it.
    """
    sized = counts.select("source_id", "series_id", F.col("n").alias("T"))
    per_source = counts.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_series")).join(loso_prior(counts), "source_id")
    rows = binned.join(sized.join(per_source, "source_id"), ["source_id", "series_id"])
    weight = 1 / (F.col("n_series") * F.col("T"))
    parts = rows.groupBy(*keys, "bin", "source_id").agg(
        exact_sum(F.col("pos") * weight).alias("a"), exact_sum(F.col("n") * weight).alias("b"), F.max("prior").alias("prior")
    )
    others = Window.partitionBy(*keys, "bin")  # one row for each source
    p = F.when(F.count(F.lit(1)).over(others) == 1, F.col("prior")).otherwise(
        (F.sum("a").over(others) - F.col("a")).cast("double") / (F.sum("b").over(others) - F.col("b")).cast("double")
    )
    scored = rows.drop("prior").join(parts.select(*keys, "bin", "source_id", p.alias("p")), [*keys, "bin", "source_id"])
    return scored.groupBy(*keys, "source_id", "series_id").agg(
        (exact_sum(log_loss_bits(F.col("pos"), F.col("n"), F.col("p")), 20).cast("double") / F.max("T")).alias("loss")
    )


def four_losses(points: DataFrame, detectors: list[str], basis: str = "x", bins: int = 10, joint: int = 5) -> DataFrame:
    """One row for each detector and series: L_null, L_basis, L_detector, L_basis_detector and utilities.

    The basis-only part is computed once and shared by all detectors; all probes are fitted
    in one plan over (series, probe, bin) counts. Tasks rank bounded numbers of points, and hold the counts of as many.
    """
    needed = points.select("source_id", "series_id", "y", basis, *detectors)
    tasks = pieces(needed)
    units = needed.repartition(tasks, "series_id").select(
        "source_id",
        "series_id",
        "y",
        rank01(basis, "series_id").alias("u"),
        *(rank01(d, "series_id").alias(f"u_{d}") for d in detectors),
    )
    cell = lambda k, d, b: F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), b.alias("bin"))
    cells = [cell("basis", "", bin_of("u", bins))]
    for d in detectors:
        cells += [cell("alone", d, bin_of(f"u_{d}", bins)), cell("both", d, bin_of("u", joint) * joint + bin_of(f"u_{d}", joint))]
    binned = units.select("source_id", "series_id", "y", F.explode(F.array(*cells)).alias("c"))
    binned = binned.groupBy("source_id", "series_id", "c.k", "c.d", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    binned = binned.repartition(tasks, "source_id", "series_id")  # as the joins want it, and not merged
    counts = series_counts(points)
    scored = binned_losses(binned, counts, "k", "d")
    by_series = scored.groupBy("source_id", "series_id").agg(
        F.max(F.when(F.col("k") == "basis", F.col("loss"))).alias("L_basis"),
        F.map_from_entries(F.collect_list(F.when(F.col("k") == "alone", F.struct("d", "loss")))).alias("alone"),
        F.map_from_entries(F.collect_list(F.when(F.col("k") == "both", F.struct("d", "loss")))).alias("both"),
    )
    rows = by_series.join(null_losses(counts), ["source_id", "series_id"]).withColumn("detector", F.explode(F.array(*(F.lit(d) for d in detectors))))
    return with_utilities(
        rows.select(
            "detector", "series_id", "source_id", F.col("n").alias("n_points"), F.col("pos").alias("n_anomalies"), "L_null", "L_basis",
            F.element_at("alone", F.col("detector")).alias("L_detector"), F.element_at("both", F.col("detector")).alias("L_basis_detector"),
        )
    )


def with_utilities(losses: DataFrame) -> DataFrame:
    return losses.withColumns(
        {
            "basis_utility": F.col("L_null") - F.col("L_basis"),
            "detector_utility": F.col("L_null") - F.col("L_detector"),
            "CDU": F.col("L_basis") - F.col("L_basis_detector"),
        }
    )


def source_aggregate(losses: DataFrame) -> DataFrame:
    """Means over the series of a source, for each detector."""
    return losses.groupBy("detector", "source_id").agg(
        *(F.avg(c).alias(c) for c in (*LOSSES, *UTILITIES)), F.count(F.lit(1)).alias("n_series")
    )


def summary_aggregate(by_source: DataFrame) -> DataFrame:
    """Means over sources, share of positive sources and numbers, for each detector."""
    return by_source.groupBy("detector").agg(
        *(F.avg(c).alias(c) for c in (*LOSSES, *UTILITIES)),
        F.avg((F.col("CDU") > 0).cast("double")).alias("positive_source_fraction"),
        F.count_if(F.col("CDU") > 0).alias("positive_sources"),
        F.count(F.lit(1)).alias("n_sources"),
        F.sum("n_series").alias("n_series"),
    )


def macro_loss(losses: DataFrame, value: str = "L_null") -> DataFrame:
    """Timestamp, series and source averages in turn: one row."""
    return source_means(losses, F.col(value)).agg(F.avg("m").alias(value))


def leave_one_out(by_source: DataFrame, value: str = "CDU", *keys: str) -> DataFrame:
    """Each source's mean without it, and the change that makes."""
    w = Window.partitionBy(*(keys or ("detector",)))
    without = (F.sum(value).over(w) - F.col(value)) / (F.count(F.lit(1)).over(w) - 1)
    full = F.avg(value).over(w)
    return by_source.select("*", without.alias("without"), full.alias("full")).withColumn("change", F.col("without") - F.col("full"))


def influence_summary(by_source: DataFrame, value: str = "CDU") -> DataFrame:
    """Range, sign stability and the most influential source of the leave-one-out means."""
    rows = leave_one_out(by_source, value)
    return rows.groupBy("detector").agg(
        F.min("without").alias("delete_min"),
        F.max("without").alias("delete_max"),
        F.count_if(F.col("without") > 0).alias("delete_positive"),
        F.bool_and(F.signum("without") == F.signum("full")).alias("sign_stable"),
        F.max_by("source_id", F.struct(F.round(F.abs("change"), 12), -F.col("source_id"))).alias("most_influential"),
    )


def probability_loss(points: DataFrame, p: Column) -> DataFrame:
    """Mean log-loss in bits per series of given point-wise probabilities."""
    q = clipped(p)
    one = -(F.col("y") * F.log2(q) + (1 - F.col("y")) * F.log2(1 - q))
    return points.groupBy("source_id", "series_id").agg(F.avg(one).alias("loss"))
