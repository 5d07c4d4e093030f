"""The reference curves of series of any length: chunks with a halo, and ranks from counts of values.

A series is cut into chunks of ``chunk`` points. Each chunk is worked on with the ``HALO`` points on either side,
more than the widest window reaches, and gives the curves of its own points alone; so a task holds one chunk,
and the result is the kernel's over the whole series. Points near a border are copied once.

Ranks need no sort of a series in one place: equal values are counted first, ranges of (key, value) are summed
apart, and a small table of the ranges' totals says how many values lie before each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions.storage import cut
from scoreloom.operators.basis import NAMES, WIDTHS, basis_matrix

#: A multiple of the steps of the spectral windows, and more than the widest window and a step.
HALO = 320
STEP = max(WIDTHS["SpecEnt"]) // 8
CHUNK = 65_536
#: Distinct values in a range of ranks.
RANGE = 200_000


def chunked_basis(points: DataFrame, names: tuple[str, ...] = NAMES, keep: tuple[str, ...] = ("source_id", "y"), chunk: int = CHUNK) -> DataFrame:
    """(series_id, t, *keep, basis array<double>): unranked curves; ``t`` counts each series' points from 0."""
    if chunk % STEP or chunk < HALO:
        raise ValueError(f"chunks are multiples of {STEP}, of {HALO} points at least")
    kinds = dict(points.dtypes)
    columns = ["series_id", "t", *keep]
    own, at = F.floor(F.col("t") / chunk).cast("long"), F.col("t") % chunk
    before, behind = F.when((at < HALO) & (own > 0), own - 1), F.when(at >= chunk - HALO, own + 1)
    rows = points.select("x", *columns, F.explode(F.array_compact(F.array(own, before, behind))).alias("__chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        mine = (pdf["t"] // chunk == pdf["__chunk"]).to_numpy()
        if not mine.any():
            return pdf[columns].iloc[:0].assign(basis=pd.Series([], dtype=object))
        m = basis_matrix(pdf["x"].to_numpy(), names)[mine]
        return pdf.loc[mine, columns].assign(basis=list(m))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "basis array<double>"])
    return rows.groupBy("series_id", "__chunk").applyInPandas(run, schema)


def value_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, r): (average rank - 1/2) / n of each distinct value within ``keys``."""
    counts = cut(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, -(-counts.count() // RANGE))
    ranged = counts.repartitionByRange(parts, *keys, value) if parts > 1 else counts
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id() if parts > 1 else F.lit(0)))
    totals = ranged.groupBy(*keys, "__part").agg(F.sum("n").alias("m"))
    along = Window.partitionBy(*keys).orderBy("__part")  # a row for each range that a key is in
    offsets = totals.withColumn("__ahead", F.sum("m").over(along) - F.col("m")).withColumn("__all", F.sum("m").over(Window.partitionBy(*keys))).drop("m")
    upto = Window.partitionBy("__part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("__upto", F.sum("n").over(upto)).join(offsets, [*keys, "__part"])
    last = F.col("__ahead") + F.col("__upto")
    return placed.select(*keys, value, (((last - F.col("n") + 1 + last) / 2 - 0.5) / F.col("__all")).alias("r"))


def ranked_long(points: DataFrame, names: tuple[str, ...] = NAMES, keep: tuple[str, ...] = ("source_id", "y"), chunk: int = CHUNK) -> DataFrame:
    """As ``ranked_basis``: (series_id, t, *keep, basis array<double>) of ranked curves, no series in one task."""
    raw = cut(chunked_basis(points, names, keep, chunk))
    each = raw.select("series_id", "t", F.posexplode("basis").alias("curve", "v"))
    ranks = value_ranks(each, ["series_id", "curve"], "v")
    found = each.join(ranks, ["series_id", "curve", "v"]).groupBy("series_id", "t")
    curves = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("curve", "r"))), lambda x: x["r"]).alias("basis"))  # of fixed number
    return raw.drop("basis").join(curves, ["series_id", "t"])
