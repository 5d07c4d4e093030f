"""Score reconstruction by ridge regression with one source held out, from per-source Gram sums.

One pass adds up each source's weighted Gram matrix; a fold's is the total less its own. The
solves are as many as sources and as large as the number of features, so they are small;
they run as one group for each fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.probes import FIELDS, unpacked


def simple_ridge(points: DataFrame, feature: str = "u", target: str = "s", alpha: float = 1.0) -> DataFrame:
    """(source_id, slope, intercept) for one feature: closed form on weighted moments.

    ``points``: (source_id, w, feature, target) with w a point's weight within its source. The
    weights of a fold are scaled to sum to its number of points.
    """
    x, y, w = F.col(feature), F.col(target), F.col("w")
    sums = points.groupBy("source_id").agg(
        F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"),
        F.count(F.lit(1)).alias("k"),
    )
    names = ("w", "wx", "wy", "wxx", "wxy", "k")
    whole = sums.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    rest = sums.crossJoin(F.broadcast(whole)).select("source_id", *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in names))
    scale = F.col("k") / F.col("w")
    sxx = (F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")) * scale
    sxy = (F.col("wxy") - F.col("wx") * F.col("wy") / F.col("w")) * scale
    fitted = rest.withColumn("slope", sxy / (sxx + alpha))
    return fitted.select("source_id", "slope", ((F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w")).alias("intercept"))


def ridge_folds(rows: DataFrame, features: int, targets: int, alpha: float = 1.0) -> DataFrame:
    """(source_id, coef array, intercept array) for each held-out source; coef is targets x features, by rows.

    ``rows``: (source_id, w, x array, s array).
    """

    def grams(frames):
        sums: dict = {}
        for pdf in frames:
            z = np.column_stack([np.ones(len(pdf)), np.array(pdf["x"].tolist(), float).reshape(len(pdf), features), np.array(pdf["s"].tolist(), float).reshape(len(pdf), targets)])
            w = pdf["w"].to_numpy(float)
            for g in pdf["source_id"].unique():
                at = (pdf["source_id"] == g).to_numpy()
                m, k = sums.get(g, (0.0, 0))
                sums[g] = (m + (z[at] * w[at, None]).T @ z[at], k + int(at.sum()))
        if sums:
            yield pd.DataFrame({"source_id": list(sums), "k": [k for _, k in sums.values()], "g": [m.ravel() for m, _ in sums.values()]})

    kind = dict(rows.dtypes)["source_id"]
    return _solved(rows.select("source_id", "w", "x", "s").mapInPandas(grams, f"source_id {kind}, k long, g array<double>"), features, targets, alpha)


def _solved(parts: DataFrame, features: int, targets: int, alpha: float) -> DataFrame:
    """The folds' solutions from partial sums (source_id, k, g): a Gram matrix of intercept, features and targets."""
    p, kind = features + targets + 1, dict(parts.dtypes)["source_id"]
    flat = parts.select("source_id", "k", F.posexplode("g").alias("i", "v"))
    summed = flat.groupBy("source_id", "i").agg(F.sum("v").alias("v"), F.sum("k").alias("k"))

    whole = summed.groupBy("i").agg(F.sum("v").alias("tv"), F.sum("k").alias("tk"))
    rest = summed.join(whole, "i").select("source_id", "i", (F.col("tv") - F.col("v")).alias("v"), (F.col("tk") - F.col("k")).alias("k"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(p * p)
        m[pdf["i"].to_numpy()] = pdf["v"]
        m = m.reshape(p, p)
        scale = pdf["k"].iloc[0] / m[0, 0]
        mean = m[0] / m[0, 0]
        c = (m - m[0, 0] * np.outer(mean, mean)) * scale
        f = slice(1, 1 + features)
        coef = np.linalg.solve(c[f, f] + alpha * np.eye(features), c[f, 1 + features :]).T
        bias = mean[1 + features :] - coef @ mean[f]
        return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "coef": [coef.ravel()], "intercept": [bias]})

    return rest.groupBy("source_id").applyInPandas(solve, f"source_id {kind}, coef array<double>, intercept array<double>")


def block_reconstruction(blocks: DataFrame, width: int, features: tuple, targets: dict, alpha: float = 1.0) -> DataFrame:
    """(source_id, series_id, n_points, R2, MSE, detector) of ``targets`` (name: column) from ``features``, by held-out source.

    ``blocks``: one for each series, as the probes' have them; all points count, by 1 / m_s and the blocks' u. Both passes read
    the packed blocks where they are: no point is shuffled. R2 is null for a constant target.
    """
    kind, at = dict(blocks.dtypes)["g"], list(targets.values())
    blocks = blocks.select(*FIELDS[:6])

    def opened(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                x = unpacked(row.x, row.n, width, row.r)
                yield row, x[:, list(features)], x[:, at]

    def grams(frames):
        sums: dict = {}
        for row, x, s in opened(frames):
            z = np.column_stack([np.ones(row.n), x, s])
            m, k = sums.get(row.g, (0.0, 0))
            sums[row.g] = (m + z.T @ z * (row.u / row.n), k + row.n)
        if sums:
            yield pd.DataFrame({"source_id": list(sums), "k": [k for _, k in sums.values()], "g": [m.ravel() for m, _ in sums.values()]})

    parts = blocks.mapInPandas(grams, f"source_id {kind}, k long, g array<double>")
    models = {r["source_id"]: r for r in _solved(parts, len(features), len(at), alpha).collect()}  # a row for each source
    sent = blocks.sparkSession.sparkContext.broadcast({g: (np.array(r["coef"]).reshape(len(at), -1), np.array(r["intercept"])) for g, r in models.items()})

    def scored(frames):
        for row, x, s in opened(frames):
            coef, bias = sent.value[row.g]
            errors = ((s - (x @ coef.T + bias)) ** 2).mean(axis=0)
            yield pd.DataFrame({
                "source_id": row.g, "series_id": row.series_id, "n_points": row.n, "MSE": errors, "detector": list(targets),
                "R2": pd.array([1 - e / v.var() if v.max() > v.min() else None for e, v in zip(errors, s.T)], "Float64"),
            })

    names = f"source_id {kind}, series_id {dict(blocks.dtypes)['series_id']}, n_points long, R2 double, MSE double, detector string"
    return blocks.mapInPandas(scored, names)


def reconstruction_quality(rows: DataFrame, target: str = "s", predicted: str = "p", *keys: str) -> DataFrame:
    """(*keys, n_points, R2, MSE): R2 is null for a constant target."""
    error = F.col(target) - F.col(predicted)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.when(F.max(target) > F.min(target), 1 - F.sum(error * error) / (F.count(F.lit(1)) * F.var_pop(target))).alias("R2"),
        F.avg(error * error).alias("MSE"),
    )
