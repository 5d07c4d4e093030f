"""Period estimate and VUS-PR of one series, and the scorer registry for detector sweeps."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.columns import array_sha256

#: Fixed values of the period estimate.
FALLBACK, BASE, LAGS, POINTS, LOW, HIGH = 125, 3, 400, 20_000, 6, 300


def autocorrelation(x: np.ndarray, lags: int = LAGS) -> np.ndarray:
    """Demeaned autocorrelation with the full-sum denominator, by FFT."""
    d = np.asarray(x, float) - np.mean(x)
    n = len(d)
    f = np.fft.rfft(d, 1 << (2 * n - 1).bit_length())
    r = np.fft.irfft(f * np.conj(f))[: min(lags, n - 1) + 1]
    return r / r[0] if r[0] > 0 else np.full(len(r), np.nan)


def period(x: np.ndarray, rank: int = 1) -> int:
    """The lag of the highest local maximum of the autocorrelation from lag 3 on; 125 where there is no usable one, 1 for rank 0."""
    if np.ndim(x) > 1:
        return 0
    if rank == 0:
        return 1
    r = autocorrelation(np.asarray(x, float)[:POINTS])[BASE:] if len(x) > 1 else np.zeros(0)
    at = np.flatnonzero((r[1:-1] > r[:-2]) & (r[1:-1] > r[2:])) + 1
    if not len(at):
        return FALLBACK
    lag = int(at[np.argmax(r[at])]) + BASE
    return lag if LOW <= lag <= HIGH else FALLBACK


def anomaly_distance(y: np.ndarray) -> np.ndarray:
    """Each point's distance to the nearest anomaly: 0 inside one, len(y) where there is none."""
    n = len(y)
    at = np.where(np.asarray(y) > 0, np.arange(n), -n)
    before = np.arange(n) - np.maximum.accumulate(at)
    at = np.where(np.asarray(y) > 0, np.arange(n), 2 * n)
    behind = np.minimum.accumulate(at[::-1])[::-1] - np.arange(n)
    return np.minimum(np.minimum(before, behind), n)


def vus_pr(y: np.ndarray, score: np.ndarray, window: int, thresholds: int = 250) -> float:
    """Volume under the precision-recall surface over buffers 0..window; 0 for constant scores or labels.

    A buffer of width w gives a point at distance d <= w / 2 from an anomaly the label sqrt(1 - d / w). Along one order of the
    scores the points of each distance are counted up to each threshold, and all widths' sums of labels are one product
    of their weights and these counts; a span's highest score within a buffer grows by a point on either side.
    """
    y, score = np.asarray(y, int), np.asarray(score, float)
    if np.ptp(score) == 0 or not 0 < y.sum() < len(y):
        return 0.0
    n, half = len(y), window // 2
    order = np.argsort(-score, kind="stable")
    ranks = np.unique(np.linspace(0, n - 1, thresholds).astype(int))
    levels = score[order[ranks]]
    cuts = np.searchsorted(-score[order], -levels, side="right")  # points predicted at each threshold
    d = anomaly_distance(y)[order]
    counts = np.zeros((half + 1, len(cuts) + 1))  # points of each distance, by the first threshold that predicts them
    near = d <= half
    np.add.at(counts, (d[near], np.searchsorted(cuts, np.flatnonzero(near), side="right")), 1)
    upto = np.cumsum(counts[:, :-1], axis=1)
    widths, distance = np.arange(window + 1)[:, None], np.arange(half + 1)[None, :]
    weights = np.where(distance <= widths // 2, np.sqrt(np.clip(1 - distance / np.maximum(widths, 1), 0, 1)), 0.0)
    weights[:, 0] = 1
    hit = weights @ upto
    positives = (y.sum() + weights @ counts.sum(axis=1)) / 2
    edges = np.flatnonzero(np.diff(np.concatenate([[0], y, [0]])))
    starts, ends = edges[::2], edges[1::2]
    best = np.maximum.reduceat(np.append(score, -np.inf), np.column_stack([starts, ends]).ravel())[::2]
    existence = np.empty((half + 1, len(cuts)))
    for h in range(half + 1):
        if h:
            best = np.maximum(best, np.maximum(score[np.maximum(starts - h, 0)], score[np.minimum(ends + h, n) - 1]))
        existence[h] = 1 - np.searchsorted(np.sort(best), levels, side="left") / len(best)
    recall = np.minimum(hit / positives[:, None], 1) * existence[np.arange(window + 1) // 2]
    precision = hit / cuts
    steps = np.diff(np.column_stack([np.zeros(window + 1), recall]), axis=1)
    return float((steps * precision).sum(axis=1).mean())


def series_vus(points: DataFrame, score: str, window: int | None = None) -> DataFrame:
    """(source_id, series_id, n_points, window, vus_pr, status, error): a failing series is a row, not a failed job."""
    kinds = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        row = {"source_id": pdf["source_id"].iloc[0], "series_id": pdf["series_id"].iloc[0], "n_points": len(pdf)}
        try:
            w = period(pdf["x"].to_numpy()) if window is None else window
            row |= {"window": w, "vus_pr": vus_pr(pdf["y"].to_numpy(), pdf["s"].to_numpy(), w), "status": "PASS", "error": ""}
        except (ValueError, FloatingPointError, IndexError) as e:
            row |= {"window": None, "vus_pr": None, "status": "FAIL", "error": repr(e)}
        return pd.DataFrame([row])

    schema = f"source_id {kinds['source_id']}, series_id {kinds['series_id']}, n_points long, window int, vus_pr double, status string, error string"
    return points.select("source_id", "series_id", "t", "x", "y", F.col(score).alias("s")).groupBy("series_id").applyInPandas(run, schema)


def series_periods(points: DataFrame) -> DataFrame:
    kind = dict(points.dtypes)["series_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["x"].to_numpy()
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[:1], "period": [period(x)]})

    return points.select("series_id", "t", "x").groupBy("series_id").applyInPandas(run, f"series_id {kind}, period int")


Scorer = Callable[[np.ndarray, np.ndarray, dict, int], np.ndarray]


def robust_z(train: np.ndarray, test: np.ndarray, config: dict, seed: int) -> np.ndarray:
    """Distance to the training median in median absolute deviations."""
    middle = np.median(train)
    return np.abs(test - middle) / max(np.median(np.abs(train - middle)), 1e-12)


def local_variance(train: np.ndarray, test: np.ndarray, config: dict, seed: int) -> np.ndarray:
    """Variance in a window around each point."""
    from scoreloom.operators.basis import basis_matrix

    return basis_matrix(test, (f"Var-{config.get('width', 32)}",))[:, 0]


def next_point(train: np.ndarray, test: np.ndarray, config: dict, seed: int) -> np.ndarray:
    """Squared distance from the mean of the points before."""
    from scoreloom.operators.basis import basis_matrix

    return basis_matrix(test, (f"Last-{config.get('width', 8)}",))[:, 0]


SCORERS: dict[str, Scorer] = {"robust_z": robust_z, "local_variance": local_variance, "next_point": next_point}


def register(name: str, scorer: Scorer) -> None:
    """Add a detector: a function of (training prefix, whole curve, config, seed) to one score a point."""
    SCORERS[name] = scorer


def sweep(points: DataFrame, detector: str, config: dict | None = None, train: str = "train_cut", seed: int = 2024) -> DataFrame:
    """Score every series; a manifest row for each with the scores, their hash and length, the share of finite ones, the settings, and PASS or FAIL."""
    kinds, scorer, config = dict(points.dtypes), SCORERS[detector], config or {}
    shown = json.dumps(config, sort_keys=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, began = pdf.sort_values("t"), time.perf_counter()
        row = {"series_id": pdf["series_id"].iloc[0], "detector": detector, "seed": seed, "label_length": len(pdf), "score_length": 0, "finite_ratio": 0.0}
        row |= {"config": shown, "config_hash": hashlib.sha256(shown.encode()).hexdigest()}
        try:
            x = pdf["x"].to_numpy(float)
            s = np.asarray(scorer(x[: int(pdf["cut"].iloc[0])], x, config, seed), float).ravel()
            row |= {"score_length": len(s), "finite_ratio": float(np.isfinite(s).mean()) if len(s) else 0.0}
            if len(s) != len(x) or not np.isfinite(s).all():
                raise ValueError("scores of another length, or not finite")
            row |= {"status": "PASS", "error": "", "scores": s, "score_hash": hashlib.sha256(s.astype("<f8").tobytes()).hexdigest()}
        except Exception as e:  # a scorer may fail in any way; that is the row's status
            row |= {"status": "FAIL", "error": repr(e), "scores": None, "score_hash": None}
        return pd.DataFrame([row | {"runtime_sec": time.perf_counter() - began}])

    schema = (
        f"series_id {kinds['series_id']}, detector string, seed int, label_length int, score_length int, finite_ratio double, config string,"
        " config_hash string, status string, error string, scores array<double>, score_hash string, runtime_sec double"
    )
    return points.select("series_id", "t", "x", F.col(train).alias("cut")).groupBy("series_id").applyInPandas(run, schema)


def resumed_sweep(
    points: DataFrame, detector: str, manifest: DataFrame, retry_failed: bool = False, config: dict | None = None, train: str = "train_cut", seed: int = 2024
) -> DataFrame:
    """The whole manifest after another call: series that ``manifest`` has as PASS keep their row, as do failed ones unless they are retried."""
    kept = manifest.where(F.col("detector") == detector)
    kept = kept.where("status = 'PASS'") if retry_failed else kept
    left = points.join(kept.select("series_id"), "series_id", "left_anti")
    return kept.unionByName(sweep(left, detector, config, train, seed))


def linked(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """(series_id, n_points, score_hash, linked): whether a stored score array (series_id, scores) has the hash of its manifest row."""
    found = scores.select("series_id", F.size("scores").cast("long").alias("n_points"), array_sha256("scores").alias("now"))
    both = found.join(manifest.select("series_id", "score_hash"), "series_id", "full")
    return both.select("series_id", F.coalesce("n_points", F.lit(0)).alias("n_points"), "score_hash", F.coalesce(F.col("now") == F.col("score_hash"), F.lit(False)).alias("linked"))


def rerun(points: DataFrame, detector: str, config: dict | None = None, train: str = "train_cut", seed: int = 2024) -> DataFrame:
    """(series_id, detector, run1, run2, same, status): a scorer run twice, the second time on points in another order and by halves of the series.

    A scorer that draws without its seed, keeps state between series or depends on the order of its input shows."""

    def hashes(of: DataFrame, i: int) -> DataFrame:
        return sweep(of, detector, config, train, seed).select("series_id", F.col("score_hash").alias(f"run{i}"), F.col("status").alias(f"s{i}"))

    turned, half = points.repartition(3).sortWithinPartitions(F.desc("t")), F.pmod(F.xxhash64("series_id"), F.lit(2))
    one, two = hashes(points.repartition(7, "t"), 1), hashes(turned.where(half == 0), 2).unionByName(hashes(turned.where(half == 1), 2))
    both = one.join(two, "series_id", "full")
    same = F.coalesce((F.col("run1") == F.col("run2")) & (F.col("s1") == "PASS") & (F.col("s2") == "PASS"), F.lit(False))
    return both.select("series_id", F.lit(detector).alias("detector"), "run1", "run2", same.alias("same"), F.when(same, "PASS").otherwise("FAIL").alias("status"))
