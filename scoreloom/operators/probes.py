"""Learned probes with one source held out: L2 logistic (linear or cubic spline) and boosted histogram trees.

Points are packed into blocks, a row for each series (or part of one) with its matrix as bytes, so
a pass moves no rows one by one. Linear and spline probes of all folds, conditions and values of C
are fitted together: a pass adds up gradients by probe and fold; the partial sums are added in a
second small stage, and only small systems reach the driver. Rows are never copied for each fold.

The intercept is penalised like any other coefficient, as the evaluated protocol has it.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.functions.columns import EPS

#: The protocol's settings.
C = 0.1
KNOTS = (0.0, 1 / 3, 2 / 3, 1.0)
#: The joint fit begins on one in START series where they have ENOUGH rows for each coefficient; it ends on all rows.
START, ENOUGH = 16, 1000
#: Rows from which two features are counted at once, and rows in a block.
WIDE, BLOCK = 100_000, 16_384
TREES = {"trees": 32, "leaves": 7, "depth": 3, "rate": 0.1, "least": 100, "l2": 1.0, "bins": 31}


def spline_columns(u: np.ndarray, knots=KNOTS, degree: int = 3) -> np.ndarray:
    """Cubic B-splines on uniform knots without the last one, constant beyond the ends: 5 columns for 4 knots."""
    step = knots[1] - knots[0]
    if degree == 3:  # the four polynomials of a uniform knot interval
        at = (np.clip(u, knots[0], knots[-1]) - knots[0]) / step
        inside = np.minimum(at.astype(np.int64), len(knots) - 2)
        at = at - inside
        away = 1 - at
        parts = (away**3 / 6, (at * at * (3 * at - 6) + 4) / 6, (away * away * (3 * away - 6) + 4) / 6, at**3 / 6)
        masks = [(inside == j).astype(float) for j in range(len(knots) - 1)]
        out = np.zeros((*np.shape(u), len(knots) + 1))
        for j, mask in enumerate(masks):
            for k in range(min(4, len(knots) + 1 - j)):
                out[..., j + k] += mask * parts[k]
        return out
    t = np.concatenate([knots[0] - step * np.arange(degree, 0, -1), knots, knots[-1] + step * np.arange(1, degree + 1)])
    x = np.clip(u, knots[0], knots[-1])[..., None]
    inside = np.searchsorted(t, np.clip(x, knots[0], knots[-1] - 1e-12), side="right") - 1
    b = (np.arange(len(t) - 1) == inside).astype(float)
    for d in range(1, degree + 1):
        left = (x - t[: -d - 1]) / (t[d:-1] - t[: -d - 1])
        right = (t[d + 1 :] - x) / (t[d + 1 :] - t[1:-d])
        b = left * b[..., :-1] + right * b[..., 1:]
    return b[..., :-1]


def design(x: np.ndarray, kind: str) -> np.ndarray:
    """Features with the penalised intercept last."""
    if kind == "spline":
        x = spline_columns(x).reshape(len(x), -1)
    return np.column_stack([x, np.ones(len(x))])


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class Probe(NamedTuple):
    """A probe of some columns of the blocks' matrix; a column may stand twice."""

    name: str
    columns: tuple
    kind: str = "linear"
    c: float = C


class Fold(NamedTuple):
    """Groups that the fit must not see, and those that it is scored on."""

    held: frozenset
    scored: frozenset


def held_out(groups: list) -> list[Fold]:
    """One fold for each group, or list of groups, left out."""
    sets = [frozenset(g) if isinstance(g, (list, tuple, set, frozenset)) else frozenset([g]) for g in groups]
    return [Fold(x, x) for x in sets]


def block(g, series_id, x: np.ndarray, y: np.ndarray, w: np.ndarray, ranks: int = 0) -> dict:
    """Points of one series: ``x`` (a row each), labels, training weights (0: not in the training sample).

    The first ``ranks`` columns are ``basis.ranks01`` of all the series' points, multiples of 1 / 2n, and stand as whole numbers.
    """
    n = len(y)
    halves = np.rint(x[:, :ranks] * (2 * n)).astype(_whole(n))
    return {
        "g": g, "series_id": series_id, "n": n, "u": 1.0, "r": ranks,
        "x": halves.tobytes() + np.ascontiguousarray(x[:, ranks:], float).tobytes(), "y": np.asarray(y, float).tobytes(), "w": np.asarray(w, float).tobytes(),
    }


def _whole(n: int):
    """The type that holds up to 2n."""
    return np.uint16 if n < 1 << 15 else np.uint32 if n < 1 << 31 else np.uint64


def unpacked(x: bytes, n: int, width: int, ranks: int) -> np.ndarray:
    """The matrix of a block, to the last bit as it was."""
    if not ranks:
        return np.frombuffer(x, float).reshape(n, width)
    out = np.empty((n, width))
    halves = np.frombuffer(x, _whole(n), n * ranks)
    out[:, :ranks] = halves.reshape(n, ranks) / 2.0 / n
    out[:, ranks:] = np.frombuffer(x, float, offset=halves.nbytes).reshape(n, width - ranks)
    return out


#: The columns of blocks, in the order that passes read them.
FIELDS = ("g", "series_id", "n", "u", "r", "x", "y", "w")


def block_schema(g: str, series: str) -> str:
    return f"g {g}, series_id {series}, n long, u double, r int, x binary, y binary, w binary"


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks from rows (source_id, series_id, y, x array, w); each task packs its runs of a series."""
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for (g, series), part in pdf.groupby(["source_id", "series_id"], sort=False):
                x = np.array(part["x"].tolist(), float).reshape(len(part), -1)
                out.append(block(g, series, x, part["y"].to_numpy(float), part["w"].to_numpy(float)))
            if out:
                yield pd.DataFrame(out)

    return rows.select("source_id", "series_id", "y", "x", "w").mapInPandas(run, block_schema(kinds["source_id"], kinds["series_id"]))


def _designs(x: np.ndarray, probes: list[Probe]) -> Iterator[np.ndarray]:
    """Each probe's design matrix; equal ones are made once, and a column's splines once for all probes."""
    known: dict = {}
    curves = sorted({c for p in probes if p.kind == "spline" for c in p.columns})
    splines, place = (spline_columns(x[:, curves]) if curves else None), {c: i for i, c in enumerate(curves)}
    for p in probes:
        key = (p.columns, p.kind)
        if key not in known and p.kind == "spline":
            chosen = splines[:, [place[c] for c in p.columns]].reshape(len(x), -1)
            known[key] = np.column_stack([chosen, np.ones(len(x))])
        elif key not in known:
            known[key] = design(x[:, list(p.columns)], p.kind)
        yield known[key]


def _losses(m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of logistic losses and the probabilities at margins ``m`` (a row each), from one exponential.

    With equal weights, logarithms are taken of products: 512 factors of at most 2 each.
    """
    e = np.exp(-np.abs(m))
    both = 1 + e
    if w[0] == w.min() == w.max():
        logs = w[0] * np.log(np.multiply.reduceat(both, np.arange(0, len(w), 512), axis=0)).sum(axis=0)
    else:
        logs = w @ np.log1p(e)
    return w @ np.maximum(m, 0) + logs - (w * y) @ m, np.where(m < 0, e, 1.0) / both


def _opened(batches: Iterator[pa.RecordBatch], width: int, each: int = 1):
    """(g, series_id, x, y, w) of each block, or of those of one in ``each`` series by a hash."""
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(len(FIELDS)))):
            if each > 1 and zlib.crc32(str(row[1]).encode()) % each:
                continue
            g, series, n, u, ranks, x, y, w = (v.as_py() for v in row)
            yield g, series, unpacked(x, n, width, ranks), np.frombuffer(y, float), np.frombuffer(w, float) * u


def _joint_pass(width: int, probes: list[Probe], sent):
    """(probe, g) with the summed weight, loss, gradient and (if ``curved``) Hessian of a group's rows at the joint coefficients, of every ``each``-th series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, live, each, curved = sent.value
        wanted, sums = [probes[i] for i in live], {}
        for g, _, x, y, w in _opened(batches, width, each):
            used = w > 0
            if not used.any():
                continue
            y, w = y[used], w[used]
            for i, z in zip(live, _designs(x[used], wanted)):
                loss, q = _losses(z @ beta[i], y, w)
                hessian = (z.T @ (z * (w * q * (1 - q))[:, None])).ravel() if curved else ()
                part = np.concatenate([[w.sum(), loss], z.T @ (w * (q - y)), hessian])
                sums[i, g] = sums.get((i, g), 0.0) + part
        yield from _sent(sums)

    return run


def _fold_pass(width: int, probes: list[Probe], sent):
    """(probe, -) with the summed losses and gradients of a probe's open folds, then the Hessians that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials, folds = sent.value  # probe: (fold numbers, coefficients, those whose Hessian is asked for)
        live = sorted(trials)
        wanted, sums, sees = [probes[i] for i in live], {}, {}
        for g, _, x, y, w in _opened(batches, width):
            used = w > 0
            if not used.any():
                continue
            if g not in sees:
                sees[g] = {i: np.array([g not in folds[k].held for k in trials[i][0]]) for i in live}
            y, w = y[used], w[used]
            for i, z in zip(live, _designs(x[used], wanted)):
                ks, b, exact = trials[i]
                got = sums.setdefault((i, None), np.zeros(len(ks) * (1 + z.shape[1]) + len(exact) * z.shape[1] ** 2))
                losses, gradients = got[: len(ks)], got[len(ks) : len(ks) * (1 + z.shape[1])].reshape(len(ks), -1)
                mine = np.flatnonzero(sees[g][i])
                for a in range(0, len(mine), max(1, 1_000_000 // len(y))):  # bounds the margins held at a time
                    part = mine[a : a + max(1, 1_000_000 // len(y))]
                    found, q = _losses(z @ b[part].T, y, w)
                    losses[part] += found
                    gradients[part] += ((q - y[:, None]) * w[:, None]).T @ z
                for e, k in enumerate(exact):
                    if sees[g][i][k]:
                        q = sigmoid(z @ b[k])
                        at = len(ks) * (1 + z.shape[1]) + e * z.shape[1] ** 2
                        got[at : at + z.shape[1] ** 2] += (z.T @ (z * (w * q * (1 - q))[:, None])).ravel()
        yield from _sent(sums)

    return run


def _sent(sums: dict) -> Iterator[pa.RecordBatch]:
    if sums:
        cols = [pa.array([k[0] for k in sums], pa.int32()), pa.array([str(k[1]) for k in sums]), pa.array([v.tobytes() for v in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["i", "g", "v"])


def _summed(parts: DataFrame) -> dict:
    """Vectors by (probe, group), added up in a second small stage."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        v = sum(np.frombuffer(x, float) for x in pdf["v"])
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "g": pdf["g"].iloc[:1], "v": [v.tobytes()]})

    rows = parts.groupBy("i", "g").applyInPandas(added, "i int, g string, v binary").collect()  # one for each probe and group
    return {(r["i"], r["g"]): np.frombuffer(r["v"], float) for r in rows}


class Joint(NamedTuple):
    """The joint solution of some probes: a group's rows (m) and weight (s), coefficients, by group the sums at these (weight, loss,
    gradient) and Hessians of their order of size, and the probes that did not get there."""

    sizes: dict
    beta: list
    sums: list
    hessians: list
    astray: list


def _scale(sizes: dict, held=()) -> float:
    return sum(r["m"] for g, r in sizes.items() if g not in held) / (sum(r["s"] for g, r in sizes.items() if g not in held) or 1.0)


def _coefficients(probes: list[Probe]) -> list[int]:
    return [len(x.columns) * (len(KNOTS) + 1 if x.kind == "spline" else 1) + 1 for x in probes]


def joint_fit(blocks: DataFrame, width: int, probes: list[Probe], steps: int = 40) -> Joint:
    """The fit of all groups by Newton steps, with what folds need of it.

    Where there are rows enough, one in START series gives the Hessians, and passes over all rows make gradients alone,
    until these are as near to zero as by Newton steps; a probe that closes in slowly gets its Hessian from all rows."""
    spark = blocks.sparkSession
    blocks = blocks.select(*FIELDS)
    sizes, p = {r["g"]: r for r in blocks_sizes(blocks)}, _coefficients(probes)
    whole, rows = _scale(sizes), sum(r["m"] for r in sizes.values())
    joint, kept, each = [np.zeros(k) for k in p], [{} for _ in probes], START if rows >= START * ENOUGH * max(p) else 1

    def newton(each: int, near: float, live: list, fixed: list | None = None) -> list:
        """Newton steps from ``joint`` on all groups until the gradient is ``near`` zero; leaves the probes that didn't get there.

        With ``fixed`` inverse Hessians, passes leave them out, and a probe whose gradient isn't halved by a step leaves too."""
        loss, size, change, live, slow = [np.inf] * len(probes), [np.inf] * len(probes), [np.zeros(k) for k in p], list(live), []
        for _ in range(steps):
            if not live:
                break
            sent = spark.sparkContext.broadcast((joint, live, each, fixed is None))
            got = _summed(blocks.mapInArrow(_joint_pass(width, probes, sent), "i int, g string, v binary"))
            sent.unpersist()
            for i in list(live):
                mine = {g: v for (k, g), v in got.items() if k == i}
                v = sum(mine.values()) if mine else np.zeros(2 + p[i] + (p[i] ** 2 if fixed is None else 0))
                v = v * (whole if each == 1 else rows / (v[0] or 1.0))
                value = v[1] + joint[i] @ joint[i] / (2 * probes[i].c)
                if value > loss[i] + 1e-9 * abs(value):  # too long a step: go half back
                    change[i] = 0.5 * change[i]
                    joint[i] = joint[i] - change[i]
                    continue
                gradient = v[2 : p[i] + 2] + joint[i] / probes[i].c
                kept[i] = mine
                loss[i] = value
                g = np.abs(gradient).max(initial=0)
                if g < near * max(1.0, abs(value)):
                    live.remove(i)
                    continue
                if fixed is not None and g > 0.5 * size[i]:
                    live.remove(i)
                    slow.append(i)
                    continue
                size[i] = g
                change[i] = -(np.linalg.solve(v[p[i] + 2 :].reshape(p[i], p[i]) + np.eye(p[i]) / probes[i].c, gradient) if fixed is None else fixed[i] @ gradient)
                joint[i] = joint[i] + change[i]
        return live + slow

    def curves(mine: dict, i: int, scale: float) -> dict:
        return {g: scale * x[p[i] + 2 :].reshape(p[i], p[i]) for g, x in mine.items()}

    every = list(range(len(probes)))
    if each > 1:
        newton(each, 1e-3, every)
        seen = [sum(x[0] for x in mine.values()) or 1.0 for mine in kept]
        hessians = [curves(mine, i, rows / whole / seen[i]) for i, mine in enumerate(kept)]
        fixed = [np.linalg.inv(whole * sum(h.values(), np.zeros((p[i], p[i]))) + np.eye(p[i]) / probes[i].c) for i, h in enumerate(hessians)]
        every = newton(1, 1e-5, every, fixed)
    else:
        hessians = [{} for _ in probes]
    astray = newton(1, 1e-5, every)
    for i in every:
        hessians[i] = curves(kept[i], i, 1.0)
    return Joint(sizes, joint, [{g: x[: p[i] + 2] for g, x in mine.items()} for i, mine in enumerate(kept)], hessians, astray)


def fit(blocks: DataFrame, width: int, probes: list[Probe], folds: list[Fold], steps: int = 40, begun: Joint | None = None) -> list[np.ndarray]:
    """Coefficients of each probe, a row for each fold; ``begun``: the joint solution, if it is known.

    Losses, gradients and Hessians of the joint solution are kept by group: a fold's are the
    total less its held groups', so its first step takes no pass. From the joint solution every fold goes on by steps with that Hessian and
    exact gradients; a fold that closes in slowly gets an exact Hessian. A pass serves all probes and folds,
    and rows are never copied.
    """
    spark = blocks.sparkSession
    blocks = blocks.select(*FIELDS)
    p = _coefficients(probes)
    sizes, joint, kept, hessians, astray = begun or joint_fit(blocks, width, probes, steps)
    scale = lambda held: _scale(sizes, held)
    held = [{str(g) for g in f.held} for f in folds]
    scales = [scale(f.held) for f in folds]
    beta = [np.tile(b, (len(folds), 1)) for b in joint]
    solve: dict = {}
    for i, by_group in enumerate(hessians):
        total = sum(by_group.values()) if by_group else np.zeros((p[i], p[i]))
        for k, h in enumerate(held):
            left = total - sum((by_group[g] for g in h if g in by_group), np.zeros((p[i], p[i])))
            solve[i, k] = np.linalg.inv(scales[k] * left + np.eye(p[i]) / probes[i].c)
    open_folds = {i: list(range(len(folds))) for i in range(len(probes))}
    known = {i: np.full(len(folds), np.inf) for i in open_folds}
    size = {i: np.full(len(folds), np.inf) for i in open_folds}
    moved = [np.zeros_like(b) for b in beta]
    exact: dict = {i: [] for i in open_folds}
    for i in set(open_folds) - set(astray):  # a fold's loss and gradient at the joint solution are the total's less its held groups'
        total = sum(kept[i].values()) if kept[i] else np.zeros(2 + p[i])
        for k, h in enumerate(held):
            v = scales[k] * (total - sum((kept[i][g] for g in h if g in kept[i]), np.zeros(len(total))))
            gradient = v[2 : p[i] + 2] + beta[i][k] / probes[i].c
            known[i][k], size[i][k] = v[1] + beta[i][k] @ beta[i][k] / (2 * probes[i].c), np.abs(gradient).max(initial=0)
            moved[i][k] = -solve[i, k] @ gradient
            beta[i][k] = beta[i][k] + moved[i][k]
    for _ in range(steps):
        trials = {i: (ks, beta[i][ks], [ks.index(k) for k in exact[i]]) for i, ks in open_folds.items() if ks}
        if not trials:
            break
        sent = spark.sparkContext.broadcast((trials, folds))
        got = _summed(blocks.mapInArrow(_fold_pass(width, probes, sent), "i int, g string, v binary"))
        sent.unpersist()
        for i, (ks, _, asked) in trials.items():
            v = got.get((i, "None"), np.zeros(len(ks) * (1 + p[i]) + len(asked) * p[i] ** 2))
            for e, at in enumerate(asked):
                start = len(ks) * (1 + p[i]) + e * p[i] ** 2
                solve[i, ks[at]] = np.linalg.inv(scales[ks[at]] * v[start : start + p[i] ** 2].reshape(p[i], p[i]) + np.eye(p[i]) / probes[i].c)
            exact[i], left = [], []
            for at, k in enumerate(ks):
                b, c = beta[i][k], probes[i].c
                value = scales[k] * v[at] + b @ b / (2 * c)
                gradient = scales[k] * v[len(ks) + at * p[i] : len(ks) + (at + 1) * p[i]] + b / c
                if value > known[i][k] + 1e-9 * abs(value):
                    moved[i][k] *= 0.5
                    beta[i][k] = b - moved[i][k]
                    left.append(k)
                    continue
                g = np.abs(gradient).max(initial=0)
                if g >= 1e-8 * max(1.0, abs(value)):
                    left.append(k)
                    if g > 0.5 * size[i][k]:
                        exact[i].append(k)
                    moved[i][k] = -solve[i, k] @ gradient
                    beta[i][k] = b + moved[i][k]
                known[i][k], size[i][k] = value, g
            open_folds[i] = left
    return beta


def blocks_sizes(blocks: DataFrame) -> list:
    """Of each group the number and weight of its training rows: a row for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [np.frombuffer(x.as_py(), float) for x in batch.column(2)]
            cols = [batch.column(0), pa.array([int((x > 0).sum()) for x in w], pa.int64()), pa.array([x.sum() * u.as_py() for x, u in zip(w, batch.column(1))], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["g", "m", "s"])

    kind = dict(blocks.dtypes)["g"]
    return blocks.select("g", "u", "w").mapInArrow(run, f"g {kind}, m long, s double").groupBy("g").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).collect()


def _scored(blocks: DataFrame, width: int, probes: list[Probe], folds: list[Fold], sent, predicted) -> DataFrame:
    """(g, series_id, fold, L_<probe>...): mean held-out losses in bits over all points of a series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of: dict = {}
        for g, series, x, y, _ in _opened(batches, width):
            if g not in of:
                of[g] = [k for k, f in enumerate(folds) if g in f.scored]
            for k in of[g]:
                losses = []
                for q in predicted(sent.value, x, k):
                    q = np.clip(q, EPS, 1 - EPS)
                    losses.append(-float(np.where(y > 0, np.log2(q), np.log2(1 - q)).sum()))
                yield (g, series, k, len(y), *losses)

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(batches)
        while rows := list(itertools.islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    kinds = dict(blocks.dtypes)
    blocks = blocks.select(*FIELDS)
    text = ", ".join([f"g {kinds['g']}", f"series_id {kinds['series_id']}", "fold int", "n long", *(f"l{i} double" for i in range(len(probes)))])
    schema = to_arrow_schema(T._parse_datatype_string(text))
    sums = blocks.mapInArrow(batched, text).groupBy("g", "series_id", "fold").agg(F.sum("n").alias("n"), *(F.sum(f"l{i}").alias(f"l{i}") for i in range(len(probes))))
    return sums.select("g", "series_id", "fold", *((F.col(f"l{i}") / F.col("n")).alias(f"L_{p.name}") for i, p in enumerate(probes)))


def fold_losses(blocks: DataFrame, width: int, probes: list[Probe], folds: list[Fold], begun: Joint | None = None) -> DataFrame:
    """(g, series_id, fold, L_<probe>...): fitted without a fold's held groups, scored on every point of its scored ones."""
    sent = blocks.sparkSession.sparkContext.broadcast(fit(blocks, width, probes, folds, begun=begun))

    def predicted(beta, x, k):
        return (sigmoid(z @ beta[i][k]) for i, z in enumerate(_designs(x, probes)))

    return _scored(blocks, width, probes, folds, sent, predicted)


def fit_loso(rows: DataFrame, folds: list, width: int, kind: str = "linear", c: float | list[float] = C) -> dict:
    """Coefficients for each (fold, c), from rows (source_id, series_id, w, y, x array); ``folds`` are held-out sources, or lists of them."""
    cs = list(c) if isinstance(c, (list, tuple)) else [c]
    probes = [Probe(str(x), tuple(range(width)), kind, x) for x in cs]
    beta = fit(blocks_of(rows), width, probes, held_out(folds))
    return {(k, x): beta[j][k] for k in range(len(folds)) for j, x in enumerate(cs)}


def predict_loso(rows: DataFrame, folds: list, coefficients: dict, width: int, kind: str = "linear", c: float = C) -> DataFrame:
    """``rows`` (source_id, series_id, y, x array) of held-out sources with their fold's probability ``p``."""
    fold_of = {s: i for i, f in enumerate(folds) for s in (f if isinstance(f, (list, tuple, set)) else [f])}
    sent = rows.sparkSession.sparkContext.broadcast({i: coefficients[i, c] for i in range(len(folds))})
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            z = design(np.array(pdf["x"].tolist(), float).reshape(len(pdf), width), kind)
            b = np.array([sent.value[fold_of[s]] for s in pdf["source_id"]]).reshape(len(pdf), z.shape[1])
            yield pdf[["source_id", "series_id", "y"]].assign(p=sigmoid((z * b).sum(axis=1)))

    schema = f"source_id {kinds['source_id']}, series_id {kinds['series_id']}, y {kinds['y']}, p double"
    return rows.select("source_id", "series_id", "y", "x").mapInPandas(run, schema)


def mean_losses(predicted: DataFrame, name: str) -> DataFrame:
    """(source_id, series_id, name): mean log-loss in bits of (y, p)."""
    q = F.greatest(F.least("p", F.lit(1 - EPS)), F.lit(EPS))
    one = -(F.col("y") * F.log2(q) + (1 - F.col("y")) * F.log2(1 - q))
    return predicted.groupBy("source_id", "series_id").agg(F.avg(one).alias(name))


class Trees:
    """Boosted regression trees of the logistic loss on equal-width histograms of [0, 1] features."""

    def __init__(self, trees=32, leaves=7, depth=3, rate=0.1, least=100, l2=1.0, bins=31):
        self.trees, self.leaves, self.depth, self.rate, self.least, self.l2, self.bins = trees, leaves, depth, rate, least, l2, bins
        self.model: list = []
        self.start = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers, a row for each feature."""
        return np.ascontiguousarray(np.clip((x * self.bins).astype(np.int64), 0, self.bins - 1).T.astype(np.uint8))

    def fit(self, b: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        share = np.clip((w @ y) / w.sum(), EPS, 1 - EPS)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        b = self._coded(b)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))  # scores stay small: no overflow
            tree, leaf_of, values = self._grow(b, w * (p - y), w * p * (1 - p))
            self.model.append((tree, values))
            score += values[leaf_of]
        return self

    def _coded(self, b: np.ndarray) -> tuple:
        """``b`` with two or three features in one number: one count over the numbers holds the counts of each feature.

        Of many rows two, whose tables stay in a core's cache while blocks of rows go by."""
        at_once = next(k for k in (3, 2, 1) if k == 1 or (self.bins**k <= 1 << 16 and self.bins**k <= b.shape[1] < (WIDE if k == 3 else np.inf)))
        groups = [range(f, min(f + at_once, len(b))) for f in range(0, len(b), at_once)]
        codes = []
        for fs in groups:
            code = np.zeros(b.shape[1], np.uint16)
            for f in fs:
                code = code * np.uint16(self.bins) + b[f]
            codes.append(code)
        return b, groups, codes

    def _histogram(self, coded, g, h, rows, counted: bool = True):
        """(3, features, bins): numbers (if ``counted``), gradients and Hessians of ``rows``; the last two are added as one complex number."""
        b, groups, codes = coded
        tables = [np.zeros((2, self.bins ** len(fs)), complex) for fs in groups]
        for a in range(0, len(g) if isinstance(rows, slice) else len(rows), BLOCK):
            part = slice(a, a + BLOCK) if isinstance(rows, slice) else rows[a : a + BLOCK]
            z = np.empty(len(g[part]) if isinstance(rows, slice) else len(part), complex)
            z.real, z.imag = g[part], h[part]
            for code, (sums, numbers) in zip(codes, tables):
                at = code[part].astype(np.intp)
                np.add.at(sums, at, z)
                if counted:
                    numbers += np.bincount(at, minlength=len(numbers))
        out = np.zeros((3, len(b), self.bins))
        for fs, (sums, numbers) in zip(groups, tables):
            for i, found in enumerate((numbers.real, sums.real, sums.imag)):
                for k, f in enumerate(fs):
                    out[i, f] = found.reshape((self.bins,) * len(fs)).sum(axis=tuple(j for j in range(len(fs)) if j != k))
        return out

    def _split(self, b, g, h, rows, histogram, sums):
        """The best (gain, feature, bin) of a node with summed gradient and Hessian ``sums``.

        Rows are counted by bin only where the best split of all would leave fewer than ``least`` on a side."""
        lg, lh = np.cumsum(histogram[1:], axis=2)[:, :, :-1]
        gain = lg**2 / (lh + self.l2) + (sums[0] - lg) ** 2 / (sums[1] - lh + self.l2) - sums[0] ** 2 / (sums[1] + self.l2)
        f, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        left = np.count_nonzero(b[0][f][rows] <= j)
        if not self.least <= left <= len(rows) - self.least and gain[f, j] > 1e-12:
            n = np.cumsum(self._histogram(b, g, h, rows)[0], axis=1)[:, :-1]
            gain[(n < self.least) | (len(rows) - n < self.least)] = 0
            f, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (float(gain[f, j]), int(f), int(j)) if gain[f, j] > 1e-12 else (1e-12, -1, -1)

    def _grow(self, b, g, h):
        """Leaf by leaf, the best gain first: nodes (feature, bin, left, right) or a leaf number.

        Of two children the smaller one is counted, the other's histogram is their parent's less that."""
        nodes, leaf_rows, depth, sums = [None], {0: np.arange(len(g))}, {0: 0}, {0: (g.sum(), h.sum())}
        histograms = {0: self._histogram(b, g, h, slice(None), False)}
        options = {0: self._split(b, g, h, leaf_rows[0], histograms[0], sums[0])}
        while len(leaf_rows) < self.leaves:
            node = max(options, key=lambda k: options[k][0], default=None)
            if node is None or options[node][1] < 0:
                break
            _, f, j = options.pop(node)
            rows, whole = leaf_rows.pop(node), histograms.pop(node)
            left = b[0][f][rows] <= j
            kids = (len(nodes), len(nodes) + 1)
            nodes[node] = (f, j, *kids)
            parts = (rows[np.flatnonzero(left)], rows[np.flatnonzero(~left)])
            for kid, part in zip(kids, parts):
                nodes.append(None)
                leaf_rows[kid], depth[kid] = part, depth[node] + 1
            if depth[node] + 1 < self.depth:
                small = int(len(parts[1]) < len(parts[0]))
                counted = self._histogram(b, g, h, parts[small], False)
                for kid, part, found in ((kids[small], parts[small], counted), (kids[1 - small], parts[1 - small], whole - counted)):
                    histograms[kid], sums[kid] = found, tuple(found[1:, 0].sum(axis=1))
                    options[kid] = self._split(b, g, h, part, found, sums[kid])
            else:
                sums |= {kid: (g[part].sum(), h[part].sum()) for kid, part in zip(kids, parts)}
        values, leaf_of = np.zeros(len(nodes)), np.zeros(len(g), np.int32)
        for node, rows in leaf_rows.items():
            values[node] = -self.rate * sums[node][0] / (sums[node][1] + self.l2)
            leaf_of[rows] = node
        return nodes, leaf_of, values

    def predict(self, b: np.ndarray) -> np.ndarray:
        score, rows = np.full(b.shape[1], self.start), np.arange(b.shape[1])
        for nodes, values in self.model:
            f, j, left, right = np.array([(0, self.bins, i, i) if node is None else node for i, node in enumerate(nodes)]).T  # a leaf leads to itself
            at = np.zeros(len(rows), int)
            for _ in range(self.depth):
                at = np.where(b[f[at], rows] <= j[at], left[at], right[at])
            score += values[at]
        return sigmoid(score)


def tree_losses(blocks: DataFrame, width: int, probes: list[Probe], folds: list[Fold], settings: dict | None = None) -> DataFrame:
    """As ``fold_losses``, for boosted trees.

    A fold's training sample goes to one task as bins of a byte each (the sample is capped by series), and
    only its trees, some kilobytes, come back; prediction reads the points where they are.
    """
    spark, settings = blocks.sparkSession, settings or TREES
    names = F.broadcast(spark.createDataFrame([(k, g) for k, f in enumerate(folds) for g in f.held], f"fold int, held {dict(blocks.dtypes)['g']}"))
    numbers = F.broadcast(spark.createDataFrame([(k,) for k in range(len(folds))], "fold int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _, x, y, w in _opened(batches, width):
            used = w > 0
            if used.any():
                cols = [pa.array([g], kind), *(pa.array([v.tobytes()], pa.binary()) for v in (Trees(**settings).binned(x[used]), y[used], w[used]))]
                yield pa.RecordBatch.from_arrays(cols, ["g", "x", "y", "w"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, w = (np.concatenate([np.frombuffer(v, float) for v in pdf[c]]) for c in ("y", "w"))
        b = np.concatenate([np.frombuffer(v, np.uint8).reshape(width, -1) for v in pdf["x"]], axis=1)
        models = []
        for p in probes:
            model = Trees(**settings).fit(np.ascontiguousarray(b[list(p.columns)]), y, w * len(w) / w.sum())
            models.append((model.start, model.model))
        return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "model": [pickle.dumps(models)]})

    kind = to_arrow_schema(blocks.select("g").schema).field("g").type
    sample = blocks.select(*FIELDS).mapInArrow(cut, f"g {dict(blocks.dtypes)['g']}, x binary, y binary, w binary")
    n = len(folds)
    slots = spark.range(100 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).cast("int").alias("fold")).agg(F.min("id").alias("slot"))  # dealt by these, each fold has a task of its own
    numbers = F.broadcast(numbers.join(slots, "fold"))
    copies = sample.crossJoin(numbers).join(names.withColumnRenamed("fold", "k"), (F.col("g") == F.col("held")) & (F.col("fold") == F.col("k")), "left_anti")
    fitted = {r["fold"]: pickle.loads(r["model"]) for r in copies.repartition(n, "slot").groupBy("slot").applyInPandas(run, "fold int, model binary").collect()}  # one for each fold
    sent = spark.sparkContext.broadcast(fitted)

    def predicted(models, x, k):
        b = Trees(**settings).binned(x)
        for (start, trees), p in zip(models[k], probes):
            model = Trees(**settings)
            model.start, model.model = start, trees
            yield model.predict(b[list(p.columns)])

    return _scored(blocks, width, probes, folds, sent, predicted)


def grouped_folds(sources: list, k: int = 5, seed: int = 2024) -> list[list]:
    """k blocks of permuted sources, near-equal."""
    if len(sources) < k:
        raise ValueError(f"{k} folds need as many sources")
    order = np.random.default_rng(seed).permutation(sorted(sources))
    return [sorted(x.tolist()) for x in np.array_split(order, k)]


def select_c(inner: DataFrame) -> DataFrame:
    """(fold, c) of the smallest mean inner loss, the smaller c on ties; ``inner``: (fold, c, source_id, series_id, loss)."""
    by_source = inner.groupBy("fold", "c", "source_id").agg(F.avg("loss").alias("loss"))
    return by_source.groupBy("fold", "c").agg(F.avg("loss").alias("loss")).groupBy("fold").agg(F.min_by("c", F.struct("loss", "c")).alias("c"))
