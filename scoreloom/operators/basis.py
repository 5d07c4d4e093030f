"""The statistical reference: 31 windowed features of a series, as window expressions and as one array kernel.

The window form runs in the JVM and serves queries of a few features; all features of one
series order share one sort. The kernel computes all 31 curves of a series in one pass over
its array and serves the learned probes. Both fill the edges with the nearest valid value.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

#: Families and widths.
WIDTHS = {
    "Var": (8, 16, 32, 64, 96, 128, 256),
    "Range": (8, 16, 32, 64, 96, 128, 256),
    "Last": (1, 2, 3, 8, 16, 32, 64),
    "Centered": (3, 16, 64),
    "AbsDiff": (1, 4, 16),
    "MAD": (32, 128),
    "SpecEnt": (64, 256),
}
NAMES = tuple(f"{family}-{w}" for family, widths in WIDTHS.items() for w in widths)
#: Cumulative reference strengths and removable families.
STRENGTHS = {
    "variance": ("Var",),
    "variance_range": ("Var", "Range"),
    "local_deviation": ("Var", "Range", "Last", "Centered"),
    "dispersion_change": ("Var", "Range", "Last", "Centered", "AbsDiff", "MAD"),
}
FAMILIES = {
    "variance": "Var", "range": "Range", "next_difference": "Last", "centered_placement": "Centered",
    "absolute_difference": "AbsDiff", "mad": "MAD", "spectral_entropy": "SpecEnt",
}


def family_of(name: str) -> str:
    return name.split("-")[0]


def columns_of(families, names: tuple[str, ...] = NAMES) -> tuple[int, ...]:
    """Places of the curves of some families; an empty choice, or one that leaves nothing out, is an error."""
    chosen = tuple(i for i, n in enumerate(names) if family_of(n) in set(families))
    if not 0 < len(chosen) < len(names):
        raise ValueError(f"families {sorted(families)} name nothing or everything")
    return chosen


def without_family(names: tuple[str, ...], family: str) -> list[str]:
    return [names[i] for i in columns_of({family_of(n) for n in names} - {FAMILIES[family]}, names)]


def of_strength(names: tuple[str, ...], strength: str) -> list[str]:
    return [names[i] for i in columns_of(STRENGTHS[strength], names)]


def series_window(series: str = "series_id", order: str = "t") -> WindowSpec:
    return Window.partitionBy(series).orderBy(order)


def _full(value: Column, w: int, frame: WindowSpec) -> Column:
    """``value`` where its frame holds ``w`` points."""
    return F.when(F.count(F.lit(1)).over(frame) == w, value)


def centred_frame(w: int, order: WindowSpec) -> WindowSpec:
    """The window of width w that a value at i + w // 2 belongs to."""
    return order.rowsBetween(-(w // 2), w - 1 - w // 2)


def raw_feature(name: str, x: str = "x", order: WindowSpec | None = None) -> Column:
    """A feature as a window expression; null where the window is not full. Not for SpecEnt, Centered and MAD."""
    order = order or series_window()
    family, w = family_of(name), int(name.split("-")[1])
    frame = centred_frame(w, order)
    if family == "Var":
        return _full(F.var_pop(x).over(frame), w, frame)
    if family == "Range":
        return _full(F.max(x).over(frame) - F.min(x).over(frame), w, frame)
    if family == "Last":
        before = order.rowsBetween(-w, -1)
        return _full(F.pow(F.avg(x).over(before) - F.col(x), F.lit(2)), w, before)
    if family == "AbsDiff":
        step = F.abs(F.col(x) - F.lag(x).over(order))
        return step
    raise ValueError(f"no window form of {name}")


def with_feature(points: DataFrame, name: str, x: str = "x", filled: bool = True) -> DataFrame:
    """``points`` with one feature as column ``name``, edges filled with the nearest valid value."""
    order = series_window()
    family, w = family_of(name), int(name.split("-")[1])
    if family == "Centered":  # the error of the next point, placed in the window's middle
        rows = points.withColumn("__f", raw_feature(f"Last-{w}", x, order))
        rows = rows.withColumn(name, F.lead("__f", w - w // 2).over(order)).drop("__f")
    elif family == "AbsDiff" and w > 1:
        rows = points.withColumn("__f", raw_feature("AbsDiff-1", x, order))
        same = order.rowsBetween(-(w // 2), (w - 1) // 2)
        rows = rows.withColumn(name, F.when(F.col("__f").isNotNull(), F.sum("__f").over(same) / w)).drop("__f")
    elif family == "MAD":
        rows = with_mad(points, name, x, w)
    else:
        rows = points.withColumn(name, raw_feature(name, x, order))
    return edge_filled(rows, name) if filled else rows


def with_mad(points: DataFrame, name: str, x: str, w: int) -> DataFrame:
    """``points`` with the MAD of each full window: a task reads its series in order, batch by batch, and holds a window's rows over."""
    if name in points.columns:
        raise ValueError(f"there is a column {name} already")
    rows = points.repartition("series_id").sortWithinPartitions("series_id", "t")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
    ahead = w - 1 - w // 2  # points of a window behind its own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0  # rows that a window yet needs, of which the first ``before`` were given out
        for batch in itertools.chain(batches, [None]):
            if batch is None and held is None:
                return
            table = held if batch is None else pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            n = table.num_rows
            mad, valid = np.zeros(n), np.zeros(n, bool)
            if n >= w:
                key = table["series_id"].combine_chunks()
                new = np.concatenate([[True], ~pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)])
                run_of = np.cumsum(new)
                values = table[x].combine_chunks()
                odd = ~pc.fill_null(pc.is_finite(values.cast(pa.float64())), False).to_numpy(zero_copy_only=False)
                mad[w // 2 : n - ahead] = sliding_mad(np.where(odd, 0.0, values.cast(pa.float64()).to_numpy(zero_copy_only=False)), w)
                valid[w // 2 : n - ahead] = run_of[: n - w + 1] == run_of[w - 1 :]
                upto = np.concatenate([[0], np.cumsum(odd)])
                for at in np.flatnonzero(valid[w // 2 : n - ahead] & (upto[w:] > upto[:-w])):  # as in SQL, null is no value and NaN the greatest
                    some = values[at : at + w].drop_null().cast(pa.float64()).to_numpy()
                    valid[at + w // 2] = len(some) > 0
                    middle = lambda v: 0.5 * (v[(len(v) - 1) // 2] + v[len(v) // 2])
                    with np.errstate(invalid="ignore"):
                        mad[at + w // 2] = middle(np.sort(np.abs(some - middle(np.sort(some))))) if len(some) else 0.0
            done = n if batch is None else max(before, n - ahead)  # the rest waits for the next batch
            out = table.slice(before, done - before).append_column(name, pa.array(mad[before:done], mask=~valid[before:done]))
            yield from out.to_batches()
            keep = max(0, done - w // 2)
            held, before = table.slice(keep), done - keep

    return rows.mapInArrow(run, schema)


def edge_filled(rows: DataFrame, name: str) -> DataFrame:
    # running values from either end: a frame that reaches to the last row would read the rest of a series anew for each point
    sofar = (Window.unboundedPreceding, 0)
    back = F.last(name, ignorenulls=True).over(series_window().rowsBetween(*sofar))
    ahead = F.last(name, ignorenulls=True).over(Window.partitionBy("series_id").orderBy(F.desc("t")).rowsBetween(*sofar))
    return rows.withColumn(name, F.coalesce(back, ahead, F.lit(0.0)))


# The array kernel ----------------------------------------------------------------------------------------------------


def _placed(values: np.ndarray, at: int, n: int) -> np.ndarray:
    out = np.empty(n)
    if not len(values):
        return np.zeros(n)
    out[:at], out[at : at + len(values)], out[at + len(values) :] = values[0], values, values[-1]
    return out


def sliding_mad(x: np.ndarray, w: int) -> np.ndarray:
    """The median distance from the median of each window of ``w`` points.

    The k + 1 values nearest to a median stand side by side in a sorted window, so the k-th distance is the least, over their
    first place, of the greater distance at their ends: one of these falls and the other rises, which leaves a search by halves.
    """
    out = np.empty(max(0, len(x) - w + 1))
    view = np.lib.stride_tricks.sliding_window_view(x, w) if len(out) else out
    for a in range(0, len(out), 4096):  # bounds the copies of windows held at a time
        s = np.sort(view[a : a + 4096], axis=1)
        middle, row, found = 0.5 * (s[:, (w - 1) // 2] + s[:, w // 2]), np.arange(len(s)) * w, []
        flat = s.ravel()
        for k in sorted({(w - 1) // 2, w // 2}):
            low, high = row.copy(), row + (w - 1 - k)  # the first place where the right end is as far as the left, or the last
            for _ in range((w - 1 - k).bit_length()):
                half = (low + high) // 2
                far = flat[half + k] - middle >= middle - flat[half]
                high = np.where(far, half, high)
                low = np.where(far, low, np.minimum(half + 1, high))
            here = np.maximum(middle - flat[low], flat[low + k] - middle)
            before = np.maximum(low - 1, row)
            found.append(np.minimum(here, np.maximum(middle - flat[before], flat[before + k] - middle)))
        out[a : a + 4096] = 0.5 * (found[0] + found[-1])
    if not np.isfinite(x).all():  # distances of what isn't finite have no order
        with np.errstate(invalid="ignore"):
            for i in np.flatnonzero(~np.isfinite(view).all(axis=1)) if len(out) else ():
                out[i] = np.median(np.abs(view[i] - np.median(view[i])))
    return out


def sliding_range(x: np.ndarray, w: int, known: dict) -> np.ndarray:
    """Greatest less least value of each window; ``known`` keeps the extremes of halved windows from one width to the next."""

    def extremes(k: int) -> tuple:
        if k not in known:
            half = 1 << (k - 1).bit_length() - 1 if k > 1 else 0
            known[k] = (x, x) if k == 1 else tuple(f(e[: len(e) - (k - half)], e[k - half :]) for f, e in zip((np.maximum, np.minimum), extremes(half)))
        return known[k]

    most, least = extremes(w)
    return most - least


def basis_matrix(x: np.ndarray, names: tuple[str, ...] = NAMES) -> np.ndarray:
    """All curves of one series, one column each."""
    x = np.asarray(x, float)
    n, cols, errors, extremes = len(x), [], {}, {}
    view = np.lib.stride_tricks.sliding_window_view
    for name in names:
        family, w = family_of(name), int(name.split("-")[1])
        if family in ("Last", "Centered"):
            if w not in errors:
                errors[w] = (view(x, w)[:-1].mean(axis=1) - x[w:]) ** 2 if n > w else np.zeros(0)
            cols.append(_placed(errors[w], w if family == "Last" else w // 2, n))
        elif family == "AbsDiff":
            d = np.abs(np.diff(x))
            if w > 1 and len(d):
                d = np.convolve(d, np.full(w, 1 / w), "full")[(w - 1) // 2 :][: len(d)]
            cols.append(_placed(d, 1, n))
        elif n < w:
            cols.append(np.zeros(n))
        elif family == "Var":
            cols.append(_placed(view(x, w).var(axis=1), w // 2, n))
        elif family == "Range":
            cols.append(_placed(sliding_range(x, w, extremes), w // 2, n))
        elif family == "MAD":
            cols.append(_placed(sliding_mad(x, w), w // 2, n))
        else:
            starts = np.arange(0, n - w + 1, max(1, w // 8))
            v = view(x, w)[starts]
            power = np.abs(np.fft.rfft(v - v.mean(axis=1)[:, None], axis=1)) ** 2
            total = power.sum(axis=1)
            p = power / np.where(total > 0, total, 1)[:, None]
            entropy = -np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(axis=1)
            cols.append(np.interp(np.arange(n), starts + w // 2, np.where(total > 0, entropy, 0)))
    return np.column_stack(cols) if cols else np.zeros((n, 0))


def ranks01(values: np.ndarray) -> np.ndarray:
    """(average rank - 1/2) / n."""
    return column_ranks01(np.asarray(values).reshape(-1, 1))[:, 0]


def column_ranks01(values: np.ndarray) -> np.ndarray:
    """``ranks01`` of each column, all sorted together."""
    n, c = values.shape
    rows = np.ascontiguousarray(values.T)
    order = np.argsort(rows, axis=1)
    s = np.take_along_axis(rows, order, 1)
    new = np.ones((c, n), bool)
    new[:, 1:] = (s[:, 1:] != s[:, :-1]) & ((s[:, 1:] == s[:, 1:]) | (s[:, :-1] == s[:, :-1]))  # all NaN are one value
    starts = np.flatnonzero(new)
    counts = np.diff(starts, append=c * n)
    first = starts % max(n, 1)
    out = np.empty((c, n))
    np.put_along_axis(out, order, np.repeat(((first + 1 + first + counts) / 2 - 0.5) / max(n, 1), counts).reshape(c, n), 1)
    return np.ascontiguousarray(out.T)


def ranked_basis(points: DataFrame, names: tuple[str, ...] = NAMES, keep: tuple[str, ...] = ("source_id", "y"), raw: bool = False) -> DataFrame:
    """(series_id, t, *keep, basis array<double>): ranked features, one series at a time on Arrow batches."""
    kinds = dict(points.dtypes)
    columns = ["series_id", "t", *keep]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        m = basis_matrix(pdf["x"].to_numpy(), names)
        if not raw:
            m = column_ranks01(m)
        return pdf[columns].assign(basis=list(m))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "basis array<double>"])
    return points.select("x", *columns).groupBy("series_id").applyInPandas(run, schema)
