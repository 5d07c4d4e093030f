"""Causal features of series that arrive as a stream: the next-point error of the points before.

The state of a series is its last ``width`` values and the position reached, so it does not
grow with the stream; points of one batch are put in order of ``t``. Points that come after
a later one of their series has been scored are late and are dropped, as an event-time
order demands. Centred features need future points and have no streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "series_id long, t long, x double, last double, step double"


def causal_features(stream: DataFrame, width: int = 8) -> DataFrame:
    """(series_id, t, x, last, step): squared distance from the mean of ``width`` points before, and from the point before.

    Both are null until enough points have come.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, seen = state.get if state.exists else (-1, [])
        seen = list(seen)
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        out = []
        for t, x in zip(rows["t"], rows["x"]):
            if t <= at:
                continue
            mean = (np.mean(seen[-width:]) - x) ** 2 if len(seen) >= width else None
            out.append((key[0], int(t), float(x), mean, abs(x - seen[-1]) if seen else None))
            seen, at = [*seen[-width + 1 :], float(x)] if width > 1 else [float(x)], int(t)
        state.update((at, seen))
        yield pd.DataFrame(out, columns=["series_id", "t", "x", "last", "step"]).astype({"last": float, "step": float})

    return (
        stream.selectExpr("cast(series_id as long) series_id", "cast(t as long) t", "cast(x as double) x")
        .groupBy("series_id")
        .applyInPandasWithState(run, OUTPUT, "at long, seen array<double>", "append", GroupStateTimeout.NoTimeout)
    )
