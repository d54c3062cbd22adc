"""Streaming form of the running baselines: one state row of moments per (key, variable)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.baseline import ALPHA, FLOOR

OUT = "variable string, seq long, value double, n long, mu double, sigma double, ema double, z double"
STATE = "n long, mu double, m2 double, ema double"


def absorb(state: tuple[int, float, float, float], x: float) -> tuple[tuple[int, float, float, float], float, float]:
    """(new state, sigma, z) after one value: Welford's update, then the score."""
    n, mu, m2, ema = state
    n += 1
    d = x - mu
    mu += d / n
    m2 += d * (x - mu)
    ema = ALPHA * x + (1 - ALPHA) * ema
    sigma = 1.0 if n < 2 else math.sqrt(max(m2 / (n - 1), FLOOR))
    return (n, mu, m2, ema), sigma, x if n < 2 else (x - mu) / sigma


def absorb_all(state: tuple[int, float, float, float], xs: np.ndarray) -> tuple[tuple[int, float, float, float], np.ndarray]:
    """`absorb` for many values in order: (new state, rows of n, mu, sigma, ema, z). Sums are taken about the old mean."""
    n, mu, m2, ema = state
    d = xs - mu if n else xs - xs[0]
    base = mu if n else xs[0]
    count = n + np.arange(1, len(xs) + 1)
    total = np.cumsum(d)
    square = np.maximum(m2 + np.cumsum(d * d) - total * total / count, 0.0)
    mean = base + total / count
    sigma = np.where(count < 2, 1.0, np.sqrt(np.maximum(square / np.maximum(1, count - 1), FLOOR)))
    smooth = np.empty(len(xs))
    for k, x in enumerate(xs.tolist()):
        ema = ALPHA * x + (1 - ALPHA) * ema
        smooth[k] = ema
    z = np.where(count < 2, xs, (xs - mean) / sigma)
    return (int(count[-1]), float(mean[-1]), float(square[-1]), float(ema)), np.stack([count, mean, sigma, smooth, z], 1)


def running(stream: DataFrame) -> DataFrame:
    """variable, seq, value -> the same with n, mu, sigma, ema and z; rows of one batch are taken in the order of seq."""

    def update(key: tuple[str], parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = group.get if group.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(parts)).dropna(subset=["value"]).sort_values("seq")
        if len(rows):
            state, out = absorb_all(tuple(state), rows["value"].to_numpy(dtype=float))
            yield pd.DataFrame({"variable": key[0], "seq": rows["seq"].to_numpy(), "value": rows["value"].to_numpy(), "n": out[:, 0].astype(int), "mu": out[:, 1], "sigma": out[:, 2], "ema": out[:, 3], "z": out[:, 4]})
        group.update(state)

    return stream.select("variable", "seq", "value").groupBy("variable").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
