"""Recurrences along a series that no bounded window can express: one pass over each series' arrays.

Work grows linearly with a series' length; series are independent groups. The array functions take and give
NumPy arrays with NaN for missing; the frame functions put them on a long frame, with NULL for missing.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEED_BARS = 50


def ewma_variance(r: np.ndarray, halflife: float) -> np.ndarray:
    """Exponentially weighted mean of r squared; the start is the mean over the first bars after bar 0."""
    n = len(r)
    if n < 2:
        return np.full(n, np.nan)
    keep = 0.5 ** (1 / halflife)
    v = float(np.mean(r[1 : min(n, SEED_BARS)] ** 2))
    out = np.empty(n)
    for t, x in enumerate((1 - keep) * r * r):
        v = keep * v + x
        out[t] = v
    return out


def wilder_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running mean, started by the plain mean of the first n values; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    v = float(np.mean(x[:n]))
    out[n - 1] = v
    for t in range(n, len(x)):
        v = (v * (n - 1) + x[t]) / n
        out[t] = v
    return out


def garch_variance(r: np.ndarray, omega: float, alpha: float, beta: float, start_variance: float, start: int = 0) -> tuple[np.ndarray, float]:
    """Next bar's variance after each bar, and the Gaussian log likelihood of the bars from ``start`` on."""
    v, path = start_variance, [start_variance]
    for x in (omega + alpha * r * r).tolist():
        v = x + beta * v
        path.append(v)
    path = np.array(path)
    before, later = path[start:-1], r[start:]
    return path[1:], float(-0.5 * np.sum(np.log(2 * np.pi) + np.log(before) + later * later / before))


def hawkes_probability(event: np.ndarray, mu: float, alpha: float, beta: float, h: int) -> np.ndarray:
    """Chance of an event within h bars under a self-exciting intensity that decays exponentially."""
    out, s, keep = np.empty(len(event)), 0.0, np.exp(-beta)
    for t, e in enumerate(event):
        s = s * keep + (1.0 if e else 0.0)
        out[t] = 1 - np.exp(-(mu * h + alpha * s * (1 - np.exp(-beta * h))))
    return out


def hawkes_loglik(times: np.ndarray, end: float, mu: float, alpha: float, beta: float) -> float:
    """Log likelihood of sorted event times on (0, end]; linear in their number."""
    if not len(times):
        return -mu * end
    s, path = 0.0, [0.0]
    for keep in np.exp(-beta * np.diff(times)).tolist():
        s = (s + 1) * keep
        path.append(s)
    return float(-mu * end + np.sum(np.log(mu + alpha * beta * np.array(path))) - alpha * np.sum(1 - np.exp(-beta * (end - times))))


def sticky_weight(raw: np.ndarray, band: float, start: float = 0.0) -> np.ndarray:
    """Holds a weight until the wanted one is more than ``band`` away."""
    out, now = np.empty(len(raw)), start
    for t, x in enumerate(raw):
        if abs(x - now) > band:
            now = x
        out[t] = now
    return out


def expanding_tail(z: np.ndarray, start: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """From ``start`` on: quantile of all finite values so far and the mean of those at or below it.

    Values are kept in order; the sum of the lowest ones follows the quantile as it moves, a few places a bar."""
    seen: list[float] = []
    low, n_low = 0.0, 0  # of the n_low lowest values
    q, es = np.full(len(z), np.nan), np.full(len(z), np.nan)
    for t, x in enumerate(z.tolist()):
        if t < start:
            continue
        if math.isfinite(x):
            at = bisect_right(seen, x)
            seen.insert(at, x)
            if at < n_low:
                low, n_low = low + x, n_low + 1
        if not seen:
            continue
        place = alpha * (len(seen) - 1)
        lo = int(place)
        under, share = seen[lo], place - lo
        over = seen[min(lo + 1, len(seen) - 1)]
        q[t] = under + (over - under) * share if share < 0.5 else over - (over - under) * (1 - share)
        wanted = bisect_right(seen, q[t])
        while n_low < wanted:
            low, n_low = low + seen[n_low], n_low + 1
        while n_low > wanted:
            low, n_low = low - seen[n_low - 1], n_low - 1
        es[t] = low / n_low if n_low else q[t]
    return q, es


def rolling_tail(r: np.ndarray, n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    q, es = np.full(len(r), np.nan), np.full(len(r), np.nan)
    for t in range(n - 1, len(r)):
        q[t], es[t] = tail_of_sorted(np.sort(r[t - n + 1 : t + 1]), alpha)
    return q, es


def tail_of_sorted(x: np.ndarray, alpha: float) -> tuple[float, float]:
    q = float(np.quantile(x, alpha))
    return q, float(np.mean(x[x <= q])) if (x <= q).any() else q


def along_series(df: DataFrame, add: dict[str, str], f: Callable[[pd.DataFrame], dict[str, np.ndarray]], key: str = "series_id", order: str = "t") -> DataFrame:
    """df with the columns that f makes from each series' rows in order."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T._parse_datatype_string(t)) for c, t in add.items())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**f(pdf))

    return df.groupBy(key).applyInPandas(run, schema)


def with_ewma(df: DataFrame, halflife: float, out: str = "sigma", r: str = "r") -> DataFrame:
    return along_series(df, {out: "double"}, lambda p: {out: np.sqrt(ewma_variance(p[r].to_numpy(float), halflife))})


def with_atr(df: DataFrame, n: int, tr: str = "tr", out: str = "atr") -> DataFrame:
    return along_series(df, {out: "double"}, lambda p: {out: wilder_mean(p[tr].to_numpy(float), n)})


def with_features(df: DataFrame, halflife: float, atr_len: int) -> DataFrame:
    """sigma and atr in one pass, from columns r and tr."""
    return along_series(df, {"sigma": "double", "atr": "double"}, lambda p: {"sigma": np.sqrt(ewma_variance(p["r"].to_numpy(float), halflife)), "atr": wilder_mean(p["tr"].to_numpy(float), atr_len)})
