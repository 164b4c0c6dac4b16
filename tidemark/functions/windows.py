"""Window expressions over bars: one long frame of many series, ``series_id`` and the bar's ordinal ``t``.

Missing is NULL. A window that is not complete, or that holds a missing value, is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SERIES = "series_id"


def ordered():
    return Window.partitionBy(SERIES).orderBy("t")


def trailing(n: int, lag: int = 0):
    """The n rows that end ``lag`` rows before this one."""
    return ordered().rowsBetween(-n + 1 - lag, -lag)


def forward(n: int):
    """The n rows after this one."""
    return ordered().rowsBetween(1, n)


def upto():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def complete(value: Column, x: Column, w, n: int) -> Column:
    return F.when(F.count(x).over(w) == n, value)


def log_return(close: Column) -> Column:
    return F.coalesce(F.log(close / F.lag(close).over(ordered())), F.lit(0.0))


def rolling_sum(x: Column, n: int, lag: int = 0) -> Column:
    return complete(F.sum(x).over(trailing(n, lag)), x, trailing(n, lag), n)


def sma(x: Column, n: int, lag: int = 0) -> Column:
    return complete(F.avg(x).over(trailing(n, lag)), x, trailing(n, lag), n)


def forward_mean(x: Column, n: int) -> Column:
    return complete(F.avg(x).over(forward(n)), x, forward(n), n)


def stdev(x: Column, n: int) -> Column:
    """Population standard deviation, clamped at 0."""
    mean, square = F.avg(x).over(trailing(n)), F.avg(x * x).over(trailing(n))
    return complete(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))), x, trailing(n), n)


def regime(atr: Column, n: int) -> Column:
    """1 where the true range is above its own mean; a missing one counts as 0."""
    return F.coalesce(atr > sma(atr, n), F.lit(False)).cast("tinyint")


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    span = F.col("high") - F.col("low")
    return F.when(before.isNull(), span).otherwise(F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def return_embedding(r: Column, sigma: Column, w: int, m: int, normalize: bool = True, digits: int | None = None) -> Column:
    """m sums of w/m returns, the oldest first; NULL before the first w returns (the return of bar 0 is none)."""
    if w % m:
        raise ValueError("w must be a multiple of m")
    g = w // m
    parts = [F.sum(r).over(trailing(g, (m - 1 - q) * g)) for q in range(m)]
    if normalize:
        parts = [p / (sigma * F.sqrt(F.lit(float(g)))) for p in parts]
    if digits is not None:
        parts = [F.round(p, digits) for p in parts]
    return F.when(F.col("t") >= w, F.array(*parts))


def floored(x: Column, floor: Column) -> Column:
    """x, but no less than the floor; NULL stays NULL, which greatest alone would take for the floor."""
    return F.when(x.isNotNull(), F.greatest(x, floor))


def shape_embedding(variance: Column, long: Column, h: int, m: int, floor: Column, digits: int | None = None) -> Column:
    """log of the mean variance over m spans of h bars, the oldest first, less the log of the long run."""
    parts = [F.log(floored(sma(variance, h, q * h), floor)) - F.log(long) for q in range(m - 1, -1, -1)]
    if digits is not None:
        parts = [F.round(p, digits) for p in parts]
    out = F.array(*parts)
    return F.when(F.forall(out, lambda v: v.isNotNull()), out)


def jump(r: Column, sigma: Column, c: float) -> Column:
    return F.coalesce(F.abs(r) > c * F.lag(sigma).over(ordered()), F.lit(False))


def poisson_probability(event: Column, h: int, n: int) -> Column:
    """Chance of an event within h bars at the rate of the last n."""
    rate = rolling_sum(event.cast("double"), n) / n
    return 1 - F.exp(-rate * h)


def transitions(df: DataFrame, state: str = "state") -> DataFrame:
    """Running counts c00, c01, c10, c11 of the transitions up to each row."""
    before = F.lag(state).over(ordered())
    steps = {f"c{a}{b}": F.sum(F.when((before == a) & (F.col(state) == b), 1).otherwise(0)).over(upto()).cast("long") for a in (0, 1) for b in (0, 1)}
    return df.withColumns(steps)


def markov_high(df: DataFrame, h: int, lookback: int | None = None, state: str = "state") -> DataFrame:
    """``pi_high``: expected share of the next h bars in state 1, from transition counts up to each row.

    A finite lookback counts lookback + 1 transitions.
    """
    counted = transitions(df, state)
    if lookback is not None:
        w = ordered()
        back = {c: F.col(c) - F.coalesce(F.lag(c, lookback + 1).over(w), F.lit(0)) for c in ("c00", "c01", "c10", "c11")}
        counted = counted.withColumns(back)
    a = F.when(F.col("c00") + F.col("c01") > 0, F.col("c01") / (F.col("c00") + F.col("c01"))).otherwise(0.0)
    b = F.when(F.col("c10") + F.col("c11") > 0, F.col("c10") / (F.col("c10") + F.col("c11"))).otherwise(0.0)
    s0 = F.col(state).cast("double")
    q, decay = a / (a + b), 1 - a - b
    powers = F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.lit(0.0), lambda acc, k: acc + F.pow(decay, k))
    return counted.withColumn("pi_high", F.when(a + b > 0, q + (s0 - q) * powers / h).otherwise(s0))
