"""Forecasts by analogy: for every bar, the nearest past states and what followed them.

A candidate for bar t is an earlier bar j of the same series, at most t - delay (so that what followed it is
known at t) and at least t - lookback, whose embedding and targets are complete. With ``bandwidth`` 0 the k
nearest are taken per regime in order of (distance, j), each at least ``exclusion`` bars from every one taken
before, of either regime; a regime that is full neither takes nor blocks. With a bandwidth, all candidates
weigh in by a Gaussian kernel. Regimes are mixed by the expected share of the horizon spent in each.

The self-join is cut into blocks: bars are dealt by ``t div block`` and the history that a block can use is
sent to it once, so no task holds more than a block of bars and one series' history. Inside a block NumPy
does the distances and the order-dependent choice. Wide states are not copied to blocks: see ``tiles``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.windows import markov_high

from . import tiles

UNLIMITED = 1_000_000_000
#: Exponents beyond this add nothing to a kernel sum.
CUT = 30.0


@dataclass(frozen=True)
class Engine:
    k: int = 20
    k_min: int = 5
    exclusion: int = 24
    delay: int = 24
    warmup: int = 0
    lookback: int = UNLIMITED
    first: int = 0  # no anchor before this bar
    regime: bool = True
    horizon: int = 24
    bandwidth: float = 0.0
    kernel_block: int = 0
    block: int = 1024


def check_exclusion(k: int, regime: bool, exclusion: int, history: int) -> None:
    """An exclusion zone that swallows a quarter of the history leaves nothing to choose from."""
    if (2 if regime else 1) * k * max(exclusion, 1) > history / 4:
        raise ValueError(f"{k} analogues at a distance of {exclusion} need more than a quarter of {history} bars")


def greedy(order: np.ndarray, anchors: np.ndarray, states: np.ndarray, groups: int, k: int, exclusion: int) -> list[list[int]]:
    """Positions chosen per group, walking ``order``."""
    taken: list[list[int]] = [[] for _ in range(groups)]
    # cells of the zone's width: a conflict can only be in a bar's own cell or the next ones
    placed: dict[int, list[int]] = {}
    full = 0
    for i in order:
        g = int(states[i]) if groups == 2 else 0
        if len(taken[g]) == k:
            continue
        j = int(anchors[i])
        if exclusion > 0:
            cell = j // exclusion
            if any(abs(j - a) < exclusion for c in (cell - 1, cell, cell + 1) for a in placed.get(c, ())):
                continue
            placed.setdefault(cell, []).append(j)
        taken[g].append(int(i))
        if len(taken[g]) == k:
            full += 1
            if full == groups:
                break
    return taken


def nearest(distance: np.ndarray, anchors: np.ndarray, states: np.ndarray, e: Engine) -> list[list[int]]:
    groups = 2 if e.regime else 1
    head = 16 * groups * e.k
    while head < len(distance):
        # all that tie with the farthest of the head belong to it, so the walk is that of a full sort
        some = np.flatnonzero(distance <= np.partition(distance, head)[head])
        taken = greedy(some[np.lexsort((anchors[some], distance[some]))], anchors, states, groups, e.k, e.exclusion)
        if all(len(t) == e.k for t in taken):
            return taken
        head *= 8
    return greedy(np.lexsort((anchors, distance)), anchors, states, groups, e.k, e.exclusion)


def group_weights(sizes: Sequence[float], pi: float, e: Engine) -> np.ndarray | None:
    w = np.array([1 - pi, pi]) if e.regime else np.ones(1)
    w = np.where(np.array(sizes) >= max(e.k_min, 2), w, 0.0)
    return w / w.sum() if w.sum() > 0 else None


def _neighbour_forecast(y: np.ndarray, taken: list[list[int]], pi: float, e: Engine):
    sizes = [len(t) for t in taken]
    w = group_weights(sizes, pi, e)
    if w is None:
        return None
    mean, var = np.zeros(y.shape[1]), np.zeros(y.shape[1])
    for t, x in zip(taken, w, strict=True):
        if x > 0:
            part = y[t]
            mean += x * part.mean(axis=0)
            var += x * x * part.var(axis=0, ddof=1) / len(t)
    return mean, np.sqrt(var), float(sum(sizes))


def _kernel_forecast(distance: np.ndarray, anchors: np.ndarray, states: np.ndarray, y: np.ndarray, pi: float, e: Engine):
    z = (distance - distance.min()) / (2 * e.bandwidth**2)
    weight = np.where(z <= CUT, np.exp(-z), 0.0)
    groups = 2 if e.regime else 1
    sums, effective = [], []
    for g in range(groups):
        at = (weight > 0) & ((states == g) if groups == 2 else True)
        x = weight[at]
        total = x.sum()
        if not total:
            sums.append(None)
            effective.append(0.0)
            continue
        mean = x @ y[at] / total
        var = np.maximum(x @ (y[at] ** 2) / total - mean**2, 0)
        squares = (np.bincount(anchors[at] // e.kernel_block - (anchors[at] // e.kernel_block).min(), weights=x) ** 2).sum() if e.kernel_block else (x * x).sum()
        sums.append((mean, var))
        effective.append(total**2 / squares)
    w = group_weights(effective, pi, e)
    if w is None:
        return None
    mean, var = np.zeros(y.shape[1]), np.zeros(y.shape[1])
    for s, x, n in zip(sums, w, effective, strict=True):
        if x > 0:
            mean += x * s[0]
            var += x * x * s[1] / n
    return mean, np.sqrt(var), float(sum(effective))


def _blocks(df: DataFrame, e: Engine, m: int, p: int) -> tuple[DataFrame, DataFrame]:
    """Bars that ask, and the history that each block may use, both by series and block."""
    flat = df.select("series_id", "t", "state", "pi_high", *(F.col("emb")[i].alias(f"e{i}") for i in range(m)), *(F.col("y")[i].alias(f"y{i}") for i in range(p)))
    whole_e = F.lit(True)
    for i in range(m):
        whole_e = whole_e & F.col(f"e{i}").isNotNull()
    whole_y = F.lit(True)
    for i in range(p):
        whole_y = whole_y & F.col(f"y{i}").isNotNull()
    asks = flat.filter(whole_e & (F.col("t") >= max(e.warmup, e.delay))).withColumn("block", F.expr(f"t div {e.block}"))
    last = asks.groupBy("series_id").agg(F.max("block").alias("last"))
    history = flat.filter(whole_e & whole_y & (F.col("t") >= e.first)).join(last, "series_id")
    # bar j serves blocks from that of j + delay to that of j + lookback
    start = F.expr(f"(t + {e.delay}) div {e.block}")
    end = F.least(F.col("last"), F.expr(f"(t + {min(e.lookback, UNLIMITED)}) div {e.block}"))
    history = history.withColumn("block", F.explode(F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<bigint>")))).drop("last")
    # both come from one frame: new names tell their columns apart
    return asks.toDF(*asks.columns), history.toDF(*history.columns)


def _walk(asks: pd.DataFrame, history: pd.DataFrame, e: Engine, m: int, p: int) -> Iterator[tuple]:
    """(bar, its row of asks, candidates' distances, anchors, states, targets) for every bar with candidates."""
    history = history.sort_values("t", kind="stable")
    anchors = history["t"].to_numpy(np.int64)
    emb = np.ascontiguousarray(history[[f"e{i}" for i in range(m)]].to_numpy(float).T)
    y = history[[f"y{i}" for i in range(p)]].to_numpy(float)
    states = history["state"].to_numpy()
    x = asks[[f"e{i}" for i in range(m)]].to_numpy(float)
    for row, t in enumerate(asks["t"].to_numpy(np.int64)):
        lo, hi = np.searchsorted(anchors, t - e.lookback), np.searchsorted(anchors, t - e.delay, side="right")
        if hi <= lo:
            continue
        d = np.zeros(hi - lo)
        for i in range(m):
            step = emb[i, lo:hi] - x[row, i]
            d += step * step
        yield int(t), row, d, anchors[lo:hi], states[lo:hi], y[lo:hi]


def forecast(df: DataFrame, e: Engine, m: int, p: int, only: DataFrame | None = None) -> DataFrame:
    """df(series_id, t, emb array of m, y array of p, state) -> means, standard errors, n_used and pi_high.

    Bars without a forecast are absent. Missing is NULL in emb and y; a bar's own targets are never used.
    only(series_id, t): bars to forecast, where not all are wanted.
    """
    if only is None and tiles.suits(e, m):
        return _wide_forecast(df, e, m, p)
    asks, history = _blocks(_mixed(df, e), e, m, p)
    if only is not None:
        asks = asks.join(only, ["series_id", "t"], "left_semi")
        blocks = asks.select("series_id", "block").distinct()
        history = history.join(blocks, ["series_id", "block"], "left_semi")
    names = [*(f"mean_{i}" for i in range(p)), *(f"se_{i}" for i in range(p)), "n_used", "pi_high"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pi = left["pi_high"].to_numpy(float)
        for t, row, d, anchors, states, y in _walk(left, right, e, m, p):
            found = _kernel_forecast(d, anchors, states, y, pi[row], e) if e.bandwidth > 0 else _neighbour_forecast(y, nearest(d, anchors, states, e), pi[row], e)
            if found is not None:
                rows.append((left["series_id"].iloc[0], t, *found[0], *found[1], found[2], pi[row]))
        return pd.DataFrame(rows, columns=["series_id", "t", *names])

    schema = "series_id string, t long, " + ", ".join(f"{n} double" for n in names)
    return asks.groupBy("series_id", "block").cogroup(history.groupBy("series_id", "block")).applyInPandas(run, schema)


def _wide_forecast(df: DataFrame, e: Engine, m: int, p: int) -> DataFrame:
    """``forecast`` of wide states: the walks choose from the few candidates that ``tiles`` leaves."""
    names = [*(f"mean_{i}" for i in range(p)), *(f"se_{i}" for i in range(p)), "n_used", "pi_high"]
    mixed = _mixed(df.select("series_id", F.col("t").cast("long").alias("t"), "state"), e).select("series_id", "t", "pi_high")
    groups = 2 if e.regime else 1

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for series, t, lists, pi in zip(pdf["series_id"], pdf["t"], pdf["lists"], pdf["pi_high"].to_numpy(float), strict=True):
                c = np.frombuffer(b"".join(lists), tiles.candidate(p))
                found = _neighbour_forecast(c["y"], greedy(np.lexsort((c["j"], c["d"])), c["j"], c["g"], groups, e.k, e.exclusion), pi, e)
                if found is not None:
                    rows.append((series, t, *found[0], *found[1], found[2], pi))
            yield pd.DataFrame(rows, columns=["series_id", "t", *names])

    schema = "series_id string, t long, " + ", ".join(f"{n} double" for n in names)
    return tiles.candidates(df, e, m, p).join(mixed, ["series_id", "t"]).mapInPandas(run, schema)


def neighbours(df: DataFrame, e: Engine, m: int, p: int) -> DataFrame:
    """The chosen anchors, one row each: series_id, t, grp, rank (from 1), anchor_t, distance, weight.

    A group that is too small is listed with weight 0. Weights of a bar add up to 1, and the weighted mean
    of the anchors' targets is the forecast.
    """
    if e.bandwidth > 0:
        raise ValueError("a kernel has no neighbours")
    asks, history = _blocks(_mixed(df, e), e, m, p)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pi = left["pi_high"].to_numpy(float)
        for t, row, d, anchors, states, _ in _walk(left, right, e, m, p):
            taken = nearest(d, anchors, states, e)
            w = group_weights([len(x) for x in taken], pi[row], e)
            if w is not None:
                rows += [(left["series_id"].iloc[0], t, g, n, int(anchors[i]), float(d[i]), float(w[g] / len(part))) for g, part in enumerate(taken) for n, i in enumerate(part, 1)]
        return pd.DataFrame(rows, columns=["series_id", "t", "grp", "rank", "anchor_t", "distance", "weight"])

    return asks.groupBy("series_id", "block").cogroup(history.groupBy("series_id", "block")).applyInPandas(run, "series_id string, t long, grp int, rank int, anchor_t long, distance double, weight double")


def at_or_after(bars: DataFrame, times: DataFrame, at: str = "ts") -> DataFrame:
    """series_id, when and t of the first bar at or after each time; times(series_id, when). Absent after the last bar.

    Only each partition's own first bar travels."""
    met = bars.select("series_id", "t", F.col(at).alias("_at")).join(times, "series_id").filter(F.col("_at") >= F.col("when"))
    return met.groupBy("series_id", "when").agg(F.min_by("t", "_at").alias("t"))


def nearest_to(df: DataFrame, asked: DataFrame, k: int, exclusion: int, delay: int, first: int = 0) -> DataFrame:
    """series_id, t, rank, anchor_t and distance of the k nearest earlier bars of a few bars, regimes pooled.

    df(series_id, t, emb, y) as for ``forecast``; asked(series_id, t). An anchor taken bars at most 2 (exclusion - 1)
    others from the choice, so k anchors are found among the (k - 1) (2 exclusion - 1) + 1 nearest: only that head
    is sorted and walked, whatever the length of the history, and the self-join is over the asked bars alone."""
    head = (k - 1) * max(2 * exclusion - 1, 1) + 1
    now = df.join(asked, ["series_id", "t"], "left_semi").select("series_id", F.col("t").alias("_t"), F.col("emb").alias("_x")).filter(F.col("_x").isNotNull())
    whole = F.col("emb").isNotNull() & F.forall("emb", lambda v: v.isNotNull()) & F.forall("y", lambda v: v.isNotNull())
    past = df.filter(whole & (F.col("t") >= first)).join(now, "series_id").filter(F.col("t") <= F.col("_t") - delay)
    apart = F.aggregate(F.zip_with("emb", "_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    order = Window.partitionBy("series_id", "_t").orderBy("distance", "t")
    near = past.select("series_id", "_t", "t", apart.alias("distance")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= head)
    lists = near.groupBy("series_id", F.col("_t").alias("t")).agg(F.array_sort(F.collect_list(F.struct("distance", F.col("t").alias("anchor_t")))).alias("l"))
    free = lambda taken, x: (F.size(taken) < k) & F.forall(taken, lambda z: F.abs(z["anchor_t"] - x["anchor_t"]) >= exclusion)
    walk = F.aggregate("l", F.slice("l", 1, 0), lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken))
    return lists.select("series_id", "t", F.posexplode(walk).alias("rank", "a")).select("series_id", "t", (F.col("rank") + 1).alias("rank"), "a.anchor_t", "a.distance")


def _mixed(df: DataFrame, e: Engine) -> DataFrame:
    if not e.regime:
        return df.withColumn("state", F.lit(0).cast("tinyint")).withColumn("pi_high", F.lit(0.0))
    return markov_high(df, e.horizon, None if e.lookback >= UNLIMITED else e.lookback)


@dataclass(frozen=True)
class Analogue:
    """The engine over any embedding and targets.

    forecast and neighbours take a frame with series_id, t, the named embedding (array) and targets (array),
    and a 0/1 state if regimes are to be told apart.
    """

    k: int = 20
    k_min: int = 5
    horizon: int = 24
    exclusion: int | None = None
    warmup: int = 0
    lookback: int = UNLIMITED
    bandwidth: float = 0.0
    kernel_block: bool = False
    block: int = 1024

    def __post_init__(self):
        if self.k < 1 or self.k_min < 1 or self.horizon < 1 or self.lookback < 1 or self.bandwidth < 0:
            raise ValueError("k, k_min, horizon and lookback must be positive, the bandwidth not negative")

    def _engine(self, delay: int | None, regime: bool) -> Engine:
        delay = self.horizon if delay is None else delay
        if delay < 0:
            raise ValueError("a negative delay would look ahead")
        return Engine(self.k, self.k_min, self.horizon if self.exclusion is None else self.exclusion, delay, self.warmup, self.lookback, 0, regime, self.horizon, self.bandwidth, delay if self.kernel_block and self.bandwidth > 0 else 0, self.block)

    def _frame(self, df: DataFrame, embedding: str, targets: str, state: str | None) -> DataFrame:
        missing = {"series_id", "t", embedding, targets, *([state] if state else [])} - set(df.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return df.select("series_id", "t", F.col(embedding).alias("emb"), F.col(targets).alias("y"), (F.col(state) if state else F.lit(0)).cast("tinyint").alias("state"))

    def forecast(self, df: DataFrame, m: int, p: int, embedding: str = "emb", targets: str = "y", state: str | None = None, delay: int | None = None) -> DataFrame:
        return forecast(self._frame(df, embedding, targets, state), self._engine(delay, state is not None), m, p)

    def neighbours(self, df: DataFrame, m: int, p: int, embedding: str = "emb", targets: str = "y", state: str | None = None, delay: int | None = None) -> DataFrame:
        return neighbours(self._frame(df, embedding, targets, state), self._engine(delay, state is not None), m, p)

    def but(self, **over) -> Analogue:
        return replace(self, **over)
