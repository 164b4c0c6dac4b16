"""Trades: exits of one trade, outcomes for every bar, a backtest of one position at a time, signals, overlays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as W

#: How a trade ended.
STOP, TARGET, TIME, REVERSE, END = 1, 2, 3, 4, 5


def r_multiple(direction: Column, entry: Column, leave: Column, stop: Column, cost: float) -> Column:
    """Profit in units of the stop distance, less costs on both legs."""
    return (direction * (leave - entry) - cost * (entry + leave)) / stop


def outcomes(bars: DataFrame, direction: int, stop: str, rr: float, hold: int, protect_entry: bool = True) -> DataFrame:
    """bars with entry, exit_price, exit_after and reason of a trade opened at the next bar's open.

    ``stop`` names the stop distance. A gap over stop or target fills at the open, the stop first; inside a
    bar the stop is taken to come first. NULL unless all of the holding period is there. Linear in the bars:
    each bar folds over a window of hold + 1 bars.
    """
    ahead = F.collect_list(F.struct("open", "high", "low", "close")).over(W.forward(hold + 1))
    entry = F.element_at("_ahead", 1)["open"]
    sd = F.col(stop)
    d = F.lit(float(direction))
    low_price, goal = entry - d * sd, entry + d * rr * sd
    bar = lambda i: F.element_at("_ahead", i)

    def step(i: Column) -> Column:
        x = bar(i)
        gap = i > 1
        against, beyond = (x["low"] <= low_price, x["high"] >= goal) if direction > 0 else (x["high"] >= low_price, x["low"] <= goal)
        inside = gap | F.lit(protect_entry)
        made = lambda price, reason: F.struct(price.alias("price"), i.alias("after"), F.lit(reason).alias("reason"))
        return (
            F.when(gap & (d * (x["open"] - low_price) <= 0), made(x["open"], STOP))
            .when(gap & (d * (x["open"] - goal) >= 0), made(x["open"], TARGET))
            .when(inside & against, made(low_price, STOP))
            .when(inside & beyond, made(goal, TARGET))
        )

    tried = F.filter(F.transform(F.sequence(F.lit(1), F.lit(hold)), step), lambda x: x.isNotNull())
    last = F.struct(bar(F.lit(hold + 1))["open"].alias("price"), F.lit(hold + 1).alias("after"), F.lit(TIME).alias("reason"))
    whole = (F.size("_ahead") == hold + 1) & (sd > 0)
    ended = F.when(whole, F.when(F.size(tried) > 0, F.element_at(tried, 1)).otherwise(last))
    return bars.withColumn("_ahead", ahead).withColumn("_end", ended).select(*bars.columns, F.when(whole, entry).alias("entry"), F.col("_end.price").alias("exit_price"), F.col("_end.after").alias("exit_after"), F.col("_end.reason").alias("reason"))


def labels(bars: DataFrame, stop: str, rr: float, hold: int, cost: float) -> DataFrame:
    """series_id, t, r_long, r_short and up (the close after hold bars is above this one)."""
    both = []
    for name, d in (("r_long", 1), ("r_short", -1)):
        made = outcomes(bars, d, stop, rr, hold)
        both.append(made.select("series_id", "t", r_multiple(F.lit(float(d)), F.col("entry"), F.col("exit_price"), F.col(stop), cost).alias(name)))
    up = bars.select("series_id", "t", (F.lead("close", hold).over(W.ordered()) > F.col("close")).cast("double").alias("up"))
    joined = up.join(both[0], ["series_id", "t"]).join(both[1], ["series_id", "t"])
    return joined.withColumn("up", F.when(F.col("r_long").isNotNull(), F.col("up")))


@dataclass(frozen=True)
class Backtest:
    max_hold: int = 20
    rr: float = 1.5
    cost: float = 0.0005
    leverage: float = 1.0
    protect_entry: bool = True
    close_on_opposite: bool = False
    risk_sizing: bool = True


def exit_of(o, h, low, c, e: int, d: int, sd: float, p: Backtest) -> tuple[int, float, int]:
    """(bar, price, reason) of the trade entered at the open of bar e."""
    n, stop, goal = len(o), o[e] - d * sd, o[e] + d * p.rr * sd
    for b in range(e, min(e + p.max_hold, n)):
        if b > e:
            if d * (o[b] - stop) <= 0:
                return b, o[b], STOP
            if d * (o[b] - goal) >= 0:
                return b, o[b], TARGET
        if b > e or p.protect_entry:
            worst, best = (low[b], h[b]) if d > 0 else (h[b], low[b])
            if d * (worst - stop) <= 0:
                return b, stop, STOP
            if d * (best - goal) >= 0:
                return b, goal, TARGET
    last = e + p.max_hold
    return (last, o[last], TIME) if last < n else (n - 1, c[n - 1], END)


def run_backtest(o, h, low, c, direction, stop, size, p: Backtest) -> tuple[np.ndarray, list[tuple]]:
    """Equity at each close, and trades (signal, entry, exit, direction, prices, r, return, reason)."""
    n, cash = len(o), 1.0
    equity, trades, t = np.ones(n), [], 0
    while t < n:
        equity[t] = cash
        d, sd, s = int(direction[t]), stop[t], size[t]
        if d == 0 or t + 1 >= n or not (sd > 0 and np.isfinite(sd) and s > 0 and cash > 0):
            t += 1
            continue
        e = t + 1
        x, price, reason = exit_of(o, h, low, c, e, d, sd, p)
        if p.close_on_opposite:
            turned = np.flatnonzero(direction[e:x] == -d)
            if len(turned) and e + turned[0] + 1 < n:
                x = e + int(turned[0]) + 1
                price, reason = o[x], REVERSE
        quantity = min(s * cash / sd if p.risk_sizing else s * cash / c[t], p.leverage * cash / c[t])
        open_cost = p.cost * quantity * o[e]
        for b in range(e, x):
            equity[b] = cash - open_cost + d * quantity * (c[b] - o[e])
        profit = quantity * d * (price - o[e]) - p.cost * quantity * (o[e] + price)
        trades.append((t, e, x, d, o[e], price, (d * (price - o[e]) - p.cost * (o[e] + price)) / sd, profit / cash, reason))
        cash += profit
        equity[x] = cash
        t = max(x, t + 1)
        if reason == END:
            break
    equity[n - 1] = cash
    return equity, trades


TRADE = "series_id string, signal_bar long, entry_bar long, exit_bar long, dir int, entry_price double, exit_price double, r double, ret double, reason int"


def backtest(bars: DataFrame, p: Backtest) -> tuple[DataFrame, DataFrame]:
    """(trades, equity) of bars with dir (-1, 0, 1), stop and size. The next free signal depends on where the
    last trade ended, so each series is one pass; series run side by side."""

    def arrays(pdf: pd.DataFrame):
        pdf = pdf.sort_values("t")
        return pdf, run_backtest(*(pdf[x].to_numpy(float) for x in ("open", "high", "low", "close")), pdf["dir"].to_numpy(int), pdf["stop"].to_numpy(float), pdf["size"].to_numpy(float), p)

    def trades(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (_, made) = arrays(pdf)
        return pd.DataFrame([(pdf["series_id"].iloc[0], *x) for x in made], columns=[f.split()[0] for f in TRADE.split(", ")])

    def equity(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, (eq, _) = arrays(pdf)
        return pdf[["series_id", "t"]].assign(eq=eq)

    need = bars.select("series_id", "t", "open", "high", "low", "close", F.coalesce("dir", F.lit(0)).cast("int").alias("dir"), "stop", "size")
    return need.groupBy("series_id").applyInPandas(trades, TRADE), need.groupBy("series_id").applyInPandas(equity, "series_id string, t long, eq double")


def decide(forecasts: DataFrame, z: float = 1.0, sl_mult: float = 2.5, max_risk: float = 0.02, kelly: float = 0.5, allow: str | None = None) -> DataFrame:
    """dir, stop and size from forecasts (mean_0: R long, mean_1: R short, se_0, se_1, mean_3, mean_4: their
    squares) and atr: the side whose lower bound is above 0 and no worse than the other's, if allowed."""
    long, short = F.col("mean_0") - z * F.col("se_0"), F.col("mean_1") - z * F.col("se_1")
    ok = F.coalesce(F.col(allow), F.lit(True)) if allow else F.lit(True)
    direction = F.when(ok & (long > 0) & (long >= short), 1).when(ok & (short > 0) & (short > long), -1).otherwise(0)
    edge = F.when(direction == 1, F.col("mean_0") / F.col("mean_3")).when(direction == -1, F.col("mean_1") / F.col("mean_4"))
    size = F.greatest(F.lit(0.0), F.least(F.lit(max_risk), F.coalesce(kelly * edge, F.lit(0.0))))
    return forecasts.withColumns({"dir": F.coalesce(direction, F.lit(0)).cast("tinyint"), "stop": sl_mult * F.col("atr"), "size": size})


def momentum(bars: DataFrame, w: int, warmup: int) -> DataFrame:
    """dir: the sign of the last w bars' move, 0 before the warm-up."""
    move = F.signum(F.col("close") - F.lag("close", w).over(W.ordered()))
    return bars.withColumn("dir", F.when(F.col("t") >= warmup, F.coalesce(move, F.lit(0.0))).otherwise(0.0).cast("tinyint"))


@dataclass(frozen=True)
class Legacy:
    """The first strategy's fixed values."""

    lookback: int = 1000
    span: int = 20
    scan: int = 300
    k: int = 10
    z: float = 1.96
    least: float = 65.0
    matches: int = 8
    gate: float = 50.0
    widen: float = 10.0
    max_size: float = 10.0
    stop: float = 2.5
    rr: float = 1.5
    jump: float = 2.5

    @property
    def start(self) -> int:
        return self.lookback + self.span + 11


def legacy_neighbours(bars: DataFrame, p: Legacy) -> DataFrame:
    """wins of the k bars among the lags span + 1 to scan whose past move is nearest (ties: the nearer lag).

    Lags are a bounded band, so each bar's candidates are one window's array and nothing is joined.
    """
    w = W.ordered()
    move = bars.withColumn("move", F.col("close") / F.lag("close", p.span).over(w) - 1).withColumn("won", (F.lead("close", p.span).over(w) > F.col("close")).cast("int"))
    past = F.collect_list(F.struct((-F.col("t")).alias("back"), "move", "won")).over(w.rowsBetween(-p.scan, -p.span - 1))
    ranked = F.array_sort(F.transform(F.filter("past", lambda x: x["move"].isNotNull()), lambda x: F.struct(F.abs(x["move"] - F.col("move")).alias("d"), x["back"].alias("back"), x["won"].alias("won"))))
    near = move.withColumn("past", past).filter((F.col("t") >= p.start) & F.col("move").isNotNull()).withColumn("near", F.slice(ranked, 1, p.k))
    return near.select("series_id", "t", F.aggregate("near", F.lit(0), lambda a, x: a + x["won"]).alias("wins"), F.size("near").alias("matches"))


def legacy_signals(bars: DataFrame, p: Legacy | None = None) -> DataFrame:
    """dir, stop, size, score and jump_chance from bars with r and atr (of 14 bars).

    The share of wins among the nearest past moves is tempered by how persistent the volatility regime was over
    the last transitions before this bar's own; frequent jumps widen the stop, very frequent ones forbid trades.
    """
    p = p or Legacy()
    w = W.ordered()
    x = bars.withColumn("state", W.regime(F.col("atr"), p.lookback).cast("int"))
    x = x.withColumn("jumped", F.coalesce(F.abs("r") > p.jump * W.stdev(F.col("r"), p.lookback), F.lit(False)).cast("double"))
    before = F.lag("state").over(w)
    scanned = w.rowsBetween(-p.scan, -1)
    x = x.withColumns({f"s{a}{b}": ((before == a) & (F.col("state") == b)).cast("double") for a in (0, 1) for b in (0, 1)})
    total = lambda c: F.sum(c).over(scanned)
    stay = lambda a: total(f"s{a}{a}") / F.greatest(total(f"s{a}0") + total(f"s{a}1"), F.lit(1.0))
    x = x.withColumns({"stay": F.when(F.col("state") == 1, stay(1)).otherwise(stay(0)), "jump_chance": 100 * (1 - F.exp(-F.sum("jumped").over(W.trailing(p.lookback)) / p.lookback * p.span))})
    x = x.select("series_id", "t", "atr", "stay", "jump_chance").join(legacy_neighbours(bars, p), ["series_id", "t"])
    share, n = F.col("wins") / F.col("matches"), F.col("matches")
    centre, spread = share + p.z**2 / (2 * n), p.z * F.sqrt(share * (1 - share) / n + p.z**2 / (4 * n * n))
    x = x.withColumns({"low": 100 * F.greatest(F.lit(0.0), (centre - spread) / (1 + p.z**2 / n)), "high": 100 * F.least(F.lit(1.0), (centre + spread) / (1 + p.z**2 / n))})
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * share * F.col("stay") + 50 * (1 - F.col("stay"))))
    x = x.withColumn("score", score)
    calm = F.col("jump_chance") < p.gate
    stop = F.col("atr") * p.stop * F.when((F.col("jump_chance") >= p.widen) & calm, 1.5).otherwise(1.0)
    x = x.withColumn("stop", stop)
    payoff = F.col("stop") * p.rr / F.greatest("stop", F.lit(0.0001))
    best = F.greatest(F.col("score"), 100 - F.col("score")) / 100
    kelly = F.least(F.lit(p.max_size), F.greatest(F.lit(0.0), 50 * (best - (1 - best) / payoff)))
    ok = (n >= min(p.matches, p.k)) & calm & (kelly > 0)
    long = ok & (F.col("low") >= p.least) & (F.col("score") >= p.least)
    short = ok & (100 - F.col("high") >= p.least) & (100 - F.col("score") >= p.least)
    return x.withColumns({"dir": F.when(long, 1).when(short, -1).otherwise(0).cast("tinyint"), "size": F.greatest(kelly, F.lit(0.01)) / 100})


#: The first strategy's execution: unprotected entries, closed by an opposite signal, sized by notional.
LEGACY_EXECUTION = Backtest(max_hold=21, protect_entry=False, close_on_opposite=True, risk_sizing=False)


def folds(bars: DataFrame, warmup: int, k: int = 5, least: int = 500, share: float = 0.3) -> DataFrame:
    """series_id, fold, a, b: k equal spans after the calibration part."""
    n = bars.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    cal = F.greatest(F.floor(share * F.col("n")), F.lit(warmup + least))
    edge = lambda i: F.floor(F.col("cal") + (F.col("n") - F.col("cal")) * i / k)
    return n.withColumn("cal", cal.cast("long")).filter("cal < n").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("series_id", "fold", edge(F.col("fold")).cast("long").alias("a"), edge(F.col("fold") + 1).cast("long").alias("b"))


def overlay(data: DataFrame, fit_end: int, warmup: int, cap: float, band: float, cost: float, kind: str = "vol", gate: str | None = None) -> DataFrame:
    """w and ret of a position sized by forecast variance (column variance, with r and close).

    The target is the mean variance (column rv where there is one, else squared returns) of [warmup, fit_end).
    The weight is 0 up to fit_end and moves only if the wanted one is more than ``band`` away; a bar earns the
    weight of the bar before, and pays for its change.
    """
    from tidemark.functions.recurrences import along_series, sticky_weight

    fit = data.filter((F.col("t") >= warmup) & (F.col("t") < fit_end)).groupBy("series_id").agg(F.avg(F.col("rv") if "rv" in data.columns else F.col("r") * F.col("r")).alias("goal"))
    ratio = F.col("goal") / F.col("variance")
    raw = F.coalesce(F.sqrt(ratio) if kind == "vol" else ratio, F.lit(0.0))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(cap), raw))
    if gate:
        raw = F.when(F.coalesce(F.col(gate), F.lit(False)), 0.0).otherwise(raw)
    wide = data.join(fit, "series_id").withColumn("raw", raw)

    def weights(p: pd.DataFrame) -> dict[str, np.ndarray]:
        on = p["t"].to_numpy() >= fit_end
        w = np.zeros(len(p))
        w[on] = sticky_weight(p["raw"].to_numpy(float)[on], band)
        return {"w": w}

    sized = along_series(wide, {"w": "double"}, weights)
    w = W.ordered()
    held, before = F.coalesce(F.lag("w").over(w), F.lit(0.0)), F.coalesce(F.lag("w", 2).over(w), F.lit(0.0))
    simple = F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))
    return sized.withColumn("ret", held * simple - F.abs(held - before) * cost)


def match_trades(theirs: DataFrame, ours: DataFrame, tolerance: float) -> DataFrame:
    """Full outer join on entry time and direction: side (both, theirs, ours), whether the exit is the same bar, and which
    prices agree. Times of exits are compared where both lists have them."""
    timed = "exit_time" in theirs.columns and "exit_time" in ours.columns
    leave = [F.col("exit_time")] if timed else [F.lit(None).cast("timestamp").alias("exit_time")]
    a = theirs.select("entry_time", "dir", F.col("entry_price").alias("their_entry"), F.col("exit_price").alias("their_exit"), *(x.alias("their_time") for x in leave), F.lit(1).alias("_a"))
    b = ours.select("entry_time", "dir", F.col("entry_price").alias("our_entry"), F.col("exit_price").alias("our_exit"), *(x.alias("our_time") for x in leave), F.lit(1).alias("_b"))
    near = lambda x, y: F.abs(F.col(x) / F.col(y) - 1) <= tolerance
    side = F.when(F.col("_a").isNull(), "ours").when(F.col("_b").isNull(), "theirs").otherwise("both")
    return a.join(b, ["entry_time", "dir"], "full_outer").select(
        "entry_time", "dir", side.alias("side"), (F.col("their_time") == F.col("our_time")).alias("same_exit"), near("their_entry", "our_entry").alias("entry_agrees"), near("their_exit", "our_exit").alias("exit_agrees")
    )


def match_report(theirs: DataFrame, ours: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row: numbers of trades (ours within their span), matched ones, and the shares that agree; and unmatched
    ones of either side, by anti joins. Shares are NULL without matches."""
    span = theirs.agg(F.min("entry_time").alias("_lo"), F.max("entry_time").alias("_hi"))
    inside = ours.join(F.broadcast(span), (F.col("entry_time") >= F.col("_lo")) & (F.col("entry_time") <= F.col("_hi"))).drop("_lo", "_hi")  # one row is broadcast
    met = match_trades(theirs, inside, tolerance).filter("side = 'both'")
    keys = ["entry_time", "dir"]
    shares = ["same_exit", "entry_agrees", "exit_agrees"]
    named = {"theirs": theirs, "ours": inside, "matched": met, "only_theirs": theirs.join(inside, keys, "left_anti"), "only_ours": inside.join(theirs, keys, "left_anti")}
    marks = None
    for name, df in named.items():
        one = df.select(F.lit(name).alias("what"), *((F.coalesce(F.col(c), F.lit(False)).cast("double") if df is met else F.lit(None).cast("double")).alias(c) for c in shares))
        marks = one if marks is None else marks.unionByName(one)
    count = lambda name: F.count(F.when(F.col("what") == name, 1)).alias(name)
    out = marks.agg(count("theirs"), count("ours"), count("matched"), *(F.avg(c).alias(c) for c in shares), count("only_theirs"), count("only_ours"))
    return out.withColumn("match_rate", F.col("matched") / F.greatest("theirs", F.lit(1)))
