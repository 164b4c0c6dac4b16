"""Losses and metrics as expressions and frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import windows as W


def erf(x: Column) -> Column:
    """Error function to about 1e-15, by its series of positive terms; 1 from 6 on."""
    size = F.abs(x)
    step = lambda a, n: F.struct((a["term"] * 2 * size * size / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * size * size / (2 * n + 1)).alias("sum"))
    summed = F.aggregate(F.sequence(F.lit(1), F.lit(140)), F.struct(size.alias("term"), size.alias("sum")), step, lambda a: a["sum"])
    return F.signum(x) * F.when(size >= 6, 1.0).otherwise(F.least(F.lit(1.0), 2 / math.sqrt(math.pi) * F.exp(-size * size) * summed))


def normal_cdf(z: Column) -> Column:
    return (1 + erf(z / math.sqrt(2))) / 2


def two_sided(z: Column) -> Column:
    """Chance that a normal value is as far from 0."""
    return 1 - erf(F.abs(z) / math.sqrt(2))


def qlike(realised: Column, log_forecast: Column) -> Column:
    x = realised / F.exp(log_forecast)
    return x - F.log(x) - 1


def log_loss(p: Column, y: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def tick_loss(y: Column, v: Column, alpha: float) -> Column:
    return (alpha - (y <= v).cast("double")) * (y - v)


def fz0_loss(y: Column, v: Column, e: Column, alpha: float) -> Column:
    hit = (y <= v).cast("double")
    return -hit * (v - y) / (alpha * e) + v / e + F.log(-e) - 1


def brier_skill(df: DataFrame, by: list[str], p: str, y: str, fit: Column, scored: Column) -> DataFrame:
    """skill per group: one less the Brier score over that of the base rate, which is known before: it comes from
    the ``fit`` rows, the scores from the ``scored`` ones. NULL where the base rate is never wrong."""
    base = df.filter(fit & F.col(y).isNotNull()).groupBy(*by).agg(F.avg(y).alias("_base"))
    s = df.filter(scored & F.col(p).isNotNull() & F.col(y).isNotNull()).join(base, by).groupBy(*by).agg(F.avg(brier(F.col(p), F.col(y))).alias("_own"), F.avg(brier(F.col("_base"), F.col(y))).alias("_plain"))
    return s.select(*by, F.when(F.col("_plain") > 0, 1 - F.col("_own") / F.col("_plain")).alias("skill"))


def average_ranks(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """Ranks from 1 within each group; equal values share the mean of their places. Distinct values are
    counted first, so that a window only passes over those."""
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, [*by, x])


def auc(df: DataFrame, by: list[str], p: str, y: str) -> DataFrame:
    """Area under the curve per group from counts of each distinct score; NULL where all y are the same."""
    counts = df.groupBy(*by, p).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(w), F.lit(0.0)) + (F.col("n") + 1) / 2
    s = counts.withColumn("ranks", rank * F.col("pos")).groupBy(*by).agg(F.sum("ranks").alias("s"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    return s.select(*by, F.try_divide(F.col("s") - F.col("a") * (F.col("a") + 1) / 2, F.col("a") * F.col("b")).alias("auc"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("ic"))


def summary(df: DataFrame, r: str, per_year: float, weight: str | None = None, q: float = 0.05) -> DataFrame:
    """One row a series: sharpe (ddof 1), ann_ret, ann_vol (ddof 0), max_dd, cvar, calmar, exposure, turnover.

    Wealth is the product of 1 + r, so a return of -1 or less is allowed; ann_ret and calmar are NULL if it ends
    below 0. A drawdown counts from the highest wealth at a bar's end; exposure is the mean size of the weights, and
    turnover leaves the first weight out.
    """
    df = df.withColumn("_eq", F.product(1 + F.col(r)).over(W.upto()))
    df = df.withColumn("_dd", F.when(F.max("_eq").over(W.upto()) != 0, F.col("_eq") / F.max("_eq").over(W.upto()) - 1))
    w = F.col(weight) if weight else F.lit(1.0)
    df = df.withColumn("_w", w).withColumn("_turn", F.coalesce(F.abs(F.col("_w") - F.lag("_w").over(W.ordered())), F.lit(0.0)))
    cut = df.groupBy("series_id").agg(F.percentile(r, F.lit(q)).alias("_cut"))
    a = df.join(cut, "series_id").groupBy("series_id").agg(
        F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.stddev_pop(r).alias("sp"), F.product(1 + F.col(r)).alias("grown"), F.count(F.lit(1)).alias("n"), F.min("_dd").alias("max_dd"),
        F.avg(F.when(F.col(r) <= F.col("_cut"), F.col(r))).alias("cvar"), F.avg(F.abs("_w")).alias("exposure"), F.avg("_turn").alias("turn"),
    )
    year = F.when(F.col("grown") >= 0, F.pow("grown", per_year / F.col("n")) - 1)
    return a.select(
        "series_id", F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * math.sqrt(per_year)).otherwise(0.0).alias("sharpe"), year.alias("ann_ret"), (F.col("sp") * math.sqrt(per_year)).alias("ann_vol"), "max_dd", "cvar",
        F.when(F.col("max_dd") < 0, year / -F.col("max_dd")).alias("calmar"), "exposure", (F.col("turn") * per_year).alias("turnover"),
    )


def probabilistic_sharpe(df: DataFrame, by: list[str], r: str, against: float | str = 0.0) -> DataFrame:
    """sr (a bar) and psr per group: the chance that the true ratio is above ``against``, from four moment sums.

    against: a number, or a column that is the same for all rows of a group."""
    own = isinstance(against, str)
    m = F.avg(r).over(Window.partitionBy(*by))
    x = df.withColumn("_x", F.col(r) - m)
    power = lambda k: F.avg(F.pow("_x", F.lit(float(k)))).alias(f"m{k}")
    level = F.first(F.col(against)) if own else F.lit(float(against))
    s = x.groupBy(*by).agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), power(2), power(3), power(4), level.alias("_against")).filter("sd > 0")
    sr = F.col("m") / F.col("sd")
    skew, tails = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / (F.col("m2") * F.col("m2"))
    spread = F.greatest(1 - skew * sr + (tails - 1) / 4 * sr * sr, F.lit(1e-12))
    return s.select(*by, sr.alias("sr"), normal_cdf((sr - F.col("_against")) * F.sqrt(F.col("n") - 1) / F.sqrt(spread)).alias("psr"))


def newey_west(df: DataFrame, d: str, lag: int, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """One row a group: mean, variance of the mean (Bartlett), dm, their ratio (0 without variance), and its two-sided p."""
    mean = F.avg(d).over(Window.partitionBy(*by))
    x = df.withColumn("_x", F.col(d) - mean)
    w = Window.partitionBy(*by).orderBy("t")
    terms = [F.sum(F.col("_x") * F.col("_x")).alias("c0")]
    for k in range(1, lag + 1):
        x = x.withColumn(f"_l{k}", F.lag("_x", k).over(w))
        terms.append(F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"c{k}"))
    s = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), *terms)
    total = F.col("c0")
    for k in range(1, lag + 1):
        total = total + 2 * (1 - k / (lag + 1)) * F.col(f"c{k}")
    var = total / F.col("n") / F.col("n")
    dm = F.when(F.col("variance") > 0, F.col("mean") / F.sqrt("variance")).otherwise(0.0)
    return s.withColumn("variance", F.coalesce(var, F.lit(0.0))).withColumn("dm", dm).select(*by, "mean", "variance", "dm", two_sided(F.col("dm")).alias("p"))


def holm(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """df with holm: step-down adjusted p-values; a table of tests is small."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(p)
    n = F.count(p).over(Window.partitionBy(*(by or [F.lit(0)])))
    stepped = F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_s", stepped).withColumn("holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def kupiec(df: DataFrame, hit: str, alpha: float, by: list[str]) -> DataFrame:
    """n, x, lr (unconditional coverage) and p per group."""
    x, n = F.col("x"), F.col("n")
    free = F.when((x > 0) & (x < n), x * F.log(x / n) + (n - x) * F.log(1 - x / n)).otherwise(0.0)
    lr = -2 * (x * math.log(alpha) + (n - x) * math.log(1 - alpha) - free)
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(hit).cast("double")).alias("x")).withColumn("lr", lr).withColumn("p", two_sided(F.sqrt(F.greatest(F.col("lr"), F.lit(0.0)))))


def christoffersen(df: DataFrame, hit: str, alpha: float, by: list[str], order: str = "t") -> DataFrame:
    """lr_uc with p_uc, lr_ind, lr_cc and p_cc (two degrees of freedom) per group."""
    h = F.col(hit).cast("int")
    before = F.lag(h).over(Window.partitionBy(*by).orderBy(order))
    steps = df.withColumn("_h", h).withColumn("_b", before)
    cells = [F.sum(F.when((F.col("_b") == a) & (F.col("_h") == b), 1.0).otherwise(0.0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    c = steps.groupBy(*by).agg(*cells)
    term = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(q)).otherwise(0.0)
    p01, p11 = F.col("n01") / (F.col("n00") + F.col("n01")), F.col("n11") / (F.col("n10") + F.col("n11"))
    p = (F.col("n01") + F.col("n11")) / (F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11"))
    apart = term("n00", 1 - p01) + term("n01", p01) + term("n10", 1 - p11) + term("n11", p11)
    same = term("n00", 1 - p) + term("n10", 1 - p) + term("n01", p) + term("n11", p)
    ind = c.withColumn("lr_ind", F.greatest(F.lit(0.0), -2 * (same - apart))).select(*by, "lr_ind")
    return kupiec(df, hit, alpha, by).withColumnsRenamed({"lr": "lr_uc", "p": "p_uc"}).join(ind, by).withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind")).withColumn("p_cc", F.exp(-F.col("lr_cc") / 2))


def weighted_tail(df: DataFrame, by: list[str], value: str, weight: str, alpha: float) -> DataFrame:
    """var: the first value in order at which the weight reached alpha of the total; es: the weighted mean up to it."""
    w = Window.partitionBy(*by).orderBy(value)
    x = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    x = x.withColumn("_c", F.sum(weight).over(w)).withColumn("_t", F.sum(weight).over(Window.partitionBy(*by)))
    first = x.filter(F.col("_c") >= alpha * F.col("_t") - 1e-12).groupBy(*by).agg(F.min(value).alias("var"))
    low = x.join(first, by).filter(F.col(value) <= F.col("var"))
    return low.groupBy(*by).agg(F.first("var").alias("var"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("es"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y over quantile bins of p."""
    cuts = df.agg(F.percentile(p, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(p)))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
