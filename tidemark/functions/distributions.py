"""Distributions and small tests as expressions: no row of a table of results leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .losses import average_ranks, normal_cdf, probabilistic_sharpe

SHIFT = 10
#: Terms of the continued fraction; more than the square root of any number of rows that a table of results has.
TERMS = 300
#: Up to so many values without ties the signed-rank test is exact, below so many there is none.
EXACT, LEAST = 50, 5


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + SHIFT, taken back by the recurrence; about 1e-13 for x > 0."""
    z = x + SHIFT
    back = F.log(x)
    for i in range(1, SHIFT):
        back = back + F.log(x + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back


def _beta_tail(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function where its continued fraction converges fast; read from the far end."""

    def step(under: Column, j: Column) -> Column:
        m = F.floor(j / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(j % 2 == 0, even).otherwise(odd) / under

    fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), step)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
    return front / fraction


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    inside = F.when(x < (a + 1) / (a + b + 2), _beta_tail(a, b, x)).otherwise(1 - _beta_tail(b, a, 1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_two_sided(t: Column, freedom: Column) -> Column:
    """Chance that a Student t value is as far from 0."""
    n = freedom.cast("double")
    return incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution: a rational start, good to 4.5e-4, and three Newton steps."""
    small = F.least(p, 1 - p)
    u = F.sqrt(-2 * F.log(small))
    start = u - (2.515517 + 0.802853 * u + 0.010328 * u * u) / (1 + 1.432788 * u + 0.189269 * u * u + 0.001308 * u * u * u)  # fixed values
    step = lambda z, _: z + ((1 - small) - normal_cdf(z)) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
    upper = F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, step)
    return F.when((p > 0) & (p < 1), F.signum(p - 0.5) * upper)


def t_test(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, mean, t and two-sided p per group of the test that the mean is 0; NULL where values do not vary."""
    s = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_sd"))
    s = s.withColumn("t", F.when(F.col("_sd") > 0, F.col("mean") / (F.col("_sd") / F.sqrt("n"))))
    return s.withColumn("p", F.when(F.col("t").isNotNull(), student_two_sided(F.col("t"), F.col("n") - 1))).drop("_sd")


def sign_test(wins: Column, n: Column) -> Column:
    """Chance of so many wins or more out of n at even odds."""
    chance = lambda k: F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) - n * math.log(2))
    return F.least(F.lit(1.0), F.aggregate(F.sequence(wins.cast("long"), n.cast("long")), F.lit(0.0), lambda s, k: s + chance(k)))


def signed_rank(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, w_plus (sum of positive ranks), p (two-sided), p_less and p_greater per group; zeros and missing values are left out.

    Up to EXACT values without ties the chances come from the number of ways that the ranks 1 to n give each sum,
    counted by adding one rank after the other to an array; else from the normal law with the tie correction. With
    fewer than LEAST values the chances are NULL."""
    own = df.filter(F.col(x).isNotNull() & ~F.isnan(x) & (F.col(x) != 0)).select(*by, F.col(x).alias("_x"), F.abs(x).alias("_size"))
    ties = own.groupBy(*by, "_size").agg(F.count(F.lit(1)).cast("double").alias("_c")).groupBy(*by).agg(F.sum(F.col("_c") * (F.col("_c") * F.col("_c") - 1)).alias("_ties"))
    ranked = average_ranks(own, by, "_size", "_k").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_x") > 0, F.col("_k")).otherwise(0.0)).alias("w_plus"))
    s = ranked.join(ties, by)
    n, w = F.col("n").cast("int"), F.col("w_plus")
    most = (n * (n + 1) / 2).cast("int")
    first = F.transform(F.sequence(F.lit(0), most), lambda i: (i == 0).cast("double"))
    with_rank = lambda ways, k: F.transform(ways, lambda v, i: (v + F.when(i >= k, F.element_at(ways, F.greatest(i - k, F.lit(0)) + 1)).otherwise(0.0)) / 2)
    exact = (n <= EXACT) & (F.col("_ties") == 0)
    s = s.withColumn("_ways", F.when(exact, F.aggregate(F.sequence(F.lit(1), n), first, with_rank)))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
    low, high = total(F.slice("_ways", F.lit(1), w.cast("int") + 1)), total(F.slice("_ways", w.cast("int") + 1, most - w.cast("int") + 1))
    spread = F.sqrt(n.cast("double") * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = (w - n.cast("double") * (n + 1) / 4) / spread
    s = s.withColumns({"_less": F.when(exact, low).when(spread > 0, normal_cdf(z)), "_more": F.when(exact, high).when(spread > 0, normal_cdf(-z))})
    enough = n >= LEAST
    return s.select(
        *by, "n", "w_plus", F.when(enough, F.least(F.lit(1.0), 2 * F.least("_less", "_more"))).alias("p"),
        F.when(enough, F.col("_less")).alias("p_less"), F.when(enough, F.col("_more")).alias("p_greater"),
    )


#: Fixed value: Euler's constant as the expected maximum of many trials takes it.
EULER = 0.5772156649


def expected_best(spread: Column, trials: Column) -> Column:
    """The largest Sharpe ratio to expect of so many trials without skill whose ratios have this deviation; 0 for one."""
    n = trials.cast("double")
    best = (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e))
    return F.when(n >= 2, F.coalesce(spread, F.lit(0.0)) * best).otherwise(0.0)


def deflated_sharpe(df: DataFrame, by: list[str], trial: list[str], r: str) -> DataFrame:
    """by, trial, sr, best (what luck alone would give) and dsr of every trial in a group: the chance that its true ratio is
    above what the best of all the group's trials would reach without skill. df has a row a bar and trial."""
    each = df.groupBy(*by, *trial).agg(F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r)).alias("_sr"))
    luck = each.groupBy(*by).agg(expected_best(F.stddev_samp("_sr"), F.count("_sr")).alias("best"))
    rated = probabilistic_sharpe(df.join(luck, by), [*by, *trial], r, "best").withColumnRenamed("psr", "dsr")
    return rated.join(luck, by).select(*by, *trial, "sr", "best", "dsr")


__all__ = ["deflated_sharpe", "expected_best", "incomplete_beta", "log_gamma", "normal_quantile", "sign_test", "signed_rank", "student_two_sided", "t_test"]
