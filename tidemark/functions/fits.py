"""Fits of all groups together: each step is one pass that adds up what every group's next step needs.

A group's rows are never brought together; a step moves a few sums per group and partition. Parameters are a small
frame, one row a group, that is joined to the rows for the next step.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distributions import log_gamma
from .lineage import kept

#: Keeps a step finite where a group's values do not tell its parameters apart.
RIDGE = 1e-9
#: The degrees of freedom that are searched.
LEAST, MOST = 2.1, 60.0


def logistic_fits(rows: DataFrame, by: list[str], x: str, y: str, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """by, w0 and w1 (intercept and slope) of y, 0 or 1, by Newton's method without a penalty; rows without x or y are
    left out."""
    own = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x)).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    own = kept(own)  # read in every step
    at = own.select(*by).distinct().select(*by, F.lit(0.0).alias("w0"), F.lit(0.0).alias("w1"), F.lit(1.0).alias("_step"))
    for _ in range(rounds):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("w0") + F.col("w1") * F.col("_x")))
        scored = own.join(at, by).withColumn("_p", 1 / (1 + F.exp(-z))).withColumn("_q", F.col("_p") * (1 - F.col("_p")))
        gap, q, v = F.col("_y") - F.col("_p"), F.col("_q"), F.col("_x")
        s = scored.groupBy(*by, "w0", "w1").agg(F.sum(gap).alias("g0"), F.sum(gap * v).alias("g1"), (F.sum(q) + RIDGE).alias("a"), F.sum(q * v).alias("b"), (F.sum(q * v * v) + RIDGE).alias("c"))
        area = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        s = s.withColumn("s0", (F.col("c") * F.col("g0") - F.col("b") * F.col("g1")) / area).withColumn("s1", (F.col("a") * F.col("g1") - F.col("b") * F.col("g0")) / area)
        at = kept(s.select(*by, (F.col("w0") + F.col("s0")).alias("w0"), (F.col("w1") + F.col("s1")).alias("w1"), F.greatest(F.abs("s0"), F.abs("s1")).alias("_step")))
        if (at.agg(F.max("_step")).first()[0] or 0.0) < tolerance:
            break
    return at.select(*by, "w0", "w1")


def student_freedom(rows: DataFrame, by: list[str], z: str, points: int = 9, tolerance: float = 1e-5) -> DataFrame:
    """by and nu: the degrees of freedom, between LEAST and MOST, of a t distribution of unit variance that make the
    values likeliest. All groups narrow their grids together; a pass adds up the likelihood at every point of a grid."""
    own = rows.filter(F.col(z).isNotNull() & ~F.isnan(z)).select(*by, (F.col(z) * F.col(z)).alias("_zz"))
    own = kept(own)  # read in every step
    at = own.select(*by).distinct().select(*by, F.lit(LEAST).alias("_lo"), F.lit(MOST).alias("_hi"))
    width = MOST - LEAST
    while width > tolerance:
        nu = [F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / (points - 1)) for i in range(points)]
        sums = own.join(at, by).groupBy(*by, "_lo", "_hi").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(F.log1p(F.col("_zz") / (v - 2))).alias(f"_s{i}") for i, v in enumerate(nu)))
        level = lambda v: log_gamma((v + 1) / 2) - log_gamma(v / 2) - 0.5 * F.log((v - 2) * math.pi)
        tried = F.array(*(F.struct((F.col("_n") * level(v) - (v + 1) / 2 * F.col(f"_s{i}")).alias("l"), F.lit(-i).alias("i")) for i, v in enumerate(nu)))
        best = -F.array_max(tried)["i"]
        step = (F.col("_hi") - F.col("_lo")) / (points - 1)
        at = kept(sums.withColumn("_best", best).select(*by, (F.col("_lo") + step * F.greatest(F.col("_best") - 1, F.lit(0))).alias("_lo"), (F.col("_lo") + step * F.least(F.col("_best") + 1, F.lit(points - 1))).alias("_hi")))
        width *= 2 / (points - 1)
    return at.select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias("nu"))
