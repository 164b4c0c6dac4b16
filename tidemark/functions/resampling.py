"""The stationary bootstrap over long frames, and the model confidence set made of it.

A draw is a list of runs (start, length), not of rows. A run's sum is the difference of two running totals, so
a draw of n rows costs about 2 n / block rows of one join, and sums are taken before anything is put together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _even(*of: Column | str) -> Column:
    """A number in (0, 1] that depends on ``of`` alone, so that a task run again makes the same draws, and SQL too."""
    text = F.concat_ws("-", *((F.col(x) if isinstance(x, str) else x).cast("string") for x in of))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / float(1 << 52)


def runs(sizes: DataFrame, draws: int, block: float | None, seed: int = 0) -> DataFrame:
    """series_id, n, draw, start and length of the runs that make up each draw of n rows; sizes(series_id, n), with a
    column ``block`` where ``block`` is None.

    Starts are even over the rows; lengths are geometric with mean ``block``, and the last run of a draw is cut.
    So many runs are made that they fall short with a chance below 1e-8; the last would then take the rest.
    """
    mean = F.col("block").cast("double") if block is None else F.lit(float(block))
    most = F.ceil(F.col("n") / mean + 6 * F.sqrt(F.col("n") / mean) + 10).cast("int")
    each = sizes.withColumn("most", most).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("run", F.explode(F.sequence(F.lit(1), F.col("most"))))
    geometric = F.when(mean > 1, F.floor(F.log(_even("series_id", "draw", "run", F.lit(2 * seed))) / F.log(1 - 1 / mean)) + 1).otherwise(F.lit(1))
    start = F.least(F.floor(_even("series_id", "draw", "run", F.lit(2 * seed + 1)) * F.col("n")), F.col("n") - 1)
    w = Window.partitionBy("series_id", "draw").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"start": start, "long": geometric}).withColumn("before", F.coalesce(F.sum("long").over(w), F.lit(0)))
    left = F.col("n") - F.col("before")
    return each.filter(left > 0).select("series_id", "n", "draw", "start", F.when(F.col("run") == F.col("most"), left).otherwise(F.least("long", left)).alias("length"))


def bootstrap_sums(df: DataFrame, values: list[str], draws: int, block: float | None, seed: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """series_id, model, draw, n, and of each value its sum over the draw (``<value>_again``) and over the rows
    (``<value>_all``). All models of a series are drawn together, so they must have the same bars; several values go
    through the same runs, so that any statistic of sums can be put together from a draw.

    blocks(series_id, block): mean block lengths, where ``block`` is None."""
    w = Window.partitionBy("series_id", "model").orderBy("t")
    totals = df.withColumns({"k": F.row_number().over(w), **{f"c_{v}": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in values}})
    whole = df.groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"{v}_all") for v in values))
    sizes = whole.groupBy("series_id").agg(F.max("n").alias("n"))
    drawn = runs(sizes if blocks is None else sizes.join(blocks, "series_id"), draws, block, seed)
    end = F.col("start") + F.col("length")
    wraps = end > F.col("n")
    ends = F.array(F.struct(F.col("start").alias("k"), F.lit(-1).alias("sign")), F.struct(F.when(wraps, end - F.col("n")).otherwise(end).alias("k"), F.lit(1).alias("sign")))
    times = drawn.groupBy("series_id", "draw").agg(F.sum(wraps.cast("int")).alias("wraps"))
    points = drawn.select("series_id", "draw", F.explode(ends).alias("x")).select("series_id", "draw", "x.*").groupBy("series_id", "draw", "k").agg(F.sum("sign").alias("sign")).filter("k > 0 AND sign <> 0")
    parts = points.join(totals.select("series_id", "model", "k", *(f"c_{v}" for v in values)), ["series_id", "k"]).groupBy("series_id", "model", "draw").agg(*(F.sum(F.col("sign") * F.col(f"c_{v}")).alias(f"p_{v}") for v in values))
    each = whole.join(times, "series_id").join(parts, ["series_id", "model", "draw"], "left")
    again = [(F.coalesce(f"p_{v}", F.lit(0.0)) + F.col("wraps") * F.col(f"{v}_all")).alias(f"{v}_again") for v in values]
    return each.select("series_id", "model", "draw", "n", *again, *(f"{v}_all" for v in values))


def bootstrap_means(losses: DataFrame, draws: int, block: float | None, seed: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """series_id, model, draw, mean of the draw (``again``) and of the rows (``mean``)."""
    s = bootstrap_sums(losses, ["loss"], draws, block, seed, blocks)
    return s.select("series_id", "model", "draw", (F.col("loss_again") / F.col("n")).alias("again"), (F.col("loss_all") / F.col("n")).alias("mean"))


def sharpe_difference(df: DataFrame, against: str, per_year: float, draws: int, block: float | None, seed: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """series_id, model, diff, p, low and high: every model's Sharpe ratio less that of the model ``against`` over the
    same bars, its two-sided p, and the bounds that hold 95 percent of the draws. df(series_id, t, model, r).

    A draw's ratio comes from its sums of returns and squares, with returns taken from the mean of all rows. NULL
    where returns do not vary."""
    mean = F.avg("r").over(Window.partitionBy("series_id", "model"))
    x = df.withColumn("_m", mean).withColumn("x", F.col("r") - F.col("_m")).withColumn("xx", F.col("x") * F.col("x"))
    level = x.groupBy("series_id", "model").agg(F.first("_m").alias("_m"))
    sums = bootstrap_sums(x.select("series_id", "t", "model", "x", "xx"), ["x", "xx"], draws, block, seed, blocks).join(level, ["series_id", "model"])
    n = F.col("n")

    def ratio(suffix: str) -> Column:
        s, ss = F.col(f"x_{suffix}"), F.col(f"xx_{suffix}")
        variance = (ss - s * s / n) / (n - 1)
        return F.when(variance > 0, (F.col("_m") + s / n) / F.sqrt(variance) * math.sqrt(per_year))

    rated = sums.select("series_id", "model", "draw", ratio("again").alias("again"), ratio("all").alias("sharpe"))
    other = rated.filter(F.col("model") == against).select("series_id", "draw", F.col("again").alias("_again"), F.col("sharpe").alias("_sharpe"))
    apart = rated.filter(F.col("model") != against).join(other, ["series_id", "draw"]).withColumn("_d", F.col("again") - F.col("_again"))
    share = lambda c: F.avg(c.cast("double"))
    return apart.groupBy("series_id", "model").agg(
        F.first(F.col("sharpe") - F.col("_sharpe")).alias("diff"), F.least(F.lit(1.0), 2 * F.least(share(F.col("_d") <= 0), share(F.col("_d") >= 0))).alias("p"),
        F.percentile("_d", F.lit(0.025)).alias("low"), F.percentile("_d", F.lit(0.975)).alias("high"),
    )


def confidence_set(losses: DataFrame, models: int, draws: int, block: float | None, seed: int = 0, blocks: DataFrame | None = None) -> DataFrame:
    """series_id, model, mean and p of losses(series_id, t, model, loss), with at most ``models`` models a series.

    The worst model by its studentised distance from the mean of those left goes first; p never falls from one
    removal to the next, and the last model has 1. A series' table is draws x models rows, whatever its length.
    """
    of_draw, of_model, of_series = (Window.partitionBy("series_id", *c) for c in (["draw"], ["model"], []))
    x = bootstrap_means(losses, draws, block, seed, blocks).withColumns({"noise": F.col("again") - F.col("mean"), "level": F.lit(0.0), "p": F.lit(None).cast("double")})
    for _ in range(models - 1):
        left = F.col("p").isNull()
        centred = lambda c: F.when(left, F.col(c) - F.avg(F.when(left, F.col(c))).over(of_draw))  # noqa: B023, E731
        x = x.withColumns({"_d": centred("mean"), "_z": centred("noise"), "_left": F.count(F.when(left, 1)).over(of_draw)})
        x = x.withColumn("_se", F.sqrt(F.avg(F.col("_z") * F.col("_z")).over(of_model)))
        x = x.withColumns({c: F.when(F.col("_se") > 0, F.col(c) / F.col("_se")).when(left, 0.0) for c in ("_d", "_z")})
        x = x.withColumns({"_most": F.max("_d").over(of_draw), "_chance": F.max("_z").over(of_draw), "_worst": F.max_by("model", "_d").over(of_draw)})
        x = x.withColumn("level", F.greatest("level", F.avg((F.col("_chance") >= F.col("_most")).cast("double")).over(of_series)))
        x = x.withColumn("p", F.when(left & (F.col("_left") > 1) & (F.col("model") == F.col("_worst")), F.col("level")).otherwise(F.col("p")))
    return x.filter("draw = 0").select("series_id", "model", "mean", F.coalesce("p", F.lit(1.0)).alias("p"))
