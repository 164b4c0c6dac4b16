"""Exact quantiles of large groups by narrowing.

Every group looks for the two order statistics beside its quantile. All groups count their rows in ``CELLS`` cells
of the values still possible, keep the cell that holds the rank, and go on until few rows are left; a step is one
pass with partial counts, so no task ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .lineage import kept

CELLS, FEW = 256, 2048


def quantiles(df: DataFrame, by: list[str], x: str, q: float, out: str = "quantile", few: int = FEW) -> DataFrame:
    """by and the q-quantile with linear interpolation; missing values are left out."""
    rows = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, F.col(x).cast("double").alias("_x"))
    place = q * (F.col("_n") - 1)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    sought = kept(size.select(*by, "_lo", "_hi", F.col("_n").alias("_left"), (place - F.floor(place)).alias("_share"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(place).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(place).alias("rank")))).alias("_r")).select(*by, "_lo", "_hi", "_left", "_share", F.col("_r.side").alias("_side"), F.col("_r.rank").cast("long").alias("_rank")))
    inside = lambda: rows.join(sought, by).filter((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    while sought.filter((F.col("_left") > few) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        width = F.col("_hi") / CELLS - F.col("_lo") / CELLS
        cell = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(CELLS - 1))).otherwise(F.when(F.col("_x") > F.col("_lo"), 1).otherwise(0)).cast("int")
        keys = [*by, "_side", "_rank", "_share"]
        counts = inside().withColumn("_cell", cell).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_left"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        w = Window.partitionBy(*keys).orderBy("_cell")
        counts = counts.withColumn("_upto", F.sum("_left").over(w))
        found = counts.filter((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_left") <= F.col("_rank")))
        sought = kept(found.select(*by, "_lo", "_hi", "_left", "_share", "_side", (F.col("_rank") - F.col("_upto") + F.col("_left")).alias("_rank")))
    held = inside().groupBy(*by, "_side", "_rank", "_share", "_lo", "_hi").agg(F.when(F.first("_lo") == F.first("_hi"), F.array(F.first("_lo"))).otherwise(F.array_sort(F.collect_list(F.when(F.col("_lo") < F.col("_hi"), F.col("_x"))))).alias("_v"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.get("_v", F.col("_rank").cast("int")))
    sides = held.groupBy(*by).agg(F.max(F.when(F.col("_side") == 0, value)).alias("_a"), F.max(F.when(F.col("_side") == 1, value)).alias("_b"), F.first("_share").alias("_share"))
    return sides.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias(out))
