"""Serial dependence of a series: autocovariances at many lags, and the block length that the bootstrap takes from them.

A series of n rows has about the root of n lags. Rows are dealt into spans as long as the largest lag, and each span
also gets the rows of the next one, so a span can make its share of every lag's sum; no task needs a series, and no
lag needs a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def autocovariances(df: DataFrame, x: str, by: list[str], order: str = "t") -> DataFrame:
    """by, n, quiet, lag and cov (sum of products of deviations at the lag, over n), for lags 0 to the root of n and
    ``quiet`` more; missing values are left out, the rest close up."""
    own = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, F.col(order).alias("_t"), F.col(x).cast("double").alias("_x"))
    size = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("_mean"))
    quiet = F.greatest(F.lit(5), F.ceil(F.log10(F.col("n")))).cast("int")
    size = size.withColumn("quiet", quiet).withColumn("lags", (F.ceil(F.sqrt("n")) + F.col("quiet")).cast("int"))
    placed = own.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_t")) - 1).join(size, by).withColumn("_x", F.col("_x") - F.col("_mean"))
    span = F.floor(F.col("_i") / F.col("lags"))
    dealt = placed.withColumn("_span", F.explode(F.when(span > 0, F.array(span, span - 1)).otherwise(F.array(span))))
    spans = dealt.groupBy(*by, "n", "quiet", "lags", "_span").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_rows"), F.sum((F.col("_span") == span).cast("int")).alias("_own"))
    values = F.transform("_rows", lambda r: r["_x"])
    spans = spans.select(*by, "n", "quiet", "lags", "_own", values.alias("_v")).filter("_own > 0")
    product = lambda k: F.aggregate(F.sequence(F.lit(1), F.col("_own")), F.lit(0.0), lambda s, i: s + F.col("_v")[i - 1] * F.coalesce(F.get("_v", i - 1 + k), F.lit(0.0)))
    shares = spans.select(*by, "n", "quiet", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("lags")), product)).alias("lag", "_part"))
    return shares.groupBy(*by, "n", "quiet", "lag").agg((F.sum("_part") / F.first("n")).alias("cov"))


def block_lengths(df: DataFrame, x: str, by: list[str], order: str = "t") -> DataFrame:
    """by and block: the mean block length of the stationary bootstrap by the flat-top rule of Politis and White, as
    corrected with Patton; from 1 to the lesser of three roots of n and a third of n. 1 where values do not vary."""
    c = autocovariances(df, x, by, order)
    w = Window.partitionBy(*by)
    base = F.max(F.when(F.col("lag") == 0, F.col("cov"))).over(w)
    small = F.abs(F.col("cov")) < base * 2 * F.sqrt(F.log10(F.col("n")) / F.col("n"))
    # the next ``quiet`` lags are all small: the running count of small ones grows by as many
    c = c.withColumn("_base", base).withColumn("_small", F.when(F.col("lag") > 0, small.cast("int")).otherwise(0))
    c = c.withColumn("_seen", F.sum("_small").over(w.orderBy("lag")))
    later = c.select(*by, (F.col("lag") - F.col("quiet")).alias("lag"), F.col("_seen").alias("_later"))
    c = c.join(later, [*by, "lag"], "left")
    still = F.min(F.when(F.col("_later") - F.col("_seen") == F.col("quiet"), F.col("lag"))).over(w)
    widest = F.max("lag").over(w)
    c = c.withColumn("_m", F.coalesce(F.least(2 * F.greatest(still, F.lit(1)), widest), widest)).filter(F.col("lag") <= F.col("_m"))
    taper = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - F.col("lag") / F.col("_m"))))
    twice = F.when(F.col("lag") > 0, 2.0).otherwise(1.0)
    s = c.groupBy(*by).agg(F.max("n").alias("n"), F.max("_base").alias("_base"), F.sum(twice * taper * F.col("lag") * F.col("cov")).alias("_g"), F.sum(twice * taper * F.col("cov")).alias("_s"))
    n, d = F.col("n").cast("double"), 2 * F.col("_s") * F.col("_s")
    length = F.cbrt(2 * F.col("_g") * F.col("_g") / d) * F.cbrt(n)
    top = F.ceil(F.least(3 * F.sqrt(n), n / 3)).cast("double")
    return s.select(*by, F.when((F.col("_base") > 0) & (d > 0), F.least(F.greatest(length, F.lit(1.0)), top)).otherwise(1.0).alias("block"))


def common_block(df: DataFrame, x: str, by: list[str], members: list[str], order: str = "t") -> DataFrame:
    """by and block: the rounded mean of the members' block lengths, at least 1 (halves go to the even number)."""
    each = block_lengths(df, x, [*by, *members], order)
    return each.groupBy(*by).agg(F.greatest(F.lit(1.0), F.bround(F.avg("block"))).alias("block"))
