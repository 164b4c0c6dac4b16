"""From ticks and files to clean bars: series_id, ts, open, high, low, close, volume and the ordinal t."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

PRICES = ("open", "high", "low", "close")
BARS = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("ts", T.TimestampType()), *(T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume"))])


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("t", (F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1).cast("long"))


def ticks_to_bars(ticks: DataFrame, bucket: Column, order: list[str], series: Column, price: str = "value") -> DataFrame:
    """Tumbling bars of positive prices; empty buckets give no bar. ``order`` must be unique within a bucket."""
    at = F.struct(*order)
    return numbered(
        ticks.filter(F.col(price) > 0).groupBy(series.alias("series_id"), bucket.alias("ts"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )


def resample(bars: DataFrame, rule: str) -> DataFrame:
    """Coarser bars, closed and labelled on the left; rule is what date_trunc takes."""
    coarse = bars.groupBy("series_id", F.date_trunc(rule, "ts").alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return numbered(coarse)


def resample_to(bars: DataFrame, length: str) -> DataFrame:
    """Coarser bars of a length such as ``4 hours``, closed and labelled on the left, counted from the epoch."""
    coarse = bars.groupBy("series_id", F.window("ts", length)["start"].alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return numbered(coarse)


def clean(bars: DataFrame, order: list[str]) -> DataFrame:
    """First of each series' duplicate times (by ``order``), then only complete and valid bars.

    Duplicates go before the validity filter: if the first of them is invalid, none is left.
    """
    first = F.row_number().over(Window.partitionBy("series_id", "ts").orderBy(*order))
    kept = bars.dropna(subset=list(PRICES)).withColumn("_n", first).filter("_n = 1").drop("_n")
    return numbered(kept.filter("open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low").drop("t") if "t" in kept.columns else kept.filter("open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= low"))


def drop_bad_ticks(bars: DataFrame, k: float = 8, reversal: float = 0.7, window: int = 20) -> DataFrame:
    """Bars whose return is out of all proportion and is mostly taken back at once go."""
    w = Window.partitionBy("series_id").orderBy("t")
    before = w.rowsBetween(-window, -1)
    r = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    sd = F.when(F.count("_r").over(before) == window, F.stddev_samp("_r").over(before))
    after = F.lead("_r").over(w)
    bad = (F.abs("_r") > k * sd) & (F.signum(after) == -F.signum("_r")) & (F.abs(after) > reversal * F.abs("_r"))
    return r.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("NOT _bad").drop("_r", "_bad")


def intraday_variance(coarse: DataFrame, fine: DataFrame, rule: str) -> DataFrame:
    """coarse with rv: sum of squared fine log returns in each bar; without fine bars the bar's own square."""
    w = Window.partitionBy("series_id").orderBy("ts")
    r = F.log(F.col("close") / F.lag("close").over(w))
    rv = fine.withColumn("_r", r).groupBy("series_id", F.date_trunc(rule, "ts").alias("ts")).agg(F.sum(F.col("_r") * F.col("_r")).alias("rv"))
    own = coarse.withColumn("_r", r)
    return own.join(rv, ["series_id", "ts"], "left").withColumn("rv", F.coalesce("rv", F.col("_r") * F.col("_r"), F.lit(0.0))).drop("_r")


def klines(raw: DataFrame) -> DataFrame:
    """Exchange rows (epoch in ms, or in µs from 1e14 on, and five numbers as text) as bars."""
    ms = F.when(F.col("epoch") < F.lit(100_000_000_000_000), F.col("epoch")).otherwise(F.expr("epoch div 1000"))
    return raw.select("series_id", F.timestamp_millis(ms).alias("ts"), *(F.col(c).cast("double").alias(c) for c in (*PRICES, "volume")))


def adjust(bars: DataFrame, adjusted: str = "adj_close") -> DataFrame:
    """Prices times adjusted close over close."""
    factor = F.col(adjusted) / F.col("close")
    return bars.withColumns({c: F.col(c) * factor for c in PRICES})


def pinned(bars: DataFrame, ends: DataFrame) -> DataFrame:
    """Bars up to the end that ``ends`` pins for a series; other series lose their last, still forming bar."""
    last = F.max("ts").over(Window.partitionBy("series_id"))
    return bars.join(ends, "series_id", "left").withColumn("_last", last).filter(F.when(F.col("end").isNotNull(), F.col("ts") <= F.col("end")).otherwise(F.col("ts") < F.col("_last"))).drop("_last", "end")


def verified(bars: DataFrame, pins: DataFrame) -> DataFrame:
    """series_id, rows_agree and sha_agree of every pinned series: does it still hold the rows that were pinned?

    pins(series_id, n_rows, sha256), as ``digest`` gives them; a series that is gone agrees in nothing."""
    now = digest(bars).withColumnsRenamed({"n_rows": "_n", "sha256": "_sha"})
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return pins.join(now, "series_id", "left").select("series_id", same("n_rows", "_n").alias("rows_agree"), same("sha256", "_sha").alias("sha_agree"))


def digest(bars: DataFrame) -> DataFrame:
    """series_id, n_rows and a SHA-256 over its rows: of the sorted digests of days, so no series is one string."""
    line = F.concat_ws(",", F.col("ts").cast("string"), *(F.format_string("%.10g", F.col(c)) for c in (*PRICES, "volume")))
    days = bars.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return days.groupBy("series_id").agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "d"))), lambda x: x["d"]), ""), 256).alias("sha256"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """CSV (also compressed) with a header, in the BARS schema; rows whose time cannot be read are dropped."""
    return numbered(spark.read.schema(BARS).option("header", True).csv(path).filter(F.col("ts").isNotNull()))


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by series, so that readers of a few series read only those."""
    bars.write.mode("overwrite").partitionBy("series_id").parquet(path)


def long_enough(bars: DataFrame, least: int) -> DataFrame:
    """Only series of at least so many bars."""
    return bars.join(bars.groupBy("series_id").count().filter(F.col("count") >= least).select("series_id"), "series_id", "left_semi")


def column_like(columns: list[str], *words: str) -> str:
    """The first column whose name holds all the words, whatever its case."""
    for c in columns:
        if all(w in c.lower() for w in words):
            return c
    raise ValueError(f"no column with {' and '.join(words)} among {columns}")


def read_trades(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """A trade list from CSV whose column names only have to hold the words trade, type, date and price."""
    raw = spark.read.option("header", True).csv(path)
    names = {"trade": "trade", "type": "type", "at": "date", "price": "price"}
    picked = [F.col(f"`{column_like(raw.columns, word)}`").alias(name) for name, word in names.items()]
    return trade_list(raw.select(*picked).withColumns({"at": F.expr("try_cast(at AS timestamp)"), "price": F.expr("try_cast(price AS double)")}), tz)


def trade_list(raw: DataFrame, tz: str) -> DataFrame:
    """A trade list's two rows a trade (entry and exit) as one: trade, dir, entry and exit time and price.

    raw: trade, type, at (local time), price. Open trades, which have no exit, are left out.
    """
    side = F.lower("type")
    rows = raw.withColumn("utc", F.to_utc_timestamp("at", tz))
    entry = rows.filter(side.startswith("entry")).select("trade", F.when(side.contains("long"), 1).otherwise(-1).cast("tinyint").alias("dir"), F.col("utc").alias("entry_time"), F.col("price").alias("entry_price"))
    leave = rows.filter(side.startswith("exit")).select("trade", F.col("utc").alias("exit_time"), F.col("price").alias("exit_price"))
    return entry.join(leave, "trade").filter("exit_time IS NOT NULL")
