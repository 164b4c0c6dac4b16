"""Series made from the tables, and the SQL that makes the same ones. Times leave as text or as ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.lineage import kept
from tidemark.sources.bars import numbered, ticks_to_bars


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars, a series for each type of event."""
    return ticks_to_bars(events(spark, d), F.date_trunc("hour", "ts"), ["ts", "event_id"], F.col("event_type"))


def quarter_hours(spark: SparkSession, d: str) -> DataFrame:
    """Bars of 15 minutes of all events."""
    return ticks_to_bars(events(spark, d), F.window("ts", "15 minutes")["start"], ["ts", "event_id"], F.lit("all"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of order prices, a series for each of the five priorities."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), "o_totalprice", "o_orderpriority")
    return ticks_to_bars(orders, F.date_trunc("day", "ts"), ["ts", "o_orderkey"], F.col("o_orderpriority"), "o_totalprice")


def order_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of all orders."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), "o_totalprice")
    return ticks_to_bars(orders, F.date_trunc("day", "ts"), ["ts", "o_orderkey"], F.lit("orders"), "o_totalprice")


def _bars_sql(name: str, table: str, series: str, bucket: str, order: str, price: str) -> str:
    return f"""
{name}_raw AS (SELECT {series} AS series_id, {bucket} AS ts, first({price} ORDER BY {order}) AS open, max({price}) AS high, min({price}) AS low,
  last({price} ORDER BY {order}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM {table} WHERE {price} > 0 GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS t FROM {name}_raw)"""


HOURLY = _bars_sql("bars", "events", "event_type", "date_trunc('hour', ts)", "ts, event_id", "value")
QUARTER = _bars_sql("fine", "events", "'all'", "time_bucket(INTERVAL 15 MINUTES, ts)", "ts, event_id", "value")
DAILY = _bars_sql("bars", "orders", "o_orderpriority", "date_trunc('day', o_orderdate)", "o_orderdate, o_orderkey", "o_totalprice")
ORDER_DAYS = _bars_sql("bars", "orders", "'orders'", "date_trunc('day', o_orderdate)", "o_orderdate, o_orderkey", "o_totalprice")

W = "PARTITION BY series_id ORDER BY t"
#: r: log returns; tr: true range.
RETURNS = f"""
rets AS (SELECT *, coalesce(ln(close / lag(close) OVER w), 0.0) AS r,
  CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM bars WINDOW w AS ({W}))"""


def ewma_sql(name: str, halflife: float, column: str = "r", source: str = "rets") -> str:
    """Recursive: name(series_id, t, v) with v the variance."""
    keep = repr(0.5 ** (1 / halflife))
    return f"""
{name}_seed AS (SELECT series_id, avg({column} * {column}) FILTER (t >= 1 AND t < 50) AS v FROM {source} GROUP BY 1),
{name} AS (SELECT x.series_id, x.t, CAST({keep} AS DOUBLE) * s.v + (1 - CAST({keep} AS DOUBLE)) * x.{column} * x.{column} AS v FROM {source} x JOIN {name}_seed s USING (series_id) WHERE x.t = 0
  UNION ALL SELECT x.series_id, x.t, CAST({keep} AS DOUBLE) * e.v + (1 - CAST({keep} AS DOUBLE)) * x.{column} * x.{column} FROM {name} e JOIN {source} x ON x.series_id = e.series_id AND x.t = e.t + 1)"""


def atr_sql(name: str, n: int) -> str:
    return f"""
{name}_seed AS (SELECT series_id, avg(tr) AS v, count(*) AS n FROM rets WHERE t < {n} GROUP BY 1),
{name} AS (SELECT series_id, CAST({n - 1} AS BIGINT) AS t, v AS atr FROM {name}_seed WHERE n = {n}
  UNION ALL SELECT x.series_id, x.t, (e.atr * {n - 1} + x.tr) / {n} FROM {name} e JOIN rets x ON x.series_id = e.series_id AND x.t = e.t + 1)"""


def whole(expr: str, x: str, frame: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER ({W} {frame}) = {n} THEN {expr} OVER ({W} {frame}) END"


def rows(n: int, lag: int = 0) -> str:
    return f"ROWS BETWEEN {n - 1 + lag} PRECEDING AND {lag} PRECEDING" if lag else f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def ahead(n: int) -> str:
    return f"ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING"


__all__ = ["ahead", "atr_sql", "daily", "events", "ewma_sql", "hourly", "kept", "numbered", "order_days", "quarter_hours", "rows", "whole"]
