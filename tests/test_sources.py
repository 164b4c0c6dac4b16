"""Archives, trade lists and pins."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trades
from tidemark.sources import archives, bars


def packed(path, lines, name="x.csv"):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, "\n".join(lines))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(blob.getvalue())


def line(ms, close, high=None, micro=False):
    return f"{ms * (1000 if micro else 1)},{close},{high or close + 1},{close - 1},{close},2.5,9,9,9"


HOUR = 3_600_000
JAN, FEB = 1_672_531_200_000, 1_675_209_600_000  # 2023


def test_archives_of_months_and_days(spark, tmp_path):
    packed(tmp_path / "monthly" / "AAA-1h-2023-01.zip", ["open_time,open,high", line(JAN, 10.0), line(JAN + HOUR, 11.0), line(JAN, 99.0), "", "garbage"])
    packed(tmp_path / "daily" / "AAA-1h-2023-01-05.zip", [line(JAN + 4 * 24 * HOUR, 55.0)])  # its month is there
    packed(tmp_path / "daily" / "AAA-1h-2023-02-01.zip", [line(FEB, 20.0, micro=False)])
    packed(tmp_path / "daily" / "AAA-1h-2023-02-02.zip", [line(FEB + 24 * HOUR, 21.0), line(FEB + 25 * HOUR, 22.0, high=1.0)])  # high below low
    packed(tmp_path / "daily" / "BBB-1h-2025-01-01.zip", [line(1_735_689_600_000, 5.0, micro=True), "1735693200000000,1,2"])
    packed(tmp_path / "daily" / "AAA-1d-2023-02-01.zip", [line(FEB, 1.0)])
    packed(tmp_path / "empty" / "CCC-1h-2023-02.zip", [])
    (tmp_path / "empty" / "DDD-1h-2023-02.zip").write_bytes(b"not an archive")
    (tmp_path / "empty" / "readme.zip").write_bytes(b"")
    got = archives.read_archives(spark, str(tmp_path), "1h")
    rows = {(r.series_id, r.t): (r.ts.strftime("%Y-%m-%d %H"), r.close) for r in got.withColumn("ts", F.col("ts")).collect()}
    assert rows == {
        ("AAA", 0): ("2023-01-01 00", 10.0), ("AAA", 1): ("2023-01-01 01", 11.0), ("AAA", 2): ("2023-02-01 00", 20.0), ("AAA", 3): ("2023-02-02 00", 21.0), ("BBB", 0): ("2025-01-01 00", 5.0),
    }
    names = {(r.series_id, r.month, r.day) for r in archives.chosen_files(archives.archive_files(spark, str(tmp_path))).filter("interval = '1h'").collect()}
    assert ("AAA", "2023-01", "-05") not in names and ("AAA", "2023-02", "-02") in names


def test_trade_list_with_any_names(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Trade #,Type,Signal,Date/Time,Price USD,Qty\n1,Entry long,a,2024-07-01 10:00,100,1\n1,Exit long,b,2024-07-01 12:00,101,1\n2,entry SHORT,c,2024-07-02 10:00,50,1\n2,exit short,d,2024-07-02 11:00,49,1\n3,Entry long,e,2024-07-03 10:00,70,1\n")
    got = {r.trade: r for r in bars.read_trades(spark, f"{tmp_path}/t.csv", "Europe/Berlin").collect()}
    assert set(got) == {"1", "2"} and (got["1"].dir, got["2"].dir) == (1, -1) and got["1"].exit_price == 101
    assert got["1"].entry_time.strftime("%H:%M") == "08:00"
    with pytest.raises(ValueError):
        bars.column_like(["a", "b"], "price")


def test_match_report(spark):
    schema = "entry_time timestamp, dir int, entry_price double, exit_time timestamp, exit_price double"
    at = lambda df: df.withColumns({c: F.timestamp_seconds(c) for c in ("entry_time", "exit_time")})
    schema = schema.replace("timestamp", "long")
    theirs = at(spark.createDataFrame([(10, 1, 100.0, 20, 101.0), (30, -1, 100.0, 40, 99.0), (50, 1, 100.0, 60, 90.0)], schema))
    ours = at(spark.createDataFrame([(5, 1, 1.0, 6, 1.0), (10, 1, 100.001, 20, 101.0), (30, 1, 100.0, 40, 99.0), (50, 1, 102.0, 61, 90.0)], schema))
    r = trades.match_report(theirs, ours).first()
    assert (r.theirs, r.ours, r.matched, r.only_theirs, r.only_ours) == (3, 3, 2, 1, 1)
    assert (r.same_exit, r.entry_agrees, r.exit_agrees) == (0.5, 0.5, 1.0) and r.match_rate == pytest.approx(2 / 3)
    none = trades.match_report(theirs.limit(0), ours).first()
    assert none.matched == 0 and none.same_exit is None and none.match_rate == 0


def test_pins_are_verified(spark):
    rows = [(s, t * 3600, 1.0 + t) for s in ("a", "b", "c") for t in range(5)]
    df = bars.numbered(spark.createDataFrame(rows, "series_id string, s long, close double").select("series_id", F.timestamp_seconds("s").alias("ts"), *(F.col("close").alias(c) for c in bars.PRICES), F.lit(1.0).alias("volume")))
    pins = bars.digest(df)
    now = df.filter("series_id <> 'b' OR t < 4").withColumn("close", F.when((F.col("series_id") == "c") & (F.col("t") == 2), 9.0).otherwise(F.col("close")))
    more = pins.unionByName(spark.createDataFrame([("gone", 5, "x")], pins.schema))
    got = {r.series_id: (r.rows_agree, r.sha_agree) for r in bars.verified(now, more).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, False), "gone": (False, False)}
