"""Bars from zipped exchange files: a file a month, and a file a day for months that have none yet.

Archives are listed and read by Spark's own file source, so they may lie in any store that Spark reads. A task holds
one archive at a time and hands its lines on in batches.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import PRICES, clean, klines

#: name-interval-month.zip or name-interval-month-day.zip
NAME = r"([^/]+)-([^/-]+)-(\d{4}-\d{2})(-\d{2})?\.zip$"
LINES = 10_000


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """series_id, interval, month, day (NULL for a file of a month), path and content of the archives below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    part = lambda i: F.regexp_extract("path", NAME, i)
    named = files.filter(F.col("path").rlike(NAME)).select(part(1).alias("series_id"), part(2).alias("interval"), part(3).alias("month"), F.nullif(part(4), F.lit("")).alias("day"), "path", "content")
    return named


def chosen_files(files: DataFrame) -> DataFrame:
    """Files of months, and files of days only for the months that have none."""
    months = files.filter("day IS NULL").select("series_id", "interval", "month").distinct()
    return files.filter("day IS NULL").unionByName(files.filter("day IS NOT NULL").join(months, ["series_id", "interval", "month"], "left_anti"))


def archive_lines(files: DataFrame) -> DataFrame:
    """series_id, interval, path, at (place of the line in its file) and line; lines that do not start with a digit, such as
    headers, are dropped. A file that is no archive, or is empty, has no lines."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                series, interval, path = (batch.column(c)[i].as_py() for c in (0, 1, 2))

                def rows(lines: list, series=series, interval=interval, path=path) -> pa.RecordBatch:
                    n = len(lines)
                    return pa.record_batch([pa.array([series] * n), pa.array([interval] * n), pa.array([path] * n), pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines])], ["series_id", "interval", "path", "at", "line"])

                blob = io.BytesIO(batch.column(3)[i].as_buffer())
                if not zipfile.is_zipfile(blob):
                    continue
                with zipfile.ZipFile(blob) as z:
                    held, at = [], 0
                    for member in sorted(n for n in z.namelist() if not n.endswith("/")):
                        with z.open(member) as f:
                            for raw in io.TextIOWrapper(f, "utf-8", errors="replace"):
                                line = raw.strip()
                                if line[:1].isdigit():
                                    held.append((at, line))
                                at += 1
                                if len(held) >= LINES:
                                    yield rows(held)
                                    held = []
                    if held:
                        yield rows(held)

    return files.select("series_id", "interval", "path", "content").mapInArrow(unpack, "series_id string, interval string, path string, at long, line string")


def read_archives(spark: SparkSession, path: str, interval: str) -> DataFrame:
    """Clean bars of one interval from all archives below a folder; of duplicate times the first line counts, months
    before days, then by file and place."""
    lines = archive_lines(chosen_files(archive_files(spark, path).filter(F.col("interval") == interval)))
    parts = F.split("line", ",")
    fields = ["epoch", *PRICES, "volume"]
    raw = lines.select("series_id", "path", "at", *(F.get(parts, i).alias(c) for i, c in enumerate(fields))).withColumn("epoch", F.expr("try_cast(epoch AS bigint)")).filter("epoch IS NOT NULL")
    numbers = raw.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in (*PRICES, "volume")})
    bars = klines(numbers.withColumn("series_id", F.struct("series_id", "path", "at")))
    flat = bars.select("series_id.*", "ts", *PRICES, "volume")
    return clean(flat, ["path", "at"]).drop("path", "at")
