"""What the corpus operators share: written intermediate tables, digests, distributed numbering."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where unset (tests), one of our own.

    A cluster must name one: a folder of the driver's machine is not seen by executors elsewhere."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="spark-tidemark-"))
    return _own_root[0]


#: Bytes of rows that go to a Python worker at a time. By Spark's default, 64 MB, a batch is all of an input partition,
#: and the executor and its workers each hold it. Results do not depend on it.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = 8 << 20
#: Rows that a Parquet reader decodes at a time. By Spark's default, 4,096, their texts are one array of 8 to 16 MB a task.
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
FEW_ROWS = 1024


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends rows to Python workers in small batches."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


@cache
def _trim() -> Callable | None:
    """The C library's call that gives freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, giving back what it freed after each batch and at its end: Python workers live on
    between stages, and what they keep is taken from the stages that run then."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from work(each())
        give_back()

    return run


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows. It is made without Python workers: those of ``createDataFrame`` are not the ones that
    mapInArrow uses, and stay beside them."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


class Scratch:
    """Tables written in the shared folder. They cut lineage and outlive a lost executor.

    ``small``: what makes the tables sends rows to Python workers in small batches."""

    def __init__(self, spark: SparkSession, name: str, small: bool = False):
        self.spark, self.small = spark, small
        self.root = f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark) if self.small else contextlib.nullcontext():
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Where a row stands: names for its file and its number in it.
PLACE = ["_row_file", "_row_at"]
#: Places of rows that are broadcast at most (some 20 MB).
FEW = 100_000


def with_place(docs: DataFrame) -> DataFrame:
    """A DataFrame over files with the place of each row."""
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, over files, without the rows at the places in ``gone``; few places are broadcast, more are shuffled."""
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return with_place(docs).join(gone, PLACE, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def table_path(docs: DataFrame) -> str | None:
    """The path of the Parquet table that ``docs`` is, as it stands, or None."""
    files = docs.inputFiles()
    if not files:
        return None
    spark, folder = docs.sparkSession, files[0].rpartition("/")[0]
    known = [*files[:1], folder] if len(files) == 1 else [folder]
    # plain paths may have been given without their scheme, and plans of the same files then differ
    for path in [*known, *("/" + x.removeprefix("file:").lstrip("/") for x in known if x.startswith("file:"))]:
        try:
            if docs.sameSemantics(spark.read.parquet(path)):
                return path
        except AnalysisException:  # not a Parquet table
            continue
    return None


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int, per_bucket: int = 2000) -> DataFrame:
    """Gapless numbers from 0 within each key, without one task per key.

    Rows of a key are dealt into hash buckets of about ``per_bucket`` rows of the table (``rows`` is its
    size); a bucket's offset is the running count of the buckets before it. ``order`` decides within a
    bucket; rows equal in all of ``order`` get their numbers in any order. Column names that start with
    ``_nw_`` are reserved.
    """
    buckets = max(1, -(-rows // per_bucket))
    dealt = df.withColumn("_nw_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    by = [*keys, "_nw_b"]
    before = Window.partitionBy(*keys).orderBy("_nw_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_nw_n")).select(*by, F.coalesce(F.sum("_nw_n").over(before), F.lit(0)).alias("_nw_o"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return dealt.join(offsets, by).withColumn(out, F.col("_nw_o") + inside.cast("long") - 1).drop("_nw_b", "_nw_o")
