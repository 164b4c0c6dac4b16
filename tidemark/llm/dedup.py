"""Exact deduplication by a stateful stream whose keyed state never expires.

The stream reads the table's files as they stand. Its state (RocksDB: on disk, not on the heap) keeps for
each content digest the row count, a stable identifier (the largest document id) and a content locator
(file and row in it) of the row to keep. On hits, rows whose digest the state has seen, full bytes are held
against each other; rows that share a digest but not the bytes are grouped anew by their bytes.

Everything on the way is DataFrame and Structured Streaming built-ins.

Defined cases: a null text counts as empty; a null id sorts before every other and two rows with one id are
told apart by their locators, so that exactly one row of a group stays; an empty table gives an empty
result; other columns are not read, so their names cannot clash (those of ``PLACE`` are reserved in ``dedup``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PLACE, READ_ROWS, Scratch, lower_ascii, no_rows, table_path, without_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_BATCH = 4096
SALTS = 64
#: Hashes of repeated digests that are broadcast at most; beyond that, their texts are found by a shuffle.
MARKS = 2_000_000


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator(id_col: str) -> Column:
    meta = F.col("_metadata")
    return F.struct(F.col(id_col).alias("id"), meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def stream_state(spark: SparkSession, path: str, scratch: Scratch, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """digest, n, keeper(id, file, row): what the stream's state holds once all files have been read.

    Every micro-batch writes the keys that it changed, under its batch number, so that a batch that is run
    again after a failure replaces its own output. Counts and keepers only grow, so a key's last state is
    its largest.
    """
    schema = spark.read.parquet(path).schema
    session = spark.newSession()
    for key, value in {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # small stores would each hold blocks they do not fill
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        **{key: spark.conf.get(key) for key in ("spark.sql.shuffle.partitions", READ_ROWS)},
    }.items():
        session.conf.set(key, value)
    # as a pattern, the path may also be a single file; the stream's reader takes plain paths for folders
    files = f"{path[:-1]}[{path[-1]}]"
    rows = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(files)
    keyed = rows.select(digest(normalised(F.col(text_col))).alias("digest"), _locator(id_col).alias("loc"))
    state = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("loc").alias("keeper"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(scratch.path(f"state/batch={number}"))

    query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    # an empty table has no batch: a table of no rows gives the folder its schema
    no_rows(spark, state.schema).write.mode("overwrite").parquet(scratch.path("state/batch=-1"))
    return spark.read.schema(state.schema).parquet(scratch.path("state")).groupBy("digest").agg(F.max("n").alias("n"), F.max("keeper").alias("keeper"))


def dedup_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row for each row of the Parquet table at ``path``: id, loc (id, file, row), digest, keep_id, n, kept.

    Only digests and locators are shuffled to the state, those of frequent digests (a thousandth of all rows and
    more, so a thousand digests at most) over ``SALTS`` partitions. Texts move only on hits: of each digest seen
    more than once, the least and the largest bytes are found, and if they differ, its rows are grouped anew.
    """
    scratch = Scratch(spark, "dedup")
    state = scratch.table(stream_state(spark, path, scratch, id_col, text_col, digest, files_per_batch), "state-last")
    total, repeated = state.agg(F.sum("n"), F.count(F.when(F.col("n") > 1, 1))).first()
    frequent = F.broadcast(state.filter((F.col("n") > 1) & (F.col("n") * 1000 >= F.lit(total or 0))).select("digest", F.lit(True).alias("frequent")))
    docs = spark.read.parquet(path)
    key = digest(normalised(F.col(text_col))).alias("digest")
    salt = F.when(F.col("frequent"), F.pmod(F.xxhash64("loc.file", "loc.row"), F.lit(SALTS))).otherwise(0).cast("long").alias("salt")
    rows = docs.select(key, _locator(id_col).alias("loc")).join(frequent, "digest", "left").select("digest", "loc", salt)
    salts = F.when(F.col("frequent"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    known = state.join(frequent, "digest", "left").select("digest", "n", "keeper", F.explode(salts).alias("salt"))
    assigned = rows.join(known, ["digest", "salt"])
    assigned = scratch.table(assigned.select(F.col("loc.id").alias("id"), "loc", "digest", F.col("keeper.id").alias("keep_id"), "n", (F.col("loc") == F.col("keeper")).alias("kept")), "assigned")
    if not repeated:
        return assigned
    with_bytes = docs.select(key, _locator(id_col).alias("loc"), normalised(F.col(text_col)).alias("bytes"))
    marks = state.filter("n > 1").select(F.xxhash64("digest").alias("mark")).distinct()
    hits = with_bytes.withColumn("mark", F.xxhash64("digest")).join(F.broadcast(marks) if repeated <= MARKS else marks, "mark", "left_semi")
    bytes_of = hits.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    differing = scratch.table(bytes_of.filter("least <> most").select("digest"), "differing")
    if differing.isEmpty():
        return assigned
    again = with_bytes.join(differing, "digest", "left_semi")
    groups = again.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("loc").alias("keeper"))
    regrouped = again.join(groups, ["digest", "bytes"]).select(F.col("loc.id").alias("id"), "loc", "digest", F.col("keeper.id").alias("keep_id"), "n", (F.col("loc") == F.col("keeper")).alias("kept"))
    return assigned.join(differing, "digest", "left_anti").select(*regrouped.columns).unionByName(regrouped)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of any DataFrame, with its own columns. As a stream reads files, it is written first unless
    it is a Parquet table as it stands."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup-input")
    path = table_path(docs)
    if path is None:
        path = scratch.path("rows")
        docs = scratch.table(docs, "rows")
    gone = dedup_table(spark, path, id_col, text_col).filter(~F.col("kept")).select("loc.file", "loc.row")
    return without_rows(docs, scratch.table(gone.toDF(*PLACE), "gone"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_table(spark, f"{sf_dir}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
