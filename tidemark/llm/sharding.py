"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Differencing repeatedly takes the two partial partitions with the largest spread and adds them oppositely
ordered, the heaviest part of one to the lightest of the other. It runs level by level, so that no task and
not the driver ever holds all groups: at each level items are dealt into batches by a hash, each batch is
differenced into parts, and a batch's parts are the next level's items (about one for ``FAN_IN`` items).
Some items go on alone: parts of like weight can only be shared out whole, single items level them. When at most ``TOP`` items are left, one task differences them into the shards. An item that outweighs the
others of its batch keeps a part to itself, so the top level still balances against it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, number_within

BATCH, FAN_IN, TOP = 8192, 64, 16384
#: One item in so many goes on to the next level alone.
ALONE = 16
OVERHEAD = 16


def difference(weights: np.ndarray, parts: int) -> np.ndarray:
    """The part, 0 to parts-1, of each weight; parts are numbered from the heaviest."""
    n = len(weights)
    if not n:
        return np.zeros(0, np.int64)
    sums: list[np.ndarray | None] = []
    heap = []
    for i, w in enumerate(np.asarray(weights, np.int64)):
        first = np.zeros(parts, np.int64)
        first[0] = w
        sums.append(first)  # heaviest part first, the lightest always 0
        heap.append((-int(w), i))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        merged.append((a, b, order.astype(np.int32)))
        sums.append(both - both[-1])
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(sums) - 1))
    place: list[np.ndarray | None] = [None] * len(sums)
    place[-1] = np.arange(parts)
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        at = np.empty(parts, np.int64)
        at[order] = place[n + k]
        place[n + k] = None
        place[a], place[b] = at, at[::-1]
    return np.array([place[i][0] for i in range(n)])


def balance(items: DataFrame, shards: int, scratch: Scratch, batch: int = BATCH, fan_in: int = FAN_IN, top: int = TOP) -> DataFrame:
    """(item string, weight long), items distinct -> (item, shard int)."""

    def into_parts(parts_of, prefix: str):
        def f(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
            parts = parts_of(len(pdf))
            part = difference(pdf["weight"].to_numpy(), parts)
            return pd.DataFrame({"item": pdf["item"], "weight": pdf["weight"], "parent": [f"{prefix}{b}.{p}" for b, p in zip(pdf["b"], part, strict=True)], "part": part.astype(np.int32)})

        return f

    schema = "item string, weight long, parent string, part int"
    level, levels = items, []
    while (n := level.count()) > top:
        batches = -(-n // batch)
        dealt = level.withColumn("b", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(batches)))
        alone = F.pmod(F.xxhash64("item", F.lit("alone"), F.lit(len(levels))), F.lit(ALONE)) == 0
        joint = dealt.filter(~alone).groupBy("b").applyInPandas(into_parts(lambda k: max(1, k // fan_in), f"L{len(levels)}:"), schema)
        single = dealt.filter(alone).select("item", "weight", F.col("item").alias("parent"), F.lit(0).alias("part"))
        done = scratch.table(joint.unionByName(single), f"level{len(levels)}")
        levels.append(done)
        level = scratch.table(done.groupBy(F.col("parent").alias("item")).agg(F.sum("weight").alias("weight")), f"items{len(levels)}")
    last = level.withColumn("b", F.lit(0).cast("long")).groupBy("b").applyInPandas(into_parts(lambda k: shards, "T:"), schema)
    found = scratch.table(last.select("item", F.col("part").alias("shard")), "top")
    for done in reversed(levels):
        found = done.join(found.withColumnRenamed("item", "parent"), "parent").select("item", "shard")
    return found


def shard_table(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row; equal texts share a shard.

    Defined cases: null texts form one group of their own, of size ``OVERHEAD`` a row and the checksum of no
    bytes; with fewer groups than shards, some shards stay empty; rows with equal ids or null ids get slots
    of their own; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.col(text_col)
    slim = scratch.table(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("item"),
        ),
        "slim",
    )
    rows = slim.count()
    groups = scratch.table(slim.groupBy("item").agg(F.sum("size").alias("weight")), "groups")
    placed = scratch.table(slim.join(balance(groups, shards, scratch), "item").drop("item"), "placed")
    return number_within(placed, ["shard"], ["id", "crc", "size"], "slot", rows)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
