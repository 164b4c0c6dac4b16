"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one remainder. Only the histogram of remainder lengths, one number
for each length below the sequence length, goes to the driver. There lengths are placed from the longest to
the shortest: as many as fit go to the packs with the most room, and packs are counted by pattern (a list of
lengths), so the work depends on the number of patterns, not of documents. Patterns are then joined back to
the pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import merger
from .shared import Scratch, give_back, lean, number_within
from .token_counts import slices, vocabulary

END = 1


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs of ``histogram`` (length -> pieces), as (lengths, number of such packs)."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in by_room.items() if packs and r >= length), default=None)
            if room is None:
                # a new pack may take several: opened singly, they would be the next to be filled anyway
                each = size // length
                if left >= each:
                    add(size - each * length, (length,) * each, left // each)
                    left %= each
                else:
                    add(size - left * length, (length,) * left, 1)
                    left = 0
                continue
            pattern, n = next(iter(by_room[room].items()))
            take = min(n, left)
            if take == n:
                del by_room[room][pattern]
            else:
                by_room[room][pattern] = n - take
            add(room - length, (*pattern, length), take)
            left -= take
    return [(p, n) for packs in by_room.values() for p, n in packs.items()]


def pieces(docs: DataFrame, size: int, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """The pieces of every document: full sequences first, then the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, pattern)
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                ids, counts = m.encode_array(texts)
                total = counts + 1
                ends = np.cumsum(total)
                whole = np.full(int(total.sum()), END, "<u4")
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                n = -(-total // size)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[row] - start)
                at = 4 * ((ends - total)[row] + start)
                raw = memoryview(whole.tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).take(pa.array(row + lo)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))], ["id", "start", "length", "ids_crc32", "doc_tokens"])
                give_back()

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, size: int, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    A null or empty text is the end token alone. Rows with equal or null ids are documents of their own;
    pieces that are equal in every column may swap places. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.table(pieces(docs, size, path, pattern, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, first, used = [], 0, defaultdict(int)
    for lengths, n in patterns(histogram, size):
        offset = 0
        for length in lengths:
            # ranks used[length] to used[length] + n of this length fill this place of the n packs
            rows.append((length, used[length], used[length] + n, first, offset))
            used[length] += n
            offset += length
        first += n
    columns = ("length", "rank_from", "rank_to", "first_sequence", "offset")
    # its size is bounded by the histogram's, whatever the number of documents; from an Arrow table, no Python workers make it
    table = pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(columns)})
    places = scratch.table(spark.createDataFrame(table).coalesce(1), "places")
    ranked = number_within(cut, ["length"], ["id", "start", "ids_crc32"], "rank", sum(histogram.values()))
    found = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["rank"] >= places["rank_from"]) & (ranked["rank"] < places["rank_to"]))
    return found.select("id", "start", ranked["length"], "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2048, *vocabulary())
    return out.withColumnRenamed("id", "doc_id")
