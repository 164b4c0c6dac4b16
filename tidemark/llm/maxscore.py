"""Exact top-k by inner product with MaxScore over sharded postings.

A vector's terms are its components, quantised to whole numbers. A shard keeps for each term its postings
(the component of each of the shard's rows, in vec_id order) and the term's largest and smallest value, which
bound what a query's weight can gain from the term. Contributions are measured from the least that the shard
can give, so that all are 0 or more. For a query, terms are ordered by their bounds; those whose bounds
together cannot lift a row to the query's current k-th score are non-essential. The essential postings are
traversed in full; the rest are probed, the largest bound first, only for rows that are still competitive.
Scores that equal the k-th stay in, so ties are settled by vec_id alone.

Shards and blocks of queries have fixed sizes; each pair of a shard and a block of queries is one group, and
every shard's k best for a query are merged at the end. Blocks are large, as every vector travels once for each.
Sums are exact: whole numbers in float64 while none can pass 2**53, else Python's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import Scratch

SHARD, QUERIES = 8192, 4096
SCALE = 64
EXACT, LONGEST = 2**53, 2**63 - 1


def shard_topk(ids: np.ndarray, postings: np.ndarray, query_ids: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vec_ids, scores) of each query's best rows in one shard.

    ids ascend; postings[d, j] is the component d of row j; weights[q, d].
    """
    terms, n = postings.shape
    low, high = postings.min(axis=1), postings.max(axis=1)
    head = min(n, 16 * k)
    for query, w in zip(query_ids, weights, strict=True):
        gain = np.maximum(w * high, w * low)  # the most that each term can give
        least = np.minimum(w * high, w * low)
        bound = gain - least
        order = np.argsort(-bound, kind="stable")
        reach = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]  # of the terms from each place on
        base = least.sum()
        # the first rows give a first k-th score
        seed = w @ postings[:, :head]
        seed = seed[ids[:head] != query]
        floor = np.partition(seed, len(seed) - k)[len(seed) - k] - base if len(seed) >= k else 0
        essential = max(1, int(np.count_nonzero(reach[:-1] >= floor)))
        front = order[:essential]
        score = w[front] @ postings[front] - least[front].sum()
        alive = np.flatnonzero((score + reach[essential] >= floor) & (ids != query))
        score = score[alive]
        place = essential
        while place < terms and len(alive):
            if len(alive) > k:
                # what a row has reached so far is a lower bound of its score
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
                ok = score + reach[place] >= floor
                alive, score = alive[ok], score[ok]
            step = order[place : place + 4]
            score = score + w[step] @ postings[np.ix_(step, alive)] - least[step].sum()
            place += len(step)
        by_id = np.argsort(ids[alive], kind="stable")
        best = by_id[np.argsort(-score[by_id], kind="stable")][:k]
        total = score[best] + base
        if total.dtype == object:  # beyond 64 bits the largest long stands for a score
            total = np.array([max(-LONGEST - 1, min(LONGEST, int(x))) for x in total], np.int64)
        yield int(query), ids[alive[best]], total.astype(np.int64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose id is divisible by ``every``.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an
    id. A row is no candidate of a query with its own id. Fewer than k candidates give all of them; rows
    that repeat an id are candidates each. Vectors of different lengths are compared over the longer one,
    missing components counting as 0. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    wide = F.transform(vector_col, lambda x: x.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform("x", lambda v: F.floor(v * SCALE))
    rows = scratch.table(vectors.select(F.col(id_col).alias("id"), wide.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(finite).select("id", whole.alias("x")), "rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("terms"), F.count(F.when(F.pmod("id", F.lit(every)) == 0, 1)).alias("q")).first()
    terms = size["terms"] or 0
    shards, blocks = max(1, -(-size["n"] // shard)), max(1, -(-size["q"] // block))
    hashed = F.xxhash64("id", F.monotonically_increasing_id())
    candidates = rows.withColumn("s", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(False))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("b", F.pmod(hashed, F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("query", F.lit(True))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        is_query = table.column("query").combine_chunks().to_numpy(zero_copy_only=False)
        x = table.column("x").combine_chunks()
        lengths = np.diff(x.offsets.to_numpy())
        most = float(np.abs(x.flatten().to_numpy().astype(float)).max()) if len(x.flatten()) else 0.0
        dense = np.zeros((len(ids), terms), np.int64 if most * most * terms >= EXACT else float)
        dense[np.repeat(np.arange(len(ids)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x.flatten().to_numpy()
        dense = dense.astype(object) if dense.dtype == np.int64 else dense
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        rows_at, query_at = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        if len(rows_at) and len(query_at):
            rows_at = rows_at[np.argsort(ids[rows_at], kind="stable")]
            out = list(shard_topk(ids[rows_at], np.ascontiguousarray(dense[rows_at].T), ids[query_at], dense[query_at], k))
        join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"query_id": join([np.full(len(v), q) for q, v, _ in out]), "vec_id": join([v for _, v, _ in out]), "score": join([s for _, _, s in out])})

    found = candidates.select("s", "b", "query", "id", "x").unionByName(asked.select("s", "b", "query", "id", "x")).groupBy("s", "b").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
