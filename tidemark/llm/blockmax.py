"""Ranked lexical search with Block-Max MaxScore over sharded, compressed postings.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased; a term is known by a
64-bit hash of its word. A shard is a run of rows of one input partition, so the index is built without a
shuffle; it lists for each of its terms the documents that hold it, in blocks of ``BLOCK``. A block is
compressed (gaps and counts as 7-bit groups) and carries what bounds the score of its documents: for
documents that hold the term once and for the others, the largest count and the shortest length.

For a query, terms are ordered by their global bounds. Lists are essential while the bounds from there on
could lift a document that was not yet seen to the k-th score; they are traversed. The other lists are only
probed for documents that are still competitive, and the maxima of their blocks reject documents before a
block is decompressed. Scores that equal the k-th stay in. Each shard gives its k best for a query, and
these are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import Scratch
from .words import NOT_ALNUM, split_words, text_chunks

BLOCK = 128
#: A shard ends with the document that reaches one of these.
SHARD_ROWS, SHARD_WORDS = 8192, 1_000_000
#: Rows and bytes of text that are worked on at a time.
ROWS, CHUNK = 512, 1 << 20
#: Groups of a shard and a block of queries in a task.
GROUPS = 4
#: Query terms in a block of queries.
QUERY_TERMS = 16_384
#: Decoded postings that a group keeps.
CACHED = 4_000_000
NEVER = 2**31 - 1


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): 7 bits a byte, the lowest first; all but the last byte have the high bit."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    more = place < np.repeat(size - 1, size)
    return ((np.repeat(values, size) >> (7 * place) & 127) | (more << 7)).astype(np.uint8), size


def from_varints(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    return 75 + (25 * np.where(n == NEVER, 0, n).astype(np.int64) * docs) // max(words, 1)


def _binary(buffers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive pieces of a buffer as binary values; sizes in bytes."""
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buffers))]).cast(pa.binary())


def shard_postings(terms: np.ndarray, docs: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    """One row per term of a shard. terms, docs: hash and document number of each word; n: words of each document."""
    order = np.lexsort((docs, terms))
    terms, docs = terms[order], docs[order]
    first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])])
    tf = np.diff(np.r_[first, len(terms)])
    terms, docs = terms[first], docs[first]
    lists = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
    df = np.diff(np.r_[lists, len(terms)])
    place = np.arange(len(terms)) - np.repeat(lists, df)
    blocks = np.flatnonzero(place % BLOCK == 0)
    counts = np.diff(np.r_[blocks, len(terms)])
    gap = np.diff(np.r_[0, docs]) - 1
    gap[lists] = docs[lists]
    values = np.empty(2 * len(docs), np.int64)
    values[0::2], values[1::2] = gap, tf - 1
    data, size = varints(values)
    size = size.reshape(-1, 2).sum(axis=1)
    once, long = tf == 1, n[docs]
    bounds = np.stack([
        np.maximum.reduceat(np.where(once, 1, 0), blocks), np.minimum.reduceat(np.where(once, long, NEVER), blocks),
        np.maximum.reduceat(np.where(once, 0, tf), blocks), np.minimum.reduceat(np.where(once, NEVER, long), blocks),
    ], axis=1).astype(np.int32)
    per_list = -(-df // BLOCK)
    of_list = np.cumsum(per_list) - per_list
    top = np.stack([(np.minimum if j % 2 else np.maximum).reduceat(bounds[:, j], of_list) for j in range(4)], axis=1)
    return {
        "term": pa.array(terms[lists].view(np.int64)),
        "df": pa.array(df.astype(np.int32)),
        "top": pa.FixedSizeListArray.from_arrays(pa.array(top.ravel()), 4).cast(pa.list_(pa.int32())),
        "last": _binary(docs[blocks + counts - 1].astype(np.int32), 4 * per_list),
        "sizes": _binary(np.add.reduceat(size, blocks).astype(np.int32), 4 * per_list),
        "bounds": _binary(bounds, 16 * per_list),
        "data": _binary(data, np.add.reduceat(size, lists)),
    }


class Postings:
    """One term's list in one shard; impacts are computed when a block is decompressed."""

    def __init__(self, df: int, last: bytes, sizes: bytes, bounds: bytes, data: bytes, m: np.ndarray, norms):
        self.last = np.frombuffer(last, np.int32)
        self.ends = np.cumsum(np.frombuffer(sizes, np.int32).astype(np.int64))
        self.counts = np.full(len(self.last), BLOCK)
        self.counts[-1] = df - BLOCK * (len(self.last) - 1)
        self.data, self.m, self.whole = np.frombuffer(data, np.uint8), m, None
        b = np.frombuffer(bounds, np.int32).reshape(-1, 4).astype(np.int64)
        self.most = np.maximum(impact(b[:, 0], norms(b[:, 1])), impact(b[:, 2], norms(b[:, 3])))

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of the blocks, which ascend."""
        begins = self.ends[blocks] - np.diff(np.r_[0, self.ends])[blocks]
        if len(blocks) == len(self.last):
            data = self.data
        else:
            data = np.concatenate([self.data[a:b] for a, b in zip(begins, self.ends[blocks], strict=True)])
        pairs = from_varints(data).reshape(-1, 2)
        counts = self.counts[blocks]
        starts = np.cumsum(counts) - counts
        base = np.where(blocks > 0, self.last[blocks - 1], -1).astype(np.int64)
        run = np.cumsum(pairs[:, 0] + 1)
        docs = run - np.repeat(run[starts] - pairs[starts, 0] - 1 - base, counts)
        return docs, impact(pairs[:, 1] + 1, self.m[docs])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            self.whole = self.decode(np.arange(len(self.last)))
        return self.whole

    def probe(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The impacts on the given documents (0 where one does not hold the term); block: of each, within the list."""
        held, value = self.whole or self.decode(np.unique(block))
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, value[at], 0)


def best(lists: list[Postings], gains: np.ndarray, bounds: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best with a score above 0; equal scores by the smaller number.

    gains: weight of each list times its repeats in the query; bounds: the most that its impact can be anywhere."""
    order = np.argsort(-(gains * bounds), kind="stable")
    reach = np.r_[np.cumsum((gains * bounds)[order][::-1])[::-1], 0]
    score = np.zeros(n_docs, np.int64)
    floor, place = 1, 0

    def kth(values: np.ndarray) -> int:
        return max(floor, int(np.partition(values, len(values) - k)[len(values) - k])) if len(values) >= k else floor

    while place < len(order) and reach[place] >= floor:  # essential
        docs, value = lists[order[place]].all()
        score[docs] += gains[order[place]] * value
        place += 1
        floor = kth(score)
    alive = np.flatnonzero((score > 0) & (score + reach[place] >= floor))
    while place < len(order) and len(alive):
        one, gain, rest = lists[order[place]], gains[order[place]], reach[place + 1]
        block = np.searchsorted(one.last, alive)
        inside = block < len(one.last)
        ok = score[alive] + rest + np.where(inside, gain * one.most[np.minimum(block, len(one.last) - 1)], 0) >= floor
        alive, block, inside = alive[ok], block[ok], inside[ok]
        if inside.any():
            score[alive[inside]] += gain * one.probe(alive[inside], block[inside])
        place += 1
        floor = kth(score[alive])
        alive = alive[score[alive] + reach[place] >= floor]
    top = alive[np.lexsort((alive, -score[alive]))[:k]]
    return top, score[top]


@dataclass(frozen=True)
class Index:
    """documents(shard, ids, n): a row a shard; postings(shard, term, ...): a row a term of a shard; docs and words count both."""

    documents: DataFrame
    postings: DataFrame
    docs: int
    words: int
    id_type: str


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, shard_words: int = SHARD_WORDS) -> Index:
    """The index of all words of all rows, written in the shared folder.

    Null and empty texts hold no terms and count for nothing. Rows that repeat an id, or have none, are
    documents each. Very long texts fill a shard alone. Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "blockmax")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"shard long, term long, df int, top array<int>, last binary, sizes binary, bounds binary, data binary, ids array<{id_type}>, n binary, docs long, words long, kind string"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        rows = words = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
            n = np.concatenate([h[3] for h in held])
            shift = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
            terms, at = np.concatenate([h[1] for h in held]), np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)])
            held.clear()
            order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            n = n[order]
            out = shard_postings(terms.view(np.int64), number[at], n) if len(terms) else {}
            count = len(out["term"]) if out else 0
            pick = {"shard": pa.array(np.full(count + 1, base + made)), "kind": pa.array(["terms"] * count + ["documents"])}
            single = {"ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order))), "n": pa.array([n.astype(np.int32).tobytes()]), "docs": pa.array([int((n > 0).sum())]), "words": pa.array([int(n.sum())])}
            arrays = []
            for name, kind in types:
                if name in pick:
                    arrays.append(pick[name])
                elif name in single:
                    arrays.append(pa.concat_arrays([pa.nulls(count, kind), single[name].cast(kind)]))
                else:
                    arrays.append(pa.concat_arrays([*([out[name].cast(kind)] if count else []), pa.nulls(1, kind)]))
            whole = pa.record_batch(arrays, [name for name, _ in types])
            for lo in range(0, whole.num_rows, 50_000):
                yield whole.slice(lo, 50_000)

        for batch in batches:
            kinds = {"term": pa.int64(), "df": pa.int32(), "top": pa.list_(pa.int32()), "last": pa.binary(), "sizes": pa.binary(), "bounds": pa.binary(), "data": pa.binary(), "ids": pa.list_(batch.column(0).type), "n": pa.binary(), "docs": pa.int64(), "words": pa.int64()}
            types = [("shard", pa.int64()), *kinds.items(), ("kind", pa.string())]
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                for lo, hi, data, offsets in text_chunks(part.column(1), CHUNK):
                    w = split_words(data, offsets, NOT_ALNUM)
                    held.append((part.column(0).slice(lo, hi - lo), w.hashes, w.rows.astype(np.int32), np.bincount(w.rows, minlength=hi - lo)))
                    rows, words = rows + hi - lo, words + len(w.hashes)
                    if rows >= shard_rows or words >= shard_words:
                        yield from flush()
                        held, rows, words, made = [], 0, 0, made + 1
        if held:
            yield from flush()

    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(build, schema).write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path("index"))
    whole = docs.sparkSession.read.schema(schema).parquet(scratch.path("index"))
    documents = whole.filter("kind = 'documents'").select("shard", "ids", "n", "docs", "words")
    size = documents.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    postings = whole.filter("kind = 'terms'").select("shard", "term", "df", "top", "last", "sizes", "bounds", "data")
    return Index(documents, postings, size["docs"] or 0, size["words"] or 0, id_type)


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term, repeats; rows that share an id are one query with all their words."""
    id_type = items.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = split_words(data, offsets, NOT_ALNUM)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(w.rows)), pa.array(w.hashes.view(np.int64))], ["item", "term"])

    words = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(split, f"item {id_type}, term long")
    return words.groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats"))


def search(index: Index, queries: DataFrame, k: int = 20, block_terms: int = QUERY_TERMS) -> DataFrame:
    """item, rank, id and score of each query's k best documents; fewer, if fewer score above 0.

    queries: item, term, repeats. Equal scores are ranked by the smaller id, rows without an id last."""
    scratch = Scratch(queries.sparkSession, "search")
    blocks = max(1, -(-queries.count() // block_terms))
    asked = scratch.table(queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), "queries")
    wanted = scratch.table(index.postings.join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    norm = lambda n: F.lit(75) + F.expr(f"(25L * if({n} = {NEVER}, 0L, {n}) * {index.docs}L) div {max(index.words, 1)}L")
    most = lambda tf, n: F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 12L * m_{n})")
    pick = lambda i, f: f(F.element_at("top", i + 1)).cast("long")
    terms = wanted.groupBy("term").agg(F.sum("df").alias("all_df"), pick(0, F.max).alias("tf1"), pick(1, F.min).alias("n1"), pick(2, F.max).alias("tf2"), pick(3, F.min).alias("n2"))
    terms = terms.withColumn("m_n1", norm("n1")).withColumn("m_n2", norm("n2"))
    weight: Column = F.floor(1000 * F.log((2.0 * index.docs + 2) / (2 * F.col("all_df") + 1)))
    terms = terms.select("term", weight.cast("long").alias("w"), F.greatest(most("tf1", "n1"), most("tf2", "n2")).alias("bound"))
    places = asked.select("term", "block").distinct().join(terms, "term")
    lists = wanted.join(places, "term").select("shard", "block", "term", "w", "bound", "df", "last", "sizes", "bounds", "data")
    pairs = wanted.select("shard", "term").join(asked.select("term", "block").distinct(), "term").select("shard", "block").distinct()
    pairs = scratch.table(pairs, "pairs")
    right = lists.unionByName(index.documents.select("shard", "ids", "n").join(pairs, "shard"), allowMissingColumns=True)
    left = pairs.join(asked, "block").select("shard", "block", "item", "term", "repeats")
    id_type, item_type = index.id_type, queries.schema["item"].dataType.simpleString()
    docs, words = index.docs, index.words

    def rank(key: tuple, asks: pa.Table, table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_valid(table["n"]))
        n = np.frombuffer(head["n"][0].as_py(), np.int32)
        ids = head["ids"].combine_chunks().flatten()
        table = table.filter(pc.is_valid(table["term"]))
        norms = lambda x: length_norm(x, docs, words)
        m = norms(n)
        held = {t: i for i, t in enumerate(table["term"].to_pylist())}
        columns = [table[c].to_pylist() for c in ("df", "last", "sizes", "bounds", "data")]
        lists = [Postings(*row, m, norms) for row in zip(*columns, strict=True)]
        w, bound = table["w"].to_numpy(), table["bound"].to_numpy()
        items = asks["item"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes, terms_asked, repeats = items.indices.to_numpy(), asks["term"].to_pylist(), asks["repeats"].to_numpy()
        by_item: dict[int, list[int]] = {}
        for i, code in enumerate(codes.tolist()):
            if terms_asked[i] in held:
                by_item.setdefault(code, []).append(i)
        found, cached = [], 0
        for code, rows in by_item.items():
            at = np.array([held[terms_asked[i]] for i in rows])
            top, score = best([lists[i] for i in at], w[at] * repeats[rows], bound[at], len(n), k)
            found.append((np.full(len(top), code), top, score))
            cached += sum(int(lists[i].counts.sum()) for i in at)
            if cached > CACHED:
                for one in lists:
                    one.whole = None
                cached = 0
        join = lambda i: np.concatenate([*(f[i] for f in found), np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"item": items.dictionary.take(pa.array(join(0))), "id": ids.take(pa.array(join(1))), "score": join(2)})

    # the work of a group does not show in its bytes: partitions are set by the number of groups
    parts = max(1, -(-pairs.count() // GROUPS))
    left, right = left.repartition(parts, "shard", "block"), right.repartition(parts, "shard", "block")
    heaps = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(rank, f"item {item_type}, id {id_type}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = search(index, query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
lens AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lens),
tf AS (SELECT rid, w, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w),
q AS (
  SELECT item_id, w, CAST(count(*) AS BIGINT) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
    FROM benchmark) GROUP BY item_id, w),
wt AS (SELECT w, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, corpus WHERE w IN (SELECT w FROM q) GROUP BY w, nd),
s AS (
  SELECT q.item_id, lens.rid, lens.doc_id,
    CAST(sum(q.repeats * wt.weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * lens.n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN wt ON q.w = wt.w JOIN tf ON tf.w = q.w JOIN lens ON lens.rid = tf.rid, corpus GROUP BY q.item_id, lens.rid, lens.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
