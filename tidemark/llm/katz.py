"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

The model is over all training tokens. Counts up to ``TRUSTED``, of words and of pairs, are discounted by
Good-Turing, with the counts of counts smoothed by a line in logarithms, so that a discounted count always rises with
the count; larger counts lose ``LARGE`` each, so that every context gives something up. What a context gives up goes
to the words by themselves, scaled so that the chances of all entries add up to 1 exactly; what the words give up is
the chance of the one entry that words never seen share.

Words and n-grams are known by 64-bit hashes; the ``local`` most frequent words are broadcast, but only as a
cache. Texts are read once more after their words are counted: each pair travels to its partition in blocks that
list keys once with the texts that ask for them. The partition adds up the training texts' blocks, so it holds
the pair's count when it answers, and sends back, by text, how many pairs were seen how often. Pairs of a rare
context are dealt by context, those of a frequent one by pair. Where a text backs off, the pair is sent on to be
joined with its context's weight and its word's count; weights are only worked out for contexts that need one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch
from .words import mix, text_chunks, word_hashes

_U = np.uint64
END = np.uint64(0x656E64)
#: Good-Turing applies to counts up to this.
TRUSTED = 5
#: Numbers of the entries that the cache always holds.
START_CODE, END_CODE = 0, 1
#: What counts beyond TRUSTED lose.
LARGE = 0.5
#: Pairs that a task gathers before it sends them.
SENT = 1_500_000
OWN, SEEN, WORDS, CONTEXT, COVERED, BACKOFF, COUNTS = range(7)
#: What blocks of pairs and words travel as.
CELLS = {"h": np.int64, "w": np.int64, "times": np.int32, "texts": np.int32}


@dataclass(frozen=True)
class Settings:
    local: int = 65_536  # words that are broadcast


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, their rows from 0): each row's words and one end."""
    for lo, hi, data, offsets in text_chunks(texts):
        words, rows = word_hashes(data, offsets)
        n = hi - lo
        at = np.arange(len(rows)) + rows
        out, out_rows = np.full(len(rows) + n, END), np.zeros(len(rows) + n, np.int64)
        out[at], out_rows[at] = words, rows
        ends = np.cumsum(np.bincount(rows, minlength=n)) + np.arange(n)
        out_rows[ends] = np.arange(n)
        yield lo, hi, out, out_rows


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def discounts(of: dict[int, int]) -> np.ndarray:
    """Good-Turing factors by count, 0 to TRUSTED; of: how many entries have a count, up to TRUSTED + 1.

    With counts of counts on the line A r^b, a count r is worth r (1 + 1/r)^(b + 1); as larger counts keep their
    value, all are taken down so that what was seen once gives up its share (Katz). The line falls at least as
    steeply as 1/r, or nothing would be left for what was never seen.
    """
    r = np.array([i for i in range(1, TRUSTED + 2) if of.get(i)], float)
    slope = np.polyfit(np.log(r), np.log([of[int(i)] for i in r]), 1)[0] if len(r) > 1 else -2.0
    slope = min(slope, -1.05)
    count = np.arange(1, TRUSTED + 1)
    floor = (TRUSTED + 1.0) ** (slope + 1)
    return np.r_[0.0, ((1 + 1 / count) ** (slope + 1) - floor) / (1 - floor)]


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What counts are worth."""
    return np.where(c > TRUSTED, c - LARGE, c * d[np.minimum(c, TRUSTED)])


def _most_frequent(counts: DataFrame, key: str, k: int) -> list:
    """The k rows with the largest c (ties: the smaller key). Rows below the k-th largest count are first
    filtered out by a histogram of the counts' logarithms, so that few more than k are put in order."""
    step = F.floor(F.log2("c") * 64)
    histogram = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    enough, least = 0, 0
    for least, n in histogram:
        enough += n
        if enough >= k:
            break
    return counts.filter(step >= least).orderBy(F.desc("c"), key).limit(k).collect()


@dataclass
class Cache:
    """The most frequent words: sorted hashes, their codes, and counts by code (start and end come first).

    A code is a number from 0 for a cached word, else the hash with its top bit set, which is negative."""

    words: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    total: int
    types: int
    discounts: np.ndarray
    unseen: float  # the chance of words never seen

    def code(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
        else:
            at, hit = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        return np.where(hit, self.codes[at] if len(self.words) else 0, (hashes | _U(1 << 63)).view(np.int64))

    def single(self) -> np.ndarray:
        """By code: chance of the word alone."""
        p = discounted(self.counts, self.discounts) / self.total if self.total else np.ones(len(self.counts))
        p[START_CODE] = 0
        return p


def _cache(counts: DataFrame, s: Settings) -> Cache:
    end, c = F.lit(int(END)), F.col("c")
    of = [F.count(F.when(c == r, 1)).alias(f"n{r}") for r in range(1, TRUSTED + 2)]
    stats = counts.agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("types"), F.count(F.when(c > TRUSTED, 1)).alias("large"), F.sum(F.when(F.col("w") == end, c)).alias("texts"), *of).first()
    top = _most_frequent(counts, "w", s.local)
    words = np.array([r["w"] for r in top], np.int64).view(np.uint64)
    c = np.array([r["c"] for r in top], np.int64)
    total, texts = stats["total"] or 0, stats["texts"] or 0
    words, c = words[words != END], c[words != END]
    d = discounts({r: stats[f"n{r}"] for r in range(1, TRUSTED + 2)})
    given = sum(stats[f"n{r}"] * r * (1 - d[r]) for r in range(1, TRUSTED + 1)) + LARGE * stats["large"]
    words, codes = np.r_[words, END], np.r_[np.arange(len(words)) + 2, END_CODE]
    order = np.argsort(words)
    return Cache(words[order], codes[order], np.r_[texts, texts, c], total, stats["types"], d, given / total if total else 1.0)


def _pairs(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The context of every token; a row's first token has the start."""
    before = np.r_[START_CODE, codes[:-1]]
    before[np.r_[True, rows[1:] != rows[:-1]]] = START_CODE
    return before


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h.view(np.uint64)) * _U(0x9E3779B97F4A7C15) + w.view(np.uint64))


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _planes(starts: np.ndarray, x: np.ndarray) -> pa.Array:
    """Cells of numbers, first all lowest bytes, then all next ones: of sorted or small numbers most planes are
    runs, which the shuffle's compression shrinks to almost nothing."""
    width, ends = x.dtype.itemsize, np.r_[starts, len(x)][1:]
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, width)
    return pa.array([np.ascontiguousarray(raw[i:j].T).tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())


def _numbers(cell: pa.Scalar, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(cell.as_buffer(), np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _sums(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some, where = np.unique(codes, return_inverse=True)
    return some, np.bincount(where, weights=values, minlength=len(some))


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part, then key; and the part of each."""
    part = (mix(keys.view(np.uint64)) >> _U(20)).astype(np.int64) % parts
    order = np.lexsort((keys, part))
    return order, part[order]


def count_words(docs: DataFrame, text_col: str, train_col: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, _, h, r in tokens_of(batch.column(0)):
                k, c = np.unique(h[train[lo + r]], return_counts=True)
                keys, counts = _added_up(np.r_[keys, k], np.r_[counts, c])
                if len(keys) > 1_000_000:
                    yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["w", "c"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["w", "c"])

    return docs.select(text_col, train_col).mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _holds(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among some, which is sorted."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def _count_part(blocks: list[tuple], single: np.ndarray) -> Iterator[tuple[int, int, dict]]:
    """(kind, rows, columns) for all blocks (task, train, h, w, times, texts) of a part."""
    h, w = (np.concatenate([b[i] for b in blocks]) for i in (2, 3))
    blocks[:] = [(task, train, len(bh), bt, texts) for task, train, bh, _, bt, texts in blocks]  # h and w are held once
    key = _pair_key(h, w)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    del key
    first = order[new]
    pair = np.empty(len(order), np.int32)
    pair[order] = np.cumsum(new, dtype=np.int32) - 1
    del order, new
    times = np.concatenate([bt if train else np.zeros(len(bt), bt.dtype) for _, train, _, bt, _ in blocks])
    c = np.bincount(pair, weights=times, minlength=len(first)).astype(np.int64)
    del times
    category = np.minimum(c, TRUSTED + 1).astype(np.int8)
    value = np.where(category > TRUSTED, np.log10(np.maximum(c - LARGE, LARGE)), 1.0)
    yield COUNTS, 1, {"values": pa.array([np.bincount(np.minimum(c, TRUSTED + 2), minlength=TRUSTED + 3)[: TRUSTED + 2].astype(float)], pa.list_(pa.float64()))}
    asked, at = [], 0
    for task, _, size, bt, texts in blocks:
        bh, bw, mine = (x[at : at + size] for x in (h, w, pair))
        at += size
        cat, val = np.repeat(category[mine], bt), np.repeat(value[mine], bt)
        yes = cat > 0
        codes, sums = _sums(texts[yes].astype(np.int64) * 8 + cat[yes], val[yes])
        if len(codes):
            yield SEEN, 1, {"task": pa.array([task]), "codes": _planes([0], codes), "sums": _planes([0], sums)}
        out = ~yes
        n = int(out.sum())
        if n:
            eh = np.repeat(bh, bt)[out]
            asked.append(np.unique(eh[eh < 0]))
            yield BACKOFF, n, {"task": pa.array(np.full(n, task)), "text": pa.array(texts[out].astype(np.int64)), "h": pa.array(eh), "w": pa.array(np.repeat(bw, bt)[out])}
    del pair, value
    # an uncached context has all its pairs here, so the part knows whether anybody backs off from it
    asked = np.unique(np.concatenate([np.zeros(0, np.int64), *asked]))
    needed = (c > 0) & ((h[first] >= 0) | _holds(asked, h[first]))
    first, c, category = first[needed], c[needed], category[needed]
    h = h[first]
    w = w[first]
    near = w >= 0
    covered = np.where(near, single[np.where(near, w, 0)], 0.0)
    order = np.argsort(h, kind="stable")
    h_, starts = h[order], _runs(h[order])
    if len(starts):
        sums = lambda x: np.add.reduceat(x[order].astype(float), starts)
        stats = np.stack([sums(c), sums(np.where(category > TRUSTED, c - LARGE, 0)), sums(covered), *(sums(category == r) for r in range(1, TRUSTED + 1))], 1)
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel()))
        yield CONTEXT, len(starts), {"h": pa.array(h_[starts]), "values": values}
    if not near.all():
        yield COVERED, int((~near).sum()), {"h": pa.array(h[~near]), "w": pa.array(w[~near])}


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Defined cases: a null, empty or blank text is one end; a null id counts as an empty one for the fold;
    rows with equal ids or texts are scored each; without training rows all words are unknown and have a chance
    of 1; no rows give no rows; other columns are not read.
    """
    spark, s = docs.sparkSession, settings or Settings()
    scratch = Scratch(spark, "katz", small=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"), (~held_out(id_col)).alias("train"))
    words = scratch.table(count_words(rows, "text", "train"), "words")
    cache = _cache(words, s)
    shared = spark.sparkContext.broadcast(cache)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType.simpleString()
    ids_type = to_arrow_type(docs.schema[id_col].dataType)
    total, types = cache.total, cache.types
    base_floor = total + 0.1 * (types + 1)
    own = [("task", pa.int64()), ("text", pa.int64()), ("doc_id", ids_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
    own_ddl = f"task long, text long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double"
    wire = pa.schema([("kind", pa.int32()), ("part", pa.int64()), *own, ("train", pa.bool_()), *((name, pa.binary()) for name in CELLS)])
    back = pa.schema([("kind", pa.int32()), *own, ("codes", pa.binary()), ("sums", pa.binary()), ("values", pa.list_(pa.float64())), ("h", pa.int64()), ("w", pa.int64())])

    def record(schema: pa.Schema, kind: int, n: int, given: dict) -> pa.RecordBatch:
        given = given | {"kind": pa.array(np.full(n, kind, np.int32))}
        return pa.record_batch([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what is known here, and blocks of pairs and of rare words by part."""
        from pyspark import TaskContext

        u = shared.value
        # texts are grouped by task and by what it sends at a time
        task = TaskContext.get().partitionId() << 20
        number = 0
        log_base = np.log10((u.counts + 0.1) / base_floor)
        log_seen = np.log10(np.maximum(u.counts, 1))

        def blocks(kind: int, train: bool, h: np.ndarray, w: np.ndarray, dealt: np.ndarray, texts: np.ndarray) -> pa.RecordBatch:
            part = (mix(dealt.view(np.uint64)) >> _U(20)).astype(np.int64) % parts
            order = np.lexsort((w, h, part))
            part, h, w, texts = part[order], h[order], w[order], texts[order]
            starts = _runs(part)
            new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
            new[starts] = True
            first = np.flatnonzero(new)
            at, n = np.searchsorted(first, starts), len(starts)
            times = np.diff(np.r_[first, len(h)]).astype(np.int32)
            return record(wire, kind, n, {"part": pa.array(part[starts]), "task": pa.array(np.full(n, task)), "train": pa.array(np.full(n, train)), "h": _planes(at, h[first]), "w": _planes(at, w[first]), "times": _planes(at, times), "texts": _planes(starts, texts)})

        def sent(waiting: dict) -> Iterator[pa.RecordBatch]:
            for (kind, train), got in waiting.items():
                if sum(len(x[0]) for x in got):
                    columns = [list(x) for x in zip(*got, strict=True)]
                    got.clear()
                    h, w, texts = (np.concatenate(columns.pop(0)) for _ in range(3))
                    if kind == WORDS:
                        yield blocks(kind, train, h, w, h, texts)
                    else:
                        yield blocks(kind, train, h, w, np.where(h < 0, h, _pair_key(h, w).view(np.int64)), texts)
                got.clear()

        # blocks reach over batches, whose size is only a matter of memory
        waiting: dict[tuple, list] = {(SEEN, True): [], (SEEN, False): [], (WORDS, False): []}
        for batch in batches:
            trains = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, hashes, r in tokens_of(batch.column(1)):
                n = hi - lo
                code = u.code(hashes)
                context = _pairs(code, r)
                asks, near = code < 0, np.maximum(code, START_CODE)
                sums = lambda x: np.bincount(r, weights=x, minlength=n)  # noqa: E731, B023
                value = np.where(context < 0, 0.0, -log_seen[np.maximum(context, 0)])
                base = np.where(asks, -np.log10(base_floor), log_base[near])
                yield record(
                    wire, OWN, n,
                    {"part": pa.array((task + number + np.arange(n)) % parts), "task": pa.array(np.full(n, task)), "text": pa.array(number + np.arange(n)), "doc_id": batch.column(0).slice(lo, n), "held_out": batch.column(2).slice(lo, n),
                     "n_tokens": pa.array(np.bincount(r, minlength=n)), "n_known": pa.array(np.bincount(r[~asks & (u.counts[near] > 0)], minlength=n)), "base": pa.array(sums(base)), "score": pa.array(sums(value))},
                )
                train = trains[lo + r]
                for y in (True, False):
                    waiting[SEEN, y].append((context[train == y], code[train == y], (number + r[train == y]).astype(np.int32)))
                raw = hashes[asks].view(np.int64)
                waiting[WORDS, False].append((raw, np.zeros(len(raw), np.int64), (number + r[asks]).astype(np.int32)))
                number += n
                if sum(len(x[0]) for y in (True, False) for x in waiting[SEEN, y]) > SENT:
                    yield from sent(waiting)
                    task += 1
        yield from sent(waiting)

    ddl = f"kind int, part long, {own_ddl}, train boolean, h binary, w binary, times binary, texts binary"
    asked = rows.select("doc_id", "text", "held_out").mapInArrow(ask, ddl)
    nothing = lambda names, types: [F.lit(None).cast(t).alias(n) for n, t in zip(names, types, strict=True)]
    table = (
        words.select("w", "c").mapInArrow(_packed(parts), "part long, keys binary, values binary")
        .select(F.lit(WORDS).alias("kind"), "part", F.lit(-1).cast("long").alias("task"), *nothing(["text", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "train"], ["long", id_type, "boolean", "long", "long", "double", "double", "boolean"]), F.col("keys").alias("h"), F.col("values").alias("w"), *nothing(["times", "texts"], ["binary", "binary"]))
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by part, kind and task: a part's pairs are held and counted; its words come before the blocks that ask."""
        u = shared.value
        single = u.single()
        here, pairs, keys, values, flat = None, [], [], [], None

        def counted() -> Iterator[pa.RecordBatch]:
            if pairs:
                for kind, n, given in _count_part(pairs, single):
                    yield record(back, kind, n, given)
                pairs.clear()

        for batch in batches:
            kinds, parts_, tasks, trains = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, wire.get_field_index("train")))
            lists = [(batch.column(wire.get_field_index(c)), t) for c, t in CELLS.items()]
            mine = np.flatnonzero(kinds == OWN)
            if len(mine):
                got = batch.take(pa.array(mine))
                yield record(back, OWN, len(mine), {n: got.column(wire.get_field_index(n)) for n, _ in own})
            for i in np.flatnonzero(kinds != OWN):
                if (kinds[i], parts_[i]) != here:
                    yield from counted()
                    here, keys, values, flat = (kinds[i], parts_[i]), [], [], None
                cells = [_numbers(x[i], t) if x[i].is_valid else None for x, t in lists]
                if kinds[i] == SEEN:
                    pairs.append((int(tasks[i]), bool(trains[i]), *cells))
                    continue
                if tasks[i] < 0:
                    keys.append(cells[0])
                    values.append(cells[1])
                    continue
                if flat is None:
                    k, v = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, np.int64)])
                    order = np.argsort(k)
                    flat, keys, values = (k[order], v[order]), [], []
                c = np.zeros(len(cells[0]), np.int64)
                if len(flat[0]):
                    at = np.minimum(np.searchsorted(flat[0], cells[0]), len(flat[0]) - 1)
                    c = np.where(flat[0][at] == cells[0], flat[1][at], 0)
                c, text = np.repeat(c, cells[2]), cells[3].astype(np.int64) * 8
                # of rare words: what the base needs, how many are known, what their pairs are divided by
                codes, sums = _sums(np.r_[text, text + 1, text + 2], np.r_[np.log10(c + 0.1), c > 0, np.log10(np.maximum(c, 1))])
                yield record(back, WORDS, 1, {"task": pa.array([int(tasks[i])]), "codes": _planes([0], codes), "sums": _planes([0], sums)})
        yield from counted()

    ordered = asked.unionByName(table).repartition("part").sortWithinPartitions("part", "kind", "task")
    answered = scratch.table(ordered.mapInArrow(answer, f"kind int, {own_ddl}, codes binary, sums binary, values array<double>, h long, w long"), "answered")
    of_kind = lambda kind, *columns: answered.filter(F.col("kind") == kind).select(*columns)
    of = of_kind(COUNTS, "values").agg(*(F.sum(F.col("values")[r]).alias(f"n{r}") for r in range(1, TRUSTED + 2))).first()
    d = discounts({r: int(of[f"n{r}"] or 0) for r in range(1, TRUSTED + 2)})

    # contexts: seen(h), all that followed h; kept and covered, what seen pairs are worth, and their chances by themselves
    far = words.select(F.col("w").bitwiseOR(F.lit(-(1 << 63))).alias("w"), F.col("c"))
    small = F.get(F.array(*(F.lit(float(r * x)) for r, x in enumerate(cache.discounts))), F.least("c", F.lit(TRUSTED)).cast("int"))
    alone = F.when(F.col("c") > TRUSTED, F.col("c") - LARGE).otherwise(small) / F.lit(float(max(total, 1)))
    stats = of_kind(CONTEXT, "h", F.col("values")[0].alias("seen"), (F.col("values")[1] + sum(F.col("values")[2 + r] * float(r * d[r]) for r in range(1, TRUSTED + 1))).alias("kept"), F.col("values")[2].alias("covered"))
    more = of_kind(COVERED, "h", "w").join(far, "w").groupBy("h").agg(F.sum(alone).alias("covered")).select("h", F.lit(0.0).alias("seen"), F.lit(0.0).alias("kept"), "covered")
    given, free = 1 - F.col("kept") / F.col("seen"), 1 - F.col("covered")
    contexts = scratch.table(
        stats.unionByName(more).groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept"), F.sum("covered").alias("covered"))
        .select("h", (F.log10("seen") + F.log10(given) - F.log10(free)).alias("backs")),
        "contexts",
    )
    backs = np.log10(np.maximum(cache.counts, 1))
    for r in contexts.filter("h >= 0").collect():  # cached ones
        backs[r["h"]] = r["backs"]
    spread = spark.sparkContext.broadcast((backs, np.log10(np.maximum(cache.single(), 1e-300))))

    def known_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What backing off changes in a text's score, as far as the cache tells; the rest is looked up."""
        by_context, log_single = spread.value
        for batch in batches:
            h, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            value = np.where(h >= 0, by_context[np.maximum(h, 0)], 0.0) + np.where(w >= 0, log_single[np.maximum(w, 0)], 0.0)
            yield pa.record_batch([*(batch.column(i) for i in range(4)), pa.array(value)], ["task", "text", "h", "w", "value"])

    events = of_kind(BACKOFF, "task", "text", "h", "w").mapInArrow(known_here, "task long, text long, h long, w long, value double")
    by = ["task", "text"]
    of_context = events.filter("h < 0").join(contexts.filter("h < 0"), "h").select(*by, F.col("backs").alias("value"))
    never = float(np.log10(cache.unseen))
    of_word = events.filter("w < 0").join(far, "w", "left").select(*by, F.when(F.col("c").isNull(), F.lit(never)).otherwise(F.log10(alone)).alias("value"))
    corrections = events.select(*by, "value").unionByName(of_context).unionByName(of_word).groupBy(*by).agg(F.sum("value").alias("more"))
    gain = np.r_[0.0, [np.log10(r * d[r]) if d[r] > 0 else 0.0 for r in range(1, TRUSTED + 1)]]

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        """A group's texts with what the partitions have sent back for them."""
        text = left.column("text").to_numpy()
        order = np.argsort(text)
        n_known, base, score = (left.column(c).to_numpy().astype(t) for c, t in (("n_known", np.int64), ("base", float), ("score", float)))
        for kind in (SEEN, WORDS):
            part = right.filter(pc.equal(right.column("kind"), kind))
            if not part.num_rows:
                continue
            codes, values = (np.concatenate([_numbers(x, t) for x in part.column(c)]) for c, t in (("codes", np.int64), ("sums", np.float64)))
            at, what = order[np.searchsorted(text[order], codes >> 3)], codes & 7
            sums = lambda x: np.bincount(at, weights=x, minlength=len(text))  # noqa: E731, B023
            if kind == SEEN:
                score = score + sums(values * np.where(what > TRUSTED, 1.0, np.r_[gain, 0.0, 0.0][what]))
            else:
                base = base + sums(values * (what == 0))
                n_known = n_known + np.rint(sums(values * (what == 1))).astype(np.int64)
                score = score - sums(values * (what == 2))
        return pa.table([left.column("task"), left.column("text"), left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), pa.array(n_known), pa.array(base), pa.array(score)], ["task", "text", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    answers = answered.filter(F.col("kind").isin(SEEN, WORDS)).select("task", "kind", "codes", "sums")
    texts = of_kind(OWN, *(n for n, _ in own))
    out = texts.groupBy("task").cogroup(answers.groupBy("task")).applyInArrow(together, f"task long, text long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = out.join(corrections, by, "left")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def _packed(parts: int, rows: int = 500_000):
    """(key, value) rows as blocks by part."""

    def blocks(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order, part = _by_part(keys, parts)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        return pa.record_batch([pa.array(part[starts]), _planes(starts, keys[order]), _planes(starts, values[order])], ["part", "keys", "values"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            if sum(len(k) for k, _ in held) >= rows:
                yield blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if sum(len(k) for k, _ in held):
            yield blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return f


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
