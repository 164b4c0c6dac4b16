"""Near-duplicate groups by an exact Jaccard join of word n-gram sets.

Sets whose sizes are within the threshold of each other lie in one size band or in two adjacent ones. For a
band, a pair that reaches the threshold differs in at most H shingles, so when shingles are hashed into H + 1
segments, one segment at least is the same in both (pigeonhole). Each set is indexed by the content of its
segments, in its own band and as a larger partner of the band below.

Some segments of each band are also indexed with every one of their shingles left out: sets that differ by one
shingle there still meet, so such a segment counts twice. That buys the right to pass over as many of the
costliest segments: empty ones, which would bring all sets together, and those whose content is common and
leads to unconnected sets. How many segments are bought is a matter of cost (see ``allocate``): each adds index
rows, and each one short makes sets ask for an exact join by prefixes; how many segments a set would want to
pass over is measured on a bounded sample.

A bucket of up to ``small`` sets gives all its pairs. In a larger one each set is paired with one hub, in the
task that makes the index rows and once more where they meet, so that no task holds a common segment's sets.
Pairs are held against sizes and a bitmap of parities (whose distance is never more than the sets' own), then
verified on the whole sets. Where a large bucket's sets are not all connected by then, those outside of its
largest component pass over it as far as their slack goes; a set that would have to pass over more asks: it is
joined with the sets of large buckets by shared prefixes, in which common shingles come last. The few sets with too many
empty segments are joined with all others by prefixes. Groups are connected components, so copies and near
copies of one text never become all their pairs.

Shingles and sets are held as 64-bit hashes of random byte tables (see words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .components import components
from .shared import Scratch, lean
from .words import distinct_sets, mix, shingles, text_chunks, word_hashes

_U = np.uint64
LARGEST = 1 << 40
#: Text bytes whose index rows are sent at a time.
CHUNK = 1 << 21
#: Parity bits of a set at least.
BITS = 512
MEMBER, INDEX, PAIR, STAR = range(4)


@dataclass(frozen=True)
class Limits:
    """What bounds a task's or the driver's memory, and costs; results do not depend on any of it."""

    small: int = 16  # sets of a bucket that gives all its pairs
    per_hub: int = 1000  # pairs of one hub for which its set is sent once
    local: int = 2_000_000  # longs that are broadcast: ids of wanted sets, prefixes of sets that ask all others
    sample: int = 2048  # sets on which costs and common shingles are measured
    common: int = 65_536  # common shingles that are put last
    few: int = 100_000  # classes that are broadcast to pick their sets; more are shuffled
    asks: float = 2000.0  # cost of a set that asks, in index rows
    withheld: int = 0  # slack that no set may use


@dataclass(frozen=True)
class Bands:
    """All that follows from the threshold ``num / den``: bands and, for each, segments and bought slack."""

    num: int
    den: int
    bought: tuple[tuple[int, int], ...] = ()  # (band, segments with one-deletion neighbours) where costs are known

    def tables(self) -> dict[str, np.ndarray]:
        low, high = [1], []
        while low[-1] < LARGEST:
            high.append(low[-1] * self.den // self.num)
            low.append(high[-1] + 1)
        low, high = np.array(low[:-1], np.int64), np.array(high, np.int64)
        cap = high * self.den // self.num
        differ = (high + cap) * (self.den - self.num) // (self.den + self.num)
        segments = differ + 1
        empty = segments * np.exp(-high / segments)  # expected at the band's upper end, where slack is least
        spare = np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64) + 1
        for band, n in self.bought:
            spare[band] = n
        return {"low": low, "high": high, "cap": cap, "segments": segments, "spare": np.where(differ == 0, 0, np.minimum(segments, spare))}

    def differ(self, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (r + s) * (self.den - self.num) // (self.den + self.num)


def set_digests(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    np.add.at(total, rows, mix(hashes + _U(0x5851F42D4C957F2D)))
    return mix(total + np.bincount(rows, minlength=n).astype(np.uint64))


def parities(hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """For each set, whether an odd number of its shingles falls on each of at least ``BITS`` places, a power of
    two that exceeds its size."""
    places = BITS << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) * 1.3 / BITS))).astype(np.int64)
    base = np.cumsum(places) - places
    odd = np.bincount(base[rows] + (hashes & (places[rows] - 1).astype(np.uint64)).astype(np.int64), minlength=int(places.sum())) & 1
    return pa.ListArray.from_arrays(pa.array((np.r_[base, places.sum()] // 64).astype(np.int32)), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))


def sets_of(texts: pa.Array, k: int, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles, their rows from 0) chunk by chunk; distinct, sorted by row and hash."""
    for lo, hi, data, offsets in text_chunks(texts, limit):
        words, rows = word_hashes(data, offsets)
        out, out_rows = distinct_sets(*shingles(words, rows, hi - lo, k))
        yield lo, hi, out, out_rows


def segments_of(hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, bands: Bands, t: dict[str, np.ndarray], upper: bool) -> dict[str, np.ndarray]:
    """The segments of every set in its own band or, ``upper``, in the one below: for each segment its owner,
    number, number of shingles and the sum of their values; for each shingle its value, segment and row."""
    n = len(sizes)
    group = np.searchsorted(t["low"], np.maximum(sizes, 1), side="right") - 1 - upper
    member = (sizes > 0) & (group >= 0)
    group = np.maximum(group, 0)
    if upper:
        member &= sizes <= t["cap"][group]
    m = np.where(member, t["segments"][group], 0)
    base = np.cumsum(m) - m
    at = member[rows]
    h, r = hashes[at], rows[at]
    salt = mix((group.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    slot = base[r] + (mix(h ^ salt[r]) >> _U(16)).astype(np.int64) % m[r]
    value = mix(h + salt[r])
    owner = np.repeat(np.arange(n), m)
    total = np.zeros(len(owner), np.uint64)
    np.add.at(total, slot, value)
    partner = t["high"][group] if upper else np.minimum(sizes * bands.den // bands.num, t["cap"][group])
    free = m - 1 - bands.differ(sizes, partner)  # segments that may be passed over before any is bought
    return {"group": group, "member": member, "salt": salt, "free": free, "owner": owner, "number": np.arange(len(owner)) - base[owner], "count": np.bincount(slot, minlength=len(owner)), "total": total, "value": value, "slot": slot, "row": r}


def signatures(hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, bands: Bands, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, per-row slack that is left). The last bit of a signature tells a bought segment."""
    n = len(sizes)
    slack = np.full(n, LARGEST)
    sigs, sig_rows = [], []
    for upper in (False, True):
        s = segments_of(hashes, rows, sizes, bands, t, upper)
        spare = np.where(s["member"], t["spare"][s["group"]], 0)
        owner, count, slot = s["owner"], s["count"], s["slot"]
        bought = s["number"] < spare[owner]
        tag = mix(s["salt"][owner] + s["number"].astype(np.uint64) * _U(0xD1342543DE82EF95))
        sealed = lambda x, where: (mix(x ^ tag[where]) & ~_U(1)) | bought[where].astype(np.uint64)  # noqa: B023, E731
        full = np.flatnonzero(count > 0)
        less = np.flatnonzero(bought[slot] & (count[slot] > 1))  # with one shingle left out
        sigs += [sealed(s["total"][full], full), sealed(s["total"][slot[less]] - s["value"][less], slot[less])]
        sig_rows += [owner[full], s["row"][less]]
        passed = np.where(count == 0, 1 + bought, np.where(bought & (count == 1), 1, 0))
        left = s["free"] + spare - np.bincount(owner, weights=passed, minlength=n).astype(np.int64)
        slack = np.where(s["member"], np.minimum(slack, left), slack)
    return np.concatenate(sigs), np.concatenate(sig_rows), slack


# ---- what segments cost
def allocate(hashes: np.ndarray, rows: np.ndarray, sizes: np.ndarray, bands: Bands, asks: float) -> Bands:
    """Buys for each band the number of segments that costs least on the sampled sets, where one that asks costs
    ``asks`` index rows; at least those that empty segments take as a rule.

    A set wants to pass over its empty segments and, with half of what is left, those whose content another
    sampled set shares without being a near copy (one that shares most segments): at full size those are common.
    Any number is exact.
    """
    t = bands.tables()
    wants: dict[int, list[np.ndarray]] = {}
    for upper in (False, True):
        s = segments_of(hashes, rows, sizes, bands, t, upper)
        full = s["count"] > 0
        tag = mix(s["total"] ^ mix(s["salt"][s["owner"]] + s["number"].astype(np.uint64)))
        _, where, times = np.unique(tag[full], return_inverse=True, return_counts=True)
        common = np.zeros(len(full), bool)
        common[full] = times[where] > 1
        sums = lambda x: np.bincount(s["owner"], weights=x, minlength=len(sizes))  # noqa: B023, E731
        number, n_common = sums(np.ones(len(full))), sums(common)
        n_common = np.where(2 * n_common > number, 0, n_common)
        for g in np.unique(s["group"][s["member"]]):
            who = s["member"] & (s["group"] == g)
            wants.setdefault(int(g), []).append(np.stack([sums(~full)[who] + 2 * n_common[who] - s["free"][who], sums(~full)[who], sizes[who] / number[who]]))
    bought = []
    for g, parts in sorted(wants.items()):
        short, empty, each = np.concatenate(parts, axis=1)
        most = int(t["segments"][g])
        if t["spare"][g] == 0 or short.shape[0] < 8:
            continue  # too few to tell: the formula stands
        # a bought segment that is empty or holds one shingle gives nothing; its share of all is known
        gain = np.maximum(1 - empty / most - each * np.exp(-each), 0.1)
        steps = np.arange(t["spare"][g], most + 1)
        cost = [(short > n * gain - 1).mean() * asks + n * each.mean() for n in steps]
        bought.append((g, int(steps[np.argmin(cost)])))
    return replace(bands, bought=tuple(bought))


def _sampled(docs: DataFrame, k: int, bands: Bands, text_col: str, limits: Limits) -> Bands:
    """Costs measured on about ``sample`` texts, drawn by their hash; the sample's sets come to the driver."""
    picked = docs.select(F.col(text_col).alias("text")).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 20)))
    bound = max(1, (limits.sample << 20) // max(docs.count(), 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, r in sets_of(batch.column(0), k):
                at = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], ["shingles"])

    lists = picked.filter(F.col("h") < bound).select("text").distinct().mapInArrow(lean(read), "shingles array<long>").filter((F.size("shingles") > 0) & (F.size("shingles") <= 10_000)).limit(2 * limits.sample).toArrow().column(0).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return bands
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return allocate(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes), sizes, bands, limits.asks)


# ---- index and candidates
def _wire_schema(id_type: pa.DataType) -> pa.Schema:
    long = pa.int64()
    return pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", id_type), ("size", long), ("cls", long), ("slack", long), ("bits", pa.list_(long)), ("shingles", pa.list_(long)), ("sig", long), ("a", long), ("b", long), ("low", pa.binary()), ("owners", pa.binary()), ("common", pa.binary())])


def _id_type(id_type: T.DataType) -> pa.DataType:
    """With nullable fields throughout, as rows that are no documents have none."""
    return to_arrow_type(T.DataType.fromDDL(id_type.simpleString()))


def _record(schema: pa.Schema, kind: int, n: int, given: dict) -> pa.RecordBatch:
    given = given | {"kind": pa.array(np.full(n, kind, np.int32))}
    return pa.record_batch([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _cells(starts: np.ndarray, n: int, width: int, data: np.ndarray) -> pa.Array:
    """Binary cells of ``width`` bytes an entry, cut at ``starts``."""
    offsets = (np.r_[starts, n] * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _index(docs: DataFrame, k: int, bands: Bands, id_col: str, text_col: str, parts: int, limits: Limits) -> DataFrame:
    """One pass over the texts: a row for each document, and index rows as cells of (40 bits of signature,
    set) by part. A part and those 40 bits tell a bucket; where a set has one twice it keeps no slack."""
    schema = _wire_schema(_id_type(docs.schema[id_col].dataType))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, turn = bands.tables(), np.zeros(0, np.int64), 0
        for batch in batches:
            for lo, hi, h, r in sets_of(batch.column(1), k):
                n = hi - lo
                cls = set_digests(h, r, n).view(np.int64)
                sizes = np.bincount(r, minlength=n)
                # a set that has been seen in this task need not be indexed again
                new = np.zeros(n, bool)
                new[np.unique(cls, return_index=True)[1]] = True
                new &= (sizes > 0) & ~np.isin(cls, seen)
                seen = np.union1d(seen, cls[new])[-1_000_000:]
                sig, row, slack = signatures(h, r, np.where(new, sizes, 0), bands, t)
                sig = ((sig >> _U(40)) * _U(parts) >> _U(24)) << _U(40) | (sig & _U((1 << 40) - 1))
                order = np.argsort(sig)
                sig, row = sig[order], row[order]
                same = sig[1:] == sig[:-1]
                run = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
                row[run] = row[run][np.lexsort((row[run], sig[run]))]
                slack[row[1:][same & (row[1:] == row[:-1])]] = -1
                starts = np.flatnonzero(np.r_[True, ~same]) if len(sig) else np.zeros(0, np.int64)
                times = np.diff(np.r_[starts, len(sig)])
                owner, common = cls[row], np.zeros(len(sig), bool)
                slack -= limits.withheld
                if (times > limits.small).any():
                    # a common segment: its sets are paired with a hub here, and only the hub is sent on
                    hub = np.repeat(np.minimum.reduceat(owner, starts), times)
                    common = np.repeat(times > limits.small, times)
                    star = common & (owner != hub)
                    m = int(star.sum())
                    yield _record(schema, STAR, m, {"part": pa.array(((np.arange(m) + turn) % parts).astype(np.int32)), "sig": pa.array(sig[star].view(np.int64)), "a": pa.array(hub[star]), "b": pa.array(owner[star])})
                    first = np.zeros(len(sig), bool)
                    first[starts] = True
                    owner = np.where(common, hub, owner)
                    stay = ~common | first
                    sig, owner, common = sig[stay], owner[stay], common[stay]
                short = np.flatnonzero(new & (slack < 0))
                at = np.searchsorted(r, np.arange(n + 1))
                whole = pa.array([h[at[i] : at[i + 1]].view(np.int64) if new[i] and slack[i] < 0 else None for i in range(n)], pa.list_(pa.int64())) if len(short) else pa.nulls(n, pa.list_(pa.int64()))
                member = {"part": pa.array(((np.arange(n) + turn) % parts).astype(np.int32)), "doc_id": batch.column(0).slice(lo, n), "size": pa.array(sizes), "cls": pa.array(cls, mask=sizes == 0), "slack": pa.array(slack, mask=~new), "bits": parities(h, r, sizes), "shingles": whole}
                yield _record(schema, MEMBER, n, member)
                turn += n
                if len(sig):
                    part = (sig >> _U(40)).astype(np.int32)
                    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    low = sig.view(np.uint8).reshape(-1, 8)[:, :5]
                    ends = np.searchsorted(np.flatnonzero(common), np.r_[at, len(sig)])[:-1]
                    cells = {"low": _cells(at, len(sig), 5, low), "owners": _cells(at, len(sig), 8, owner), "common": _cells(ends, int(common.sum()), 5, low[common])}
                    yield _record(schema, INDEX, len(at), {"part": pa.array(part[at])} | cells)

    ddl = f"kind int, part int, doc_id {docs.schema[id_col].dataType.simpleString()}, size long, cls long, slack long, bits array<long>, shingles array<long>, sig long, a long, b long, low binary, owners binary, common binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(read), ddl)


def _candidates(indexed: DataFrame, id_type: str, id_arrow: pa.DataType, limits: Limits) -> DataFrame:
    """Rows sorted by part -> documents as they are, pairs of small buckets, and stars (sig, hub, set) of large ones."""
    schema = _wire_schema(id_arrow)
    for name in ("part", "low", "owners", "common"):
        schema = schema.remove(schema.get_field_index(name))

    def wide(cells: list) -> np.ndarray:
        raw = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, 5)
        out = np.zeros((len(raw), 8), np.uint8)
        out[:, :5] = raw
        return out.view("<u8").ravel().astype(np.uint64)

    def met(part: int, low: list, owners: list, common: list) -> Iterator[pa.RecordBatch]:
        sig, cls = wide(low), np.frombuffer(b"".join(owners), np.int64)
        order = np.argsort(sig)
        sig, cls = sig[order], cls[order]
        same = sig[1:] == sig[:-1]
        some = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        sig, cls = sig[some], cls[some]
        order = np.lexsort((cls, sig))
        sig, cls = sig[order], cls[order]
        if not len(sig):
            return
        new = np.r_[True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])]
        sig, cls = sig[new], cls[new]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        times = np.diff(np.r_[starts, len(sig)])
        large = np.repeat((times > limits.small) | np.isin(sig[starts], wide(common)), times)
        size, at = np.repeat(times, times), np.arange(len(sig)) - np.repeat(starts, times)
        a, b = [], []
        for d in range(1, limits.small):
            i = np.flatnonzero(~large & (at + d < size))
            if not len(i):
                break
            a.append(cls[i])
            b.append(cls[i + d])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            yield _record(schema, PAIR, int(new.sum()), {"a": pa.array(a[new]), "b": pa.array(b[new])})
        i = np.flatnonzero(large & (at > 0))
        if len(i):
            yield _record(schema, STAR, len(i), {"sig": pa.array((sig[i] | _U(part << 40)).view(np.int64)), "a": pa.array(cls[i - at[i]]), "b": pa.array(cls[i])})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = -1, ([], [], [])
        for batch in batches:
            kinds, parts = batch.column("kind").to_numpy(), batch.column("part").to_numpy()
            other = np.flatnonzero(kinds != INDEX)
            if len(other):
                got = batch.take(pa.array(other))
                yield pa.record_batch([got.column(f.name) for f in schema], schema=schema)
            cells = [batch.column(c) for c in ("low", "owners", "common")]
            for i in np.flatnonzero(kinds == INDEX):
                if parts[i] != here:
                    yield from met(here, *held)
                    here, held = int(parts[i]), ([], [], [])
                for x, c in zip(held, cells, strict=True):
                    x.append(c[i].as_py())
        yield from met(here, *held)

    return indexed.mapInArrow(lean(read), f"kind int, doc_id {id_type}, size long, cls long, slack long, bits array<long>, shingles array<long>, sig long, a long, b long")


def _near(size_a: str, bits_a: str, size_b: str, bits_b: str, bands: Bands) -> Column:
    """Whether sizes and parities allow the threshold."""
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    half = lambda x: (F.size(x) / 2).cast("int")
    folded = lambda x, y: F.when(F.size(x) > F.size(y), xor(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)))).otherwise(F.col(x))
    apart = F.aggregate(xor(folded(bits_a, bits_b), folded(bits_b, bits_a)), F.lit(0), lambda n, x: n + F.bit_count(x))
    apart = F.coalesce(apart, F.lit(0))  # of lengths that still differ, nothing is known
    sizes = F.least(size_a, size_b) * bands.den >= F.greatest(size_a, size_b) * bands.num
    return sizes & (apart * (bands.den + bands.num) <= (F.col(size_a) + F.col(size_b)) * (bands.den - bands.num))


def _fitting(pairs: DataFrame, classes: DataFrame, bands: Bands) -> DataFrame:
    of = lambda x: classes.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.distinct().join(of("a"), "a").join(of("b"), "b").filter(_near("size_a", "bits_a", "size_b", "bits_b", bands)).select("a", "b")


def _prefix(n: np.ndarray, bands: Bands) -> np.ndarray:
    """Of sets with n shingles that reach the threshold, one of the first so many is in both, in any common order."""
    return n - (n * bands.num + bands.den - 1) // bands.den + 1


def _sets(docs: DataFrame, wanted: DataFrame, short: DataFrame, k: int, bands: Bands, text_col: str, scratch: Scratch, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(cls and whole set of the wanted classes, pairs of the short classes), in one pass over the texts.

    ``short`` has cls and shingles. Their pairs share a shingle among the first of both, in hash order; they are
    few, and taken in as many passes as keep what is broadcast within ``local``.
    """
    spark = docs.sparkSession
    n_wanted = wanted.count()
    each = short.agg(F.sum(F.size("shingles"))).first()[0] or 0
    turns, out = max(1, -(-each // limits.local)), None
    names = ["cls", "shingles", "sure", "a", "b"]
    local = spark.sparkContext.broadcast(np.sort(np.array(wanted.toArrow().column(0), np.int64))) if n_wanted <= limits.local else None
    for turn in range(turns):
        asking = short.filter(F.pmod(F.xxhash64("cls"), F.lit(turns)) == turn).toArrow() if each else None
        lists = [np.asarray(x.values)[: int(_prefix(np.array(len(x)), bands))] for x in asking.column("shingles")] if each else []
        heads = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
        who = np.repeat(np.asarray(asking.column("cls")), [len(x) for x in lists]) if each else np.zeros(0, np.int64)
        order = np.argsort(heads)
        shared = spark.sparkContext.broadcast((heads[order], who[order]))

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.int64)
            keys, asked = shared.value
            for batch in batches:
                for lo, hi, h, r in sets_of(batch.column(0), k):
                    cls = set_digests(h, r, hi - lo).view(np.int64)
                    offsets = np.searchsorted(r, np.arange(hi - lo + 1))
                    take = np.zeros(hi - lo, bool)
                    take[np.unique(cls, return_index=True)[1]] = True
                    take &= (np.diff(offsets) > 0) & ~np.isin(cls, seen)
                    if len(keys):
                        place = np.arange(len(h)) - offsets[r]
                        front = np.flatnonzero(take[r] & (place < _prefix(np.diff(offsets), bands)[r]))
                        first, last = (np.searchsorted(keys, h[front], side=s) for s in ("left", "right"))
                        hit = np.repeat(front, last - first)
                        at = np.arange(len(hit)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
                        a, b = cls[r[hit]], asked[at]
                        ok = a != b
                        hit_rows = np.unique(r[hit])
                        pair = np.unique(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], 1), axis=0)
                        if len(pair):
                            yield pa.record_batch([pa.nulls(len(pair), pa.int64()), pa.nulls(len(pair), pa.list_(pa.int64())), pa.array(np.ones(len(pair), bool)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names)
                    else:
                        hit_rows = np.zeros(0, np.int64)
                    sure = np.isin(cls, local.value) if local is not None else np.zeros(hi - lo, bool)
                    sure[hit_rows] = True
                    if local is not None:
                        take &= sure
                    seen = np.union1d(seen, cls[take])[-1_000_000:]
                    rows = np.flatnonzero(take)
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64))).take(pa.array(rows))
                    yield pa.record_batch([pa.array(cls[rows]), lists, pa.array(sure[rows]), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names)

        every = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(read), "cls long, shingles array<long>, sure boolean, a long, b long")
        out = every if out is None else out.unionByName(every)
    if local is None:
        out = out.join(wanted.withColumn("asked", F.lit(True)), "cls", "left").filter("sure OR asked")
    out = out.select("cls", "shingles", "a", "b")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All copies of a set come to one task, which keeps the first."""
        seen: set[int] = set()
        for batch in batches:
            cls = batch.column(0).to_pylist()
            keep = []
            for i, c in enumerate(cls):
                if c is None:
                    keep.append(i)
                elif c not in seen:
                    seen.add(c)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    table = scratch.table(out.repartition(F.coalesce("cls", F.xxhash64("a", "b"))).mapInArrow(lean(once), out.schema), "sets")
    return table.filter("cls IS NOT NULL").select("cls", "shingles"), table.filter("cls IS NULL").select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands, limits: Limits) -> DataFrame:
    """Pairs (few are left that do not reach the threshold). The set of a hub is sent once for ``per_hub`` pairs."""
    of = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    if of.count() <= limits.few:
        sets = sets.join(F.broadcast(of), "cls", "left_semi")
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / limits.per_hub).cast("int").alias("copies"))
    dealt = pairs.join(copies, "a").withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int")).drop("copies")
    left = sets.join(copies.withColumnRenamed("a", "cls"), "cls").select(F.col("cls").alias("a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return dealt.join(right, "b").join(left, ["a", "copy"]).filter(both * bands.den >= union * bands.num).select("a", "b")


def _with_component(rows: DataFrame, joined: DataFrame, cls: str = "cls", component: str = "component") -> DataFrame:
    names = joined.select(F.col("node").alias(cls), F.col("component").alias(component))
    return rows.join(names, cls, "left").withColumn(component, F.coalesce(component, cls))


def _asking(large: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """The sets that have to ask. large: cls, slack and sigs, the large buckets of the set.

    Of a bucket's sets, those outside of its largest component are its minor ones; of two sets that are not
    connected, one at least is minor in each bucket that they share. A set that is minor in buckets that cost no
    more than half of its slack may pass over all of them: were both to pass over all that they share, that
    would take more than the slack of either.
    """
    # a set whose buckets all together cost no more than half of its slack never has to ask
    cost = F.lit(1) + F.col("sig").bitwiseAND(1)
    whole = F.aggregate("sigs", F.lit(0).cast("long"), lambda a, sig: a + 1 + sig.bitwiseAND(1))
    named = large.join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left")
    named = named.select("cls", "slack", "sigs", F.coalesce("component", "cls").alias("component"), F.col("component").isNull().alias("alone"), whole.alias("whole"))
    may = named.filter("slack >= 0 AND 2 * whole > slack")
    main = named.select(F.explode("sigs").alias("sig"), "component").groupBy("sig", "component").agg(F.count(F.lit(1)).alias("n"))
    main = main.groupBy("sig").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    main = scratch.table(main, "mains")
    # a set without a link is a component: it is minor in all of its buckets but those that name it, which need no look
    # at each bucket
    held = main.groupBy(F.col("main").alias("component")).agg(F.sum(cost).alias("held"))
    single = may.filter("alone").join(held, "component", "left").select("cls", "slack", (F.col("whole") - F.coalesce("held", F.lit(0))).alias("cost"))
    linked = may.filter("NOT alone").select(F.explode("sigs").alias("sig"), "cls", "component", "slack")
    minor = linked.join(main.filter("parts > 1").select("sig", "main"), "sig").filter("component <> main")
    minor = minor.groupBy("cls").agg(F.first("slack").alias("slack"), F.sum(cost).alias("cost"))
    return single.unionByName(minor).filter("2 * cost > slack").select("cls")


def _common(sets: DataFrame, limits: Limits) -> np.ndarray:
    """The shingles that several sets of a bounded sample hold, the rarest first."""
    n = sets.count()
    few = sets.filter(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < max(1, (limits.sample << 20) // max(n, 1)))
    counts = few.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "s").limit(limits.common).toArrow()
    return np.array(top.column("s"), np.int64)[::-1]


def _by_prefix(sets: DataFrame, bands: Bands, scratch: Scratch, limits: Limits) -> DataFrame:
    """Pairs of asking sets with those of other components that share a shingle of both prefixes.

    sets: cls, shingles, component, asks, bits. Common shingles come last in the order, so that prefixes hold few. The
    first shingle that two sets share leaves enough behind it in both; other shared ones need give no pair.
    """
    common = _common(sets, limits)
    by = np.argsort(common)
    shared = sets.sparkSession.sparkContext.broadcast((common[by], by))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            last = np.zeros(len(flat), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                last = np.where(keys[at] == flat, rank[at] + 1, 0)
            order = np.lexsort((flat, last, row))
            place = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]
            front = order[place < _prefix(sizes, bands)[row]]
            behind = sizes[row[front]] - place[place < _prefix(sizes, bands)[row]]
            yield pa.record_batch([pa.array(flat[front]), *(batch.column(i).take(pa.array(row[front])) for i in (0, 2, 3, 4)), pa.array(sizes[row[front]].astype(np.int64)), pa.array(behind)], ["shingle", "cls", "component", "asks", "bits", "size", "behind"])

    tokens = scratch.table(sets.select("cls", "shingles", "component", "asks", "bits").mapInArrow(lean(read), "shingle long, cls long, component long, asks boolean, bits array<long>, size long, behind long"), "prefixes")
    mixed = tokens.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("asks").alias("asked")).filter("asked AND least <> most").select("shingle")
    tokens = scratch.table(tokens.join(mixed, "shingle", "left_semi"), "prefixes-met")
    asking = tokens.filter("asks").select("shingle", F.col("cls").alias("c"), F.col("component").alias("other"), F.col("size").alias("size_c"), F.col("bits").alias("bits_c"), F.col("behind").alias("behind_c"))
    enough = F.least("behind", "behind_c") * (bands.den + bands.num) >= (F.col("size") + F.col("size_c")) * bands.num
    pairs = tokens.join(asking, "shingle").filter("component <> other AND (NOT asks OR cls < c)").filter(enough).filter(_near("size", "bits", "size_c", "bits_c", bands))
    return pairs.select(F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are a component
    of their own; texts with fewer than k words have one shingle; repeated rows and equal sets fall into one
    class; a component's id is its smallest id, null if all its ids are null; no rows give no rows; other
    columns are not read. Whole texts count.
    """
    spark, limits = docs.sparkSession, limits or Limits()
    scratch = Scratch(spark, "jaccard", small=True)
    docs = docs.select(id_col, text_col)
    bands = _sampled(docs, k, Bands(num, den), text_col, limits)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType
    indexed = _index(docs, k, bands, id_col, text_col, parts, limits).repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    found = scratch.table(_candidates(indexed, id_type.simpleString(), _id_type(id_type), limits), "found")
    members = found.filter(F.col("kind") == MEMBER).select("doc_id", "size", "cls", "slack")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    classes = scratch.table(
        found.filter((F.col("kind") == MEMBER) & F.col("cls").isNotNull()).groupBy("cls")
        .agg(F.first("size").alias("size"), F.min("slack").alias("slack"), F.first("bits").alias("bits"), first("shingles"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "classes",
    )
    star = found.filter(F.col("kind") == STAR)
    pairs = scratch.table(_fitting(found.filter(F.col("kind").isin(PAIR, STAR)).select("a", "b"), classes, bands), "pairs")
    # a set's own segments bound its list of buckets
    large = star.select("sig", F.col("b").alias("cls")).unionByName(star.select("sig", F.col("a").alias("cls"))).groupBy("cls").agg(F.collect_set("sig").alias("sigs"))
    large = scratch.table(large.join(classes.select("cls", "slack"), "cls"), "large")
    short = classes.filter("slack < 0").select("cls", "shingles")
    wanted = scratch.table(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(large.select("cls")).unionByName(short.select("cls")).distinct(), "wanted")
    sets, more = _sets(docs, wanted, short, k, bands, text_col, scratch, limits)
    pairs = pairs.unionByName(scratch.table(_fitting(more, classes, bands), "pairs-short")).distinct()
    links = scratch.table(_verified(pairs, sets, bands, limits), "links")
    joined = scratch.table(components(links, scratch, "joined"), "joined-at")
    asking = scratch.table(_asking(large, joined, scratch), "asking")
    if not asking.isEmpty():
        inside = large.select("cls").join(asking.withColumn("asks", F.lit(True)), "cls", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        inside = scratch.table(_with_component(inside, joined).join(classes.select("cls", "bits"), "cls"), "inside")
        near = sets.join(F.broadcast(inside) if inside.count() <= limits.few else inside, "cls")
        met = scratch.table(_by_prefix(near, bands, scratch, limits), "pairs-prefix")
        links = scratch.table(links.unionByName(_verified(met, sets, bands, limits)).distinct(), "links-all")
        scratch.drop("prefixes", "prefixes-met", "pairs-prefix", "asking")
        joined = scratch.table(components(links, scratch, "joined-all"), "joined-at-all")
    scratch.drop("pairs", "pairs-short", "large", "mains", "wanted", "sets", "links")
    # most sets are alone: only the others need a name
    many = _with_component(classes.select("cls", "n", "least"), joined)
    named = many.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    named = scratch.table(many.select("cls", "component").join(named, "component").select("cls", "component_id"), "named")
    return members.join(named, "cls", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=85, den=100)
