"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A window is a run of
``n`` words of an item; an item with fewer words is one window. Windows are broadcast as sorted 64-bit hashes with
their words while they take ``BROADCAST_BYTES`` at most. Texts are scanned once; a window of a text whose hash is
in the set is verified word for word. More windows than that are joined by hash instead: texts send the hashes of
their windows, get back the items' windows with these hashes, and verify them in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PLACE, Scratch, with_place
from .words import NOT_ALNUM, Words, mix, split_words, text_chunks

N = 10
BROADCAST_BYTES = 64 << 20
#: A hash that many texts hold is joined in so many parts.
SALTS = 32
#: Windows that are verified at a time.
VERIFIED = 1 << 16
_U = np.uint64
_FACTORS = mix(np.arange(1, 1025, dtype=np.uint64)) | _U(1)


def window_hashes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of so many words within a row."""
    n = len(w.hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total += w.hashes[i : n + i] * _FACTORS[i % 1024]
    at = np.flatnonzero(w.rows[:n] == w.rows[length - 1 :])
    return at, mix(total[at] + _U(length))


def _texts_of(w: Words, at: np.ndarray, length: int) -> tuple[list[bytes], list[bytes]]:
    """Letters and word lengths of the windows that begin at these words."""
    ends = np.r_[w.begins, len(w.letters)]
    letters, sizes = w.letters.tobytes(), w.lengths.astype(np.int32)
    return [letters[ends[i] : ends[i + length]] for i in at], [sizes[i : i + length].tobytes() for i in at]


def item_windows(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """hash, letters, sizes (of the words, in bytes) and items (ids as strings) of every window.

    Rows that share an id are one item. Rows without an id, or without words, have no windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                w = split_words(data, offsets, NOT_ALNUM)
                count = np.bincount(w.rows, minlength=hi - lo)
                for length in {min(int(c), n) for c in count if c}:
                    at, hashes = window_hashes(w, length)
                    ok = (count[w.rows[at]] == length) | (length == n)
                    at, hashes = at[ok], hashes[ok]
                    letters, sizes = _texts_of(w, at, length)
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(w.rows[at])), pa.array(hashes.view(np.int64)), pa.array(letters, pa.binary()), pa.array(sizes, pa.binary())], ["item", "hash", "letters", "sizes"])

    cut_items = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = cut_items.mapInArrow(cut, "item string, hash long, letters binary, sizes binary")
    return rows.groupBy("hash", "letters", "sizes").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows in the order of their hashes."""

    def __init__(self, hashes: np.ndarray, letters: list[bytes], sizes: list[bytes], items: list[list[str]]):
        order = np.argsort(hashes.view(np.uint64), kind="stable")
        self.hashes = hashes.view(np.uint64)[order]
        words = np.array([len(x) // 4 for x in sizes], np.int64)[order]
        self.words, self.lengths = words, sorted(set(words.tolist()))
        self.letters = np.frombuffer(b"".join(letters[i] for i in order), np.uint8)
        self.size = np.array([len(letters[i]) for i in order], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.sizes = np.frombuffer(b"".join(sizes[i] for i in order), np.int32)
        self.sizes_at = np.cumsum(words) - words
        self.names = sorted({x for own in items for x in own}, key=lambda x: x.encode())
        code = {x: i for i, x in enumerate(self.names)}
        self.n_items = np.array([len(items[i]) for i in order], np.int64)
        self.items = np.array([code[x] for i in order for x in items[i]], np.int64)
        self.items_at = np.cumsum(self.n_items) - self.n_items
        # a table of bits by the hashes' upper bits rejects most windows of a text
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> _U(44)).astype(np.int64)] = True

    def _same(self, w: Words, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether the words from ``at`` on are those of the window."""
        ends = np.r_[w.begins, len(w.letters)]
        n = self.words[window]
        ok = ends[at + n] - ends[at] == self.size[window]
        for i in range(int(n.max()) if len(n) else 0):
            has = i < n
            ok[has] &= w.lengths[at[has] + i] == self.sizes[self.sizes_at[window[has]] + i]
        left = np.flatnonzero(ok)
        size = self.size[window[left]]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        equal = w.letters[np.repeat(ends[at[left]], size) + step] == self.letters[np.repeat(self.at[window[left]], size) + step]
        ok[left] = np.logical_and.reduceat(equal, np.cumsum(size) - size) if len(left) else True
        return ok

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in self.lengths:
            at, hashes = window_hashes(w, length)
            maybe = np.flatnonzero(self.bits[(hashes >> _U(44)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.hashes, hashes[maybe], side=side) for side in ("left", "right"))
            some = hi > lo
            at, lo, several = at[maybe[some]], lo[some], (hi - lo)[some]
            at = np.repeat(at, several)
            window = np.repeat(lo, several) + np.arange(len(at)) - np.repeat(np.cumsum(several) - several, several)
            own = self.words[window] == length
            at, window = at[own], window[own]
            for a in range(0, len(at), VERIFIED):
                part = slice(a, a + VERIFIED)
                same = self._same(w, at[part], window[part])
                found_at.append(at[part][same])
                found.append(window[part][same])
        return np.concatenate(found_at), np.concatenate(found)

    def report(self, w: Words, n_rows: int, offsets: np.ndarray) -> dict:
        """What a chunk's rows hold: n_words, n_hit, items, and spans of hit words (bytes within the row's text)."""
        at, window = self.find(w)
        step = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.words[window], -1)
        hit = np.cumsum(step)[:-1] > 0
        several = self.n_items[window]
        place = np.repeat(self.items_at[window], several) + np.arange(int(several.sum())) - np.repeat(np.cumsum(several) - several, several)
        pairs = np.unique(np.repeat(w.rows[at], several) * max(len(self.names), 1) + self.items[place])
        row_of, item_of = pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)
        run = hit & np.r_[True, ~hit[:-1] | (w.rows[1:] != w.rows[:-1])] if len(hit) else hit
        first = np.flatnonzero(run)
        ends = np.flatnonzero(hit & np.r_[~hit[1:] | (w.rows[1:] != w.rows[:-1]), True]) if len(hit) else first
        rows = w.rows[first]
        return {
            "n_words": np.bincount(w.rows, minlength=n_rows), "n_hit": np.bincount(w.rows[hit], minlength=n_rows),
            "items": (np.searchsorted(row_of, np.arange(n_rows + 1)), item_of),
            "spans": (np.searchsorted(rows, np.arange(n_rows + 1)), w.starts[first] - offsets[rows], w.starts[ends] + w.lengths[ends] - offsets[rows]),
        }


REPORT = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>, clean string"


def _reported(texts: pa.Array, windows: WindowSet) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, end row, the columns of REPORT) of consecutive rows."""
    names = pa.array(windows.names, pa.string())
    for lo, hi, data, offsets in text_chunks(texts):
        got = windows.report(split_words(data, offsets, NOT_ALNUM), hi - lo, offsets)
        item_at, item = got["items"]
        at, start, end = got["spans"]
        clean: list[str | None] = [None] * (hi - lo)
        for i in np.flatnonzero(np.diff(at)):
            text, kept, done = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
            for a, b in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]], strict=True):
                kept.append(text[done:a])
                done = b
            clean[i] = b"".join([*kept, text[done:]]).decode()
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
        lists = [pa.ListArray.from_arrays(pa.array(item_at.astype(np.int32)), names.take(pa.array(item))), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)]
        yield lo, hi, [pa.array(got["n_words"]), pa.array(got["n_hit"]), *lists, pa.array(clean, pa.string())]


def scan(docs: DataFrame, items: DataFrame, n: int = N, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """row (all columns of docs), n_words, n_hit, items (ids of the items with a window in the text, sorted as
    strings), spans (runs of hit words, as bytes of the text) and clean (the text without its spans; null where
    nothing is hit).

    Null and empty texts hold no words. Rows that repeat are scanned each. No items give no hits."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    windows = scratch.table(item_windows(items, n, item_id, item_text), "windows")
    held = F.octet_length("letters") + F.octet_length("sizes") + 16 + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16)
    size = windows.agg(F.sum(held.cast("long"))).first()[0] or 0
    row_type = docs.schema.simpleString()
    if size <= broadcast_bytes:
        table = windows.toArrow()
        names = [[str(x) for x in own] for own in table["items"].to_pylist()]
        shared = spark.sparkContext.broadcast(WindowSet(table["hash"].to_numpy(), table["letters"].to_pylist(), table["sizes"].to_pylist(), names))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, columns in _reported(batch.column(0).field(text_col), shared.value):
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *columns], ["row", "n_words", "n_hit", "items", "spans", "clean"])

        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(find, f"row {row_type}, {REPORT}")

    lengths = [r[0] for r in windows.select((F.octet_length("sizes") / 4).cast("int")).distinct().collect()]  # at most n

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                w = split_words(data, offsets, NOT_ALNUM)
                for length in lengths:
                    at, hashed = window_hashes(w, length)
                    own = pa.array(w.rows[at])
                    yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(own), batch.column(1).slice(lo, hi - lo).take(own), pa.array(hashed.view(np.int64))], [*PLACE, "hash"])

    try:
        placed = with_place(docs)
    except AnalysisException:  # not read from files
        placed = with_place(scratch.table(docs, "rows"))
    sent = placed.select(*PLACE, F.col(f"`{text_col}`").alias("text")).mapInArrow(hashes, f"{PLACE[0]} string, {PLACE[1]} long, hash long")
    salted = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own_salt = F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).cast("int")
    met = sent.withColumn("salt", own_salt).join(salted, ["hash", "salt"]).select(*PLACE, F.struct("hash", "letters", "sizes", "items").alias("window"))
    per_row = met.groupBy(*PLACE).agg(F.collect_set("window").alias("windows"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = WindowSet(np.zeros(0, np.int64), [], [], [])
        for batch in batches:
            for i, own in enumerate(batch.column(1).to_pylist()):
                own = own or []
                mine = WindowSet(np.array([x["hash"] for x in own], np.int64), *([x[c] for x in own] for c in ("letters", "sizes", "items"))) if own else none
                for _, _, columns in _reported(batch.column(0).field(text_col).slice(i, 1), mine):
                    yield pa.record_batch([batch.column(0).slice(i, 1), *columns], ["row", "n_words", "n_hit", "items", "spans", "clean"])

    return placed.join(per_row, PLACE, "left").select(row, "windows").mapInArrow(verify, f"row {row_type}, {REPORT}")


def decontaminate(docs: DataFrame, items: DataFrame, drop: str = "spans", n: int = N, text_col: str = "text", **names) -> DataFrame:
    """docs without the hit spans of their texts, or without the documents that hold any (``drop="documents"``)."""
    if drop not in ("spans", "documents"):
        raise ValueError("drop is spans or documents")
    found = scan(docs, items, n, text_col, **names)
    if drop == "documents":
        return found.filter("n_hit = 0").select("row.*")
    return found.withColumn("row", F.col("row").withField(f"`{text_col}`", F.coalesce("clean", F.col("row").getField(text_col)))).select("row.*")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(docs.select("doc_id", "text"), items)
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT rid, p, k, array_to_string(ws[p : p + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT rid, p, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
hw AS (SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS w FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS own FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items, sha256(coalesce(own, '')) AS items_sha256, hw.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hw ON d.rid = hw.rid LEFT JOIN hi ON d.rid = hi.rid
"""
