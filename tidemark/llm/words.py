"""Words of whole text columns as 64-bit hashes, computed on a batch's bytes without a loop over texts.

A word is a run of bytes other than space and \\x09-\\x0D (in UTF-8 these bytes occur nowhere else), with A-Z
lower-cased. Its hash is the sum of a random number for each byte at each place, mixed at the end; two
different words meet with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PLACES = 64
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes other than ASCII letters, digits and those of characters beyond ASCII.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, PLACES * 256, dtype=np.uint64)
#: Bytes of text that are worked on at a time (at least one text).
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def text_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; a null text has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and n and offsets[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@dataclass(frozen=True)
class Words:
    """Words in text order: hash, row, first byte; their letters follow each other without gaps, word i's at begins[i]."""

    hashes: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word), in text order."""
    w = split_words(data, offsets)
    return w.hashes, w.rows


def split_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """The words of a chunk; ``between`` marks the bytes that no word holds."""
    word = ~between[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none, none, none.astype(np.uint8))
    at = np.flatnonzero(word)
    begins = np.searchsorted(at, starts)
    lengths = np.diff(np.r_[begins, len(at)])
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    letters = _LOWER[data[at]]
    value = _TABLE[((place & (PLACES - 1)) << 8) + letters]
    if lengths.max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    hashes = mix(np.add.reduceat(value, begins))
    return Words(hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, begins, lengths, letters.astype(np.uint8))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row; a row with fewer words has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    if len(hashes) >= k:
        total = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            total += hashes[i : len(hashes) - k + 1 + i] * factor[i]
        whole = rows[: len(total)] == rows[k - 1 :]
        out, out_rows = mix(total[whole]), rows[: len(total)][whole]
    else:
        out, out_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        starts = np.cumsum(counts) - counts
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += hashes[starts[short[has]] + i] * factor[i]
        extra = mix(extra + counts[short].astype(np.uint64) * factor[k - 1])
        out, out_rows = np.r_[out, extra], np.r_[out_rows, short]
    return out, out_rows


def distinct_sets(out: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, sorted by row and hash."""
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    if len(out):
        new = np.r_[True, (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])]
        out, rows = out[new], rows[new]
    return out, rows
