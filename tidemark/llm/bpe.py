"""Byte-pair merging of many pre-tokens at once.

A batch of distinct pre-tokens is held as one ragged array of symbols with the number of its pre-token
beside each. In every round each pre-token applies its own lowest-ranked adjacent pair at all places at once
(of overlapping places, every other one from the left); pre-tokens without a mergeable pair leave the batch.
A merge can only enable pairs of a higher rank than its own, so this gives what merging one pair at a time,
lowest rank first and leftmost first, gives.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import _TABLE, PLACES, mix, text_chunks

NONE = np.iinfo(np.int64).max
#: Bytes of text that are merged at a time; each takes some hundred bytes on the way.
CHUNK = 1 << 18
#: Classes of bytes in runs that are split without the pattern: letters (ASCII, and the lead bytes of U+00C0 to
#: U+024F, which are all letters but for two), digits, white space, other marks; 9: left to the pattern.
LETTER, DIGIT, SPACE, MARK, ODD = 0, 1, 2, 3, 9
_CLASS = np.full(256, MARK, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(28, 32), 39, *range(0xC0, 0xC3), *range(0xCA, 256)]] = ODD
_CLASS[0x80:0xC0] = LETTER  # goes with the byte before


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Symbols of pre-tokens by a byte-level vocabulary in the ``tokenizers`` JSON format."""

    def __init__(self, path: str, pattern: str, keep: int = 400_000, longest: int = 256):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.first = np.zeros(256, np.int64)
        for ch, b in alphabet.items():
            self.first[b] = vocab[ch]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.new = keys[order], order, new
        both = np.arange(65536)
        self.byte_ranks = self.rank(self.first[both >> 8], self.first[both & 255])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.words = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.keep, self.longest = keep, longest
        self.young, self.old = Known.empty(), Known.empty()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the symbols of all words, which follow each other in ``data``, and each word's number of symbols."""
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        sym = self.first[raw]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[:-1] == seq[1:], self.byte_ranks[raw[:-1] << 8 | raw[1:]], NONE)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(seq)])
            low = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            still = low != NONE
            if not still.all():
                done.append((sym[~still], seq[~still]))
                sym, seq, rank, low = sym[still], seq[still], rank[still], low[still]
                if not len(sym):
                    break
            # of a run of hits in a row (a a a ...), the 1st, 3rd, 5th ... take effect
            at = np.flatnonzero(rank == low)
            head = np.r_[True, np.diff(at) > 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            sym[at] = self.new[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            # only pairs with a new symbol have a new rank
            fresh = place[at]
            fresh = np.concatenate([fresh, fresh[fresh > 0] - 1])
            inner = fresh[fresh + 1 < len(sym)]
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[fresh] = NONE
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        sym, seq = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=len(sizes))

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; special strings stand as they are and are not split."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.words.findall(part)
        return out

    def split_runs(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all runs (data[start : start + size]) in order, and each run's number of ids.

        Runs of letters, digits, marks and single white space are split where the class changes; others, and
        those in ``slow``, by the pattern, one at a time.
        """
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        raw = data[np.repeat(starts, sizes) + place]
        kind = _CLASS[raw]
        run = np.repeat(np.arange(len(sizes)), sizes)
        odd = kind == ODD
        odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        odd[1:] |= (kind[1:] == SPACE) & (kind[:-1] == SPACE) & (place[1:] > 0)
        slow = slow | (np.bincount(run[odd], minlength=len(sizes)) > 0)
        new = np.ones(len(raw), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SPACE) | (place[1:] == 0)
        new[(place == 1) & np.r_[False, raw[:-1] == 32]] = False  # a space goes with what follows it
        fast = ~slow[run]
        begins = np.flatnonzero(new[fast])
        ids, counts = self.merge(raw[fast].tobytes(), np.diff(np.r_[begins, int(fast.sum())]))
        per = np.bincount(run[fast][begins], weights=counts, minlength=len(sizes)).astype(np.int64)
        if not slow.any():
            return ids, per
        ends = np.cumsum(sizes)
        whole = raw.tobytes()
        split = [self.pieces(whole[ends[i] - sizes[i] : ends[i]].decode()) for i in np.flatnonzero(slow)]
        known = self.learn(split)
        lists = [np.concatenate([known[p] for p in x]) for x in split]
        per[slow] = [len(x) for x in lists]
        out = np.zeros(int(per.sum()), np.int64)
        theirs = np.repeat(slow, per)
        out[theirs], out[~theirs] = np.concatenate(lists), ids
        return out, per

    def learn(self, split: list[list[str]]) -> dict[str, np.ndarray]:
        """The ids of each pre-token of the lists."""
        fresh = set().union(*split)
        known = {p: np.array([self.special[p]]) for p in fresh.intersection(self.special)}
        plain = list(fresh.difference(known))
        parts = [p.encode() for p in plain]
        ids, counts = self.merge(b"".join(parts), np.array([len(p) for p in parts], np.int64))
        known.update(zip(plain, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        return known

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of a chunk in order, and each text's number of ids."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        first, last = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
        text_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
        # texts in which a space does not begin a pre-token, or which may hold special strings, stay whole
        space = data == 32
        ws_end, ws_start = _white(data)
        wide = space.copy()
        wide[1:] &= ws_end[:-1]
        wide[first] = False
        after = np.r_[ws_start[1:], False]
        after[last] = True
        whole = np.zeros(n, bool)
        whole[text_of(np.flatnonzero(wide & after))] = True
        raw = data.tobytes()
        for x in self.special:
            if (mark := x.encode()) in raw:
                at = raw.find(mark)
                while at >= 0:
                    whole[text_of(at)] = True
                    at = raw.find(mark, at + 1)
        begin = space & ~np.repeat(whole, np.diff(offsets))
        begin[first] = True
        starts = np.flatnonzero(begin)
        sizes = np.diff(np.r_[starts, len(data)])
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        value = _TABLE[((place & (PLACES - 1)) << 8) + data]
        far = np.flatnonzero(place >= PLACES)
        value[far] = mix(value[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys, at, which = np.unique(mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
        parts = [self.young, self.old]
        hits = [k.find(keys) for k in parts]
        fresh = np.flatnonzero((hits[0] < 0) & (hits[1] < 0))
        if len(fresh):
            ids, counts = self.split_runs(data, starts[at[fresh]], sizes[at[fresh]], whole[text_of(starts[at[fresh]])])
            new = Known(keys[fresh], np.cumsum(counts) - counts, counts, ids.astype(np.uint32))
        else:
            new = Known.empty()
        parts.append(new)
        hits.append(np.full(len(keys), -1))
        hits[2][fresh] = np.arange(len(fresh))
        base = np.cumsum([0, *(len(k.ids) for k in parts)])
        begin_u, count_u = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, hit, b in zip(parts, hits, base, strict=False):
            yes = hit >= 0
            begin_u[yes], count_u[yes] = k.starts[hit[yes]] + b, k.counts[hit[yes]]
        counts = count_u[which]
        out = np.concatenate([k.ids for k in parts])[np.repeat(begin_u[which] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        self.young = self.young.joined(new.where(sizes[at[fresh]] <= self.longest))
        if len(self.young.keys) > self.keep // 4:
            grown = self.old.joined(self.young)
            self.old, self.young = grown if len(grown.keys) <= self.keep else self.young, Known.empty()
        return out, np.bincount(text_of(starts), weights=counts, minlength=n).astype(np.int64)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and each text's number of ids.

        Texts are cut before single spaces, where pre-tokens end anyway. A run between two spaces is known by a
        64-bit hash, and what it gives is kept, in two generations of which the older one is let go.
        """
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_chunks(texts, CHUNK):
            i, c = self.chunk(data, offsets)
            ids.append(i)
            counts.append(c)
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []


@dataclass
class Known:
    """What runs give: sorted hashes of the runs, and for each the place and number of its ids."""

    keys: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    @staticmethod
    def empty() -> Known:
        return Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def where(self, take: np.ndarray) -> Known:
        counts = self.counts[take]
        return Known(self.keys[take], np.cumsum(counts) - counts, counts, self.ids[np.repeat(take, self.counts)])

    def joined(self, other: Known) -> Known:
        keys = np.r_[self.keys, other.keys]
        order = np.argsort(keys)
        return Known(keys[order], np.r_[self.starts, other.starts + len(self.ids)][order], np.r_[self.counts, other.counts][order], np.r_[self.ids, other.ids])


def _white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that end, and bytes that begin, a character of white space (Unicode's)."""
    ends = np.isin(data, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
    starts = ends.copy()
    n = len(data)
    for lead, width in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data[: max(n - width + 1, 0)] == lead)
        one, two = data[at + 1], data[at + width - 1]
        yes = {
            0xC2: (one == 0x85) | (one == 0xA0),
            0xE1: (one == 0x9A) & (two == 0x80),
            0xE2: (one == 0x80) & ((two <= 0x8A) | np.isin(two, [0xA8, 0xA9, 0xAF])) | (one == 0x81) & (two == 0x9F),
            0xE3: (one == 0x80) & (two == 0x80),
        }[lead]
        starts[at[yes]] = True
        ends[at[yes] + width - 1] = True
    return ends, starts


_mergers: dict[tuple, Merger] = {}


def merger(path: str, pattern: str) -> Merger:
    """One per Python worker: loading a vocabulary takes longer than a batch."""
    if (path, pattern) not in _mergers:
        _mergers[path, pattern] = Merger(path, pattern)
    return _mergers[path, pattern]
