"""Vectorised text primitives shared by the operators of this subpackage.

Executors see text as Arrow batches.  A batch is walked in slices of about two megabytes
(a longer document is a slice of its own), and words are found and fingerprinted with array
operations over the slice's bytes, so no operator runs Python code per word or per character.

Fingerprints are 64-bit: a prefix sum of random byte values times powers of an odd number
modulo 2**64, taken between the ends of a word, divided by the power of its start and mixed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_rng = random.Random(20240131)
_BYTE = np.array([_rng.getrandbits(64) for _ in range(256)], dtype=U64)
GRAM = [_rng.getrandbits(64) | 1 for _ in range(64)]
SLICE_BYTES = 2 << 20

#: White space of the word rule [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_SPACED = ~_SPACE
#: Bytes of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
WORD_ALNUM = np.zeros(256, dtype=bool)
WORD_ALNUM[0x30:0x3A] = WORD_ALNUM[0x61:0x7B] = WORD_ALNUM[0x80:] = True
#: Letters, and every byte of a character outside ASCII
WORD_LETTER = np.zeros(256, dtype=bool)
WORD_LETTER[0x41:0x5B] = WORD_LETTER[0x61:0x7B] = WORD_LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        made = []
        for base in (_P, _PINV):
            steps = np.full(size, base & _MASK, dtype=U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of values[start:end] (64-bit values per position)."""
    up, down = powers(len(values) + 1)
    total = np.empty(len(values) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


class Slice:
    """Consecutive texts of a batch: rows lo..hi, their bytes, and each row's first byte."""

    def __init__(self, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.data, self.offsets = rows, data, offsets

    def __len__(self) -> int:
        return len(self.rows)

    def words(self, kind: np.ndarray = WORD_SPACED, lower: bool = True) -> Words:
        return Words(self, kind, lower)


class Words:
    """start, end: bytes of each word; doc: its row in the slice; first: each row's first word."""

    def __init__(self, part: Slice, kind: np.ndarray, lower: bool):
        self.bytes = _LOWER[part.data] if lower else part.data
        n = len(self.bytes)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1 : n + 1] = kind[self.bytes]
        at = part.offsets
        edges = inside[1:] != inside[:-1]
        starts = np.flatnonzero(edges & inside[1:])
        ends = np.flatnonzero(edges & inside[:-1])
        # a row may end inside a word that the next row's first byte would continue
        cuts = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        if len(cuts):
            starts = np.sort(np.concatenate([starts, cuts]))
            ends = np.sort(np.concatenate([ends, cuts]))
        self.start, self.end = starts, ends
        self.first = np.searchsorted(starts, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(part)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.bytes], self.start, self.end)

    def text(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def grams(h: np.ndarray, words: Words, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) of every run of n words within a row; short: a row of fewer words, but
    not none, gives its whole sequence."""
    m = len(h) - n + 1
    if m > 0:
        g = np.zeros(m, dtype=U64)
        for k in range(n):
            g += h[k : m + k] * U64(GRAM[k])
        keep = words.doc[: m] == words.doc[n - 1 :]
        g, doc = mix(g[keep]), words.doc[: m][keep]
    else:
        g, doc = np.zeros(0, U64), np.zeros(0, np.int64)
    if short:
        few = np.flatnonzero((words.count > 0) & (words.count < n))
        if len(few):
            extra = np.zeros(len(few), dtype=U64)
            for k in range(n - 1):
                has = words.count[few] > k
                extra[has] += h[words.first[few[has]] + k] * U64(GRAM[k])
            extra = mix(extra + words.count[few].astype(U64) * U64(GRAM[40]))
            g, doc = np.concatenate([g, extra]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            g, doc = g[order], doc[order]
    return g, doc


def sequence_hashes(h: np.ndarray, words: Words) -> np.ndarray:
    """A fingerprint of each row's whole word sequence (0 without words)."""
    out = span_hashes(h, words.first[:-1], words.first[1:])
    out[words.count == 0] = 0
    return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of at most so many bytes, or of one row; every row is in one of them."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        at = offsets[lo : hi + 1]
        yield Slice(np.arange(lo, hi), data[at[0] : at[-1]], at - at[0])
        lo = hi


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start:start+length] of each item, end to end."""
    total = int(length.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(length)
    shift = np.repeat(start - (ends - length), length)
    shift += np.arange(total)
    return pool[shift]


class HashIndex:
    """An open-addressing map from 64-bit fingerprints to small integers, filled and read with
    arrays.  It forgets everything when it would hold more than `most` entries."""

    def __init__(self, bits: int = 16):
        self._size(bits)

    def _size(self, bits: int) -> None:
        self.bits, self.mask = bits, U64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.values = np.zeros(1 << bits, dtype=np.int32)
        self.used = 0

    def get(self, h: np.ndarray) -> np.ndarray:
        h = np.where(h == 0, U64(1), h)
        out = np.full(len(h), -1, dtype=np.int32)
        slot = (h & self.mask).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def put(self, h: np.ndarray, value: np.ndarray) -> None:
        """h: distinct fingerprints, none of them here yet."""
        h = np.where(h == 0, U64(1), h)
        if 2 * (self.used + len(h)) > len(self.keys):
            old_k, old_v = self.keys[self.keys != 0], self.values[self.keys != 0]
            bits = self.bits
            while 2 * (len(old_k) + len(h)) > (1 << bits):
                bits += 1
            self._size(bits + 1)
            if len(old_k):
                self.put(old_k, old_v)
        self.used += len(h)
        left = np.arange(len(h))
        slot = (h & self.mask).astype(np.int64)
        while len(left):
            free = self.keys[slot[left]] == 0
            at = left[free]
            self.keys[slot[at]] = h[at]
            won = at[self.keys[slot[at]] == h[at]]
            self.values[slot[won]] = value[won]
            done = np.zeros(len(h), dtype=bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & int(self.mask)


class WordCache:
    """Per-word results (ragged arrays) kept by fingerprint over the batches of a task.

    `make(indices)` gives the results for words that are new, as a list of sequences.  The cache
    starts anew when it would exceed `most` words, so its memory is bounded."""

    def __init__(self, dtype, most: int = 1_000_000):
        self.dtype, self.most = dtype, most
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, self.dtype)
        self.n = self.filled = 0

    def _add(self, made: list) -> None:
        lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        values = np.concatenate([np.asarray(x, dtype=self.dtype) for x in made]) if lengths.sum() else self.pool[:0]
        while self.n + len(made) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start * 0]), np.concatenate([self.length, self.length * 0])
        while self.filled + len(values) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool * 0])
        ends = np.cumsum(lengths)
        self.start[self.n : self.n + len(made)] = self.filled + ends - lengths
        self.length[self.n : self.n + len(made)] = lengths
        self.pool[self.filled : self.filled + len(values)] = values
        self.n += len(made)
        self.filled += len(values)

    def rows(self, h: np.ndarray, make) -> np.ndarray:
        """The row of each word; new words are made by make(positions in h)."""
        found = self.index.get(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            if self.n and self.n + len(keys) > self.most:
                self._clear()
                return self.rows(h, make)
            row = np.arange(self.n, self.n + len(keys), dtype=np.int32)
            self._add(make(new[first]))
            self.index.put(keys, row)
            found[new] = self.index.get(h[new])
        return found

    def ragged(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values end to end, length per word)"""
        length = self.length[rows].astype(np.int64)
        return gather(self.pool, self.start[rows], length), length


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive entries of first."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
