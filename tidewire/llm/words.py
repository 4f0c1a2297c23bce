"""Words, word hashes and word n-grams of many texts at once, over the bytes of an Arrow string column.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``; a null text has
none. Hashes have 64 bits and depend on nothing but the bytes and a seed. A span is hashed eight bytes at a time, each
block mixed before the next one comes in, so that no pattern of bytes cancels out; spans of over LONG bytes by BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Spans of more bytes are hashed one by one.
LONG = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k bytes of a little-endian block


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of data[start[i]:end[i]] for every i; hashes of different seeds are independent of each other."""
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xA0761D64 + 1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block_at = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live, at = np.flatnonzero(size <= LONG), 0
    while len(live):
        left = size[live] - at
        block = block_at[start[live] + at] & _MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ block) * np.uint64(0xE7037ED1A0B428DB))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


@dataclass
class Words:
    """Rows first..last-1 of a batch: their bytes, word bounds, and where each row's words begin."""

    first: int
    last: int
    data: np.ndarray
    text_start: np.ndarray  # a row's bytes are data[text_start[i]:text_start[i + 1]]
    start: np.ndarray
    end: np.ndarray
    row_start: np.ndarray  # a row's words are row_start[i]:row_start[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_start)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), self.counts)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        return span_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end, seed)


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k consecutive entries of h, for every start (len(h) - k + 1, none if negative)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.full(n, np.uint64(salt * 2 + 1), np.uint64)
    for j in range(k):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h[j : j + n]
        g ^= g >> np.uint64(32)
    return mix(g)


def slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[Words]:
    """Cut a string column into slices of about most_bytes (a longer text is a slice of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may span bytes
        lens = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if (lens != np.diff(off)).any():
            yield from slices(column.fill_null(""), most_bytes)
            return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        part = raw[off[i] : off[j]]
        at = off[i : j + 1] - off[i]
        word = ~SPACE[part]
        begin = word.copy()
        stop = word.copy()
        if len(part):
            begin[1:] &= ~word[:-1]
            inner = at[(at > 0) & (at < len(part))]
            begin[inner] = word[inner]
            stop[:-1] &= ~word[1:]
            stop[inner - 1] = word[inner - 1]
        start = np.flatnonzero(begin)
        end = np.flatnonzero(stop) + 1
        yield Words(i, j, part, at, start, end, np.searchsorted(start, at))
        i = j


def gram_starts(words: Words, k: int) -> np.ndarray:
    """Starts (as word numbers of the slice) of the k-grams that lie within one row."""
    n = words.row_start[-1] - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    last = np.repeat(words.row_start[1:], words.counts)[:n]
    return np.flatnonzero(np.arange(n) + k <= last)
