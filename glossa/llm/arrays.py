"""Words, word hashes and word n-grams of many texts at once, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text (the same runs as of code points).
Hashes are 64-bit and the same on every machine. Memory is about 50 bytes per byte of one slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (two multiply-xorshift steps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one per word, texts one after another
    counts: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word; one entry more than texts

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.hashes))


def words(texts: list[bytes]) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_SEP[buf]
    edge = np.flatnonzero(np.diff(solid, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    first = np.searchsorted(starts, at)
    counts = np.diff(first)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), counts, first)
    lengths = ends - starts
    inner = np.cumsum(lengths) - lengths
    offset = np.arange(int(lengths.sum())) - np.repeat(inner, lengths)
    powers = _powers(1 << max(10, int(lengths.max()).bit_length()))
    return Words(mix(np.add.reduceat(_TABLE[buf[solid]] * powers[offset], inner)), counts, first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries; len(hashes) - n + 1 of them (none if that is not positive)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, have, block, width, power = None, 0, hashes, 1, _ODD  # block: hashes of every `width` entries
    while True:
        if n & width:
            out = block[:size].copy() if out is None else out * power + block[have : have + size]
            have += width
        if n < 2 * width:
            return mix(out)
        block = block[:-width] * power + block[width:]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes sum to at most `most` (a larger one stands alone)."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield start, len(sizes)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's values as bytes; null as the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
