"""Words, shingles and their hashes for whole batches of texts, as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return;
A-Z count as a-z. A batch of texts is one byte buffer with offsets, as Arrow stores it, so no loop runs
over words. Hashes are 64 bits: a polynomial over random byte values, then a mixing permutation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about this many bytes, which bounds the arrays in memory.
RUN_BYTES = 4 << 20
#: The same where nothing is shared between texts; the arrays held meanwhile are about 50 times this size.
SHORT_RUN_BYTES = 256 << 10

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(32))


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: a random value (that of a-z for A-Z), and whether it separates words."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return values, space


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> list[tuple[int, int]]:
    """Consecutive texts in groups of about ``size`` bytes (a longer text is a group of its own)."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


class WordHashes:
    """Hashes of the words of runs of texts."""

    def __init__(self) -> None:
        self.values, self.space = byte_tables()
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, for each text the place of its first word; the end comes last)."""
        data = data[offsets[0] : offsets[-1]]
        cuts = offsets - offsets[0]
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        if n > len(self.up):
            self.up, self.down = powers(_MULTIPLIER, n), powers(_INVERSE, n)
        inside = ~self.space[data]
        fresh = np.zeros(n + 1, bool)  # a text begins here
        fresh[cuts] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | fresh[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | fresh[1:n]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        sums = np.cumsum(self.values[data] * self.up[:n], dtype=np.uint64)
        before = np.where(first > 0, sums[np.maximum(first - 1, 0)], np.uint64(0))
        hashes = mixed((sums[last] - before) * self.down[first] + (last - first).astype(np.uint64))
        return hashes, np.searchsorted(first, cuts)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of ``size`` words; of the whole sequence if shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(_MULTIPLIER) + words[k : k + n]
    return np.unique(mixed(out))


def shingle_sets(texts: pa.Array, size: int):
    """The shingle set of each text, in order."""
    data, offsets = text_bytes(texts)
    hashes = WordHashes()
    for first, last in runs(offsets, SHORT_RUN_BYTES):
        words, at = hashes(data, offsets[first : last + 1])
        for k in range(last - first):
            yield shingles(words[at[k] : at[k + 1]], size)
