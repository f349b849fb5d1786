"""Vectorised hashing of UTF-8 texts in blocks of bounded size.

A block joins texts until ``BLOCK_BYTES`` is reached (one longer text forms a
block alone) and keeps a prefix sum of ``T[byte] * BASE**i`` modulo 2**64, from
which the hash of any byte range follows with one multiplication, since the
odd base has an inverse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

BLOCK_BYTES = 1 << 20
PLAIN_BYTES = 256
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that low and high bits are usable."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        step = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 8 * BLOCK_BYTES:  # keep no arrays sized for one huge text
            _POWERS[kind] = have
    return have[:n]


class Block:
    """Joined texts; ``starts`` and ``ends`` are byte offsets of each text."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        n = len(self.data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[self.data] * _powers("up", n), out=self.sums[1:])
        self.inverse = _powers("down", n + 1)

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..end, equal for equal bytes anywhere."""
        h = mix((self.sums[end] - self.sums[start]) * self.inverse[start])
        for i in np.flatnonzero(end - start > PLAIN_BYTES).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i]:end[i]], digest_size=8).digest(), "little")
        return h

    def gram_hash(self, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from every position."""
        n = len(self.data) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def batches(texts: Sequence[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every run of non-space bytes."""
    n = len(block.data)
    inside = ~_SPACE[block.data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = block.starts[(block.starts < n) & (block.ends > block.starts)]
    before[cut] = False  # a word ends where its text ends
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[block.ends[block.ends > block.starts] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(block.ends, start, side="right")
