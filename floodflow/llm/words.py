"""Texts in blocks of words with exact word numbers.

A block joins texts of a few megabytes (one longer text is a block alone). Its
words are cut and numbered with array operations; equal numbers mean equal bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 22
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def byte_class(chars: bytes) -> np.ndarray:
    """Which byte values are among ``chars``."""
    found = np.zeros(256, bool)
    found[np.frombuffer(chars, np.uint8)] = True
    return found


SPACE = byte_class(b" \t\n\x0b\x0c\r")


class Words:
    """Words of joined texts: runs of bytes that are not breaks.

    ``start`` and ``end`` are byte offsets in ``data``, ``text`` the index of each
    word's text, ``code`` its number in ``vocabulary`` (an Arrow array).
    """

    def __init__(self, texts: Sequence[bytes], breaks: np.ndarray = SPACE):
        joint = next(bytes([b]) for b in np.flatnonzero(breaks))
        self.data = np.frombuffer(joint.join([*texts, b""]), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        inside = ~breaks[self.data]
        edge = np.diff(np.r_[np.int8(0), inside.view(np.int8), np.int8(0)])
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        size = self.end - self.start
        self.text = np.searchsorted(np.cumsum(sizes + 1), self.start, side="right")
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        letters = pa.py_buffer(self.data[inside])
        coded = pa.Array.from_buffers(pa.large_binary(), len(size),
                                      [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        self.vocabulary = coded.dictionary
        self.code = coded.indices.to_numpy().astype(np.int64)


def blocks(texts: Sequence[bytes], limit: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            out.append((first, i))
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        out.append((first, len(texts)))
    return out
