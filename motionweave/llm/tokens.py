"""Words of many documents at once, as numpy arrays over an Arrow text buffer.

A word is a run of bytes other than space and 0x09-0x0D.  Nothing is turned into
Python strings: words are (start, end) positions, and 64-bit hashes read eight bytes
at a time.  Hash collisions are those of a well-mixed 64-bit value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_29, _32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray, v: np.ndarray | np.uint64 | int = 0) -> np.ndarray:
    """Fold ``v`` into 64-bit hashes ``h``."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(v) if isinstance(v, int) else h ^ v) * _A
        h ^= h >> _32
        h *= _B
        h ^= h >> _29
        h *= _C
        h ^= h >> _32
    return h


class Words:
    """All words of a column of texts (null: none), in order; ``doc`` is each word's row."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        col = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        size = int(ends[-1] - ends[0])
        raw = np.frombuffer(col.buffers()[2], np.uint8, size, int(ends[0])) if size else np.zeros(0, np.uint8)
        self.data = np.zeros(size + 8, np.uint8)
        self.data[:size] = LOWER[raw] if lower else raw
        self.size, self.offsets, self.rows = size, ends - ends[0], len(col)
        self.space = SPACE[self.data[:size]]
        edge = np.ones(size + 1, bool)  # a word may start here: after white space or where a text starts
        edge[1:size] = self.space[:-1] if size else False
        edge[self.offsets] = True
        word = ~self.space
        self.starts = np.flatnonzero(word & edge[:size])
        self.ends = np.flatnonzero(word & np.append(self.space[1:], True) | word & edge_after(self.offsets, size)) + 1
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))
        self.doc = np.repeat(np.arange(self.rows), self.counts)
        #: Position of each document's first word, and the end.
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        eight = np.ndarray((self.size + 1,), "<u8", self.data.data, 0, (1,))
        length = self.ends - self.starts
        with np.errstate(over="ignore"):
            h = mix(eight[self.starts] & _MASK[np.minimum(length, 8)], length.astype(np.uint64) * _C)
        at, long = 8, np.flatnonzero(length > 8)
        while len(long):
            h[long] = mix(h[long], eight[self.starts[long] + at] & _MASK[np.minimum(length[long] - at, 8)])
            at += 8
            long = long[length[long] > at]
        return h

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``n`` words within a document, and the position of its first word."""
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = mix(h[: len(h) - n + 1], 5)  # mixed first, so that the order of words counts
        for k in range(1, n):
            out = mix(out, h[k : len(h) - n + 1 + k])
        same = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        return out[same], same

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def edge_after(offsets: np.ndarray, size: int) -> np.ndarray:
    """Marks the last byte of every text."""
    last = np.zeros(size, bool)
    at = offsets[1:] - 1
    last[at[at >= 0]] = True
    return last
