"""Elias-Fano coded monotone sequences in memory-mapped files, queried in batches.

A sequence of n values below ``universe`` keeps the low bits of each value packed, and the
high bits in unary: one set bit per value, one clear bit after each high part.  Every
other set bit (for ``get``) or clear bit (for ``successor``) has its position sampled, as a
small offset from that of its block, so a whole batch of queries needs a few array
operations.  A sequence keeps the samples of the queries it is made for.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs

_STEP, _BLOCK = 1, 7
_1, _6, _63 = np.uint64(1), np.uint64(6), np.uint64(63)


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with two spare words."""
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(-(-len(packed) // 8) + 2, np.uint64)
    out.view(np.uint8)[: len(packed)] = packed
    return out


def _sample(bits: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Positions of every other set bit: those of blocks, and offsets from them."""
    at = np.flatnonzero(bits)[:: 1 << _STEP]
    first = at[:: 1 << (_BLOCK - _STEP)]
    offset = at - np.repeat(first, 1 << (_BLOCK - _STEP))[: len(at)]
    return {f"{name}_at": first.astype(np.int64), name: offset.astype(np.uint16 if int(offset.max(initial=0)) < 1 << 16 else np.int64)}


def encode(values: np.ndarray, universe: int, for_get: bool = True, for_successor: bool = True) -> dict[str, np.ndarray]:
    """Arrays of the code of sorted unsigned ``values``, all below ``universe``."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    ones = np.zeros(n + (max(1, universe) >> width) + 2, bool)
    ones[high + np.arange(n)] = True
    low = np.zeros(2, np.uint64)
    if width:
        parts, shifts = [], np.arange(width, dtype=np.uint64)
        for k in range(0, n, 1 << 16):  # 2^16 values fill whole words
            bits = (values[k : k + (1 << 16), None] >> shifts & _1).astype(bool).ravel()
            parts.append(_pack_bits(bits)[:-2])
        low = np.concatenate([*parts, low])
    return {
        "meta": np.array([n, width], np.int64),
        "low": low,
        "high": _pack_bits(ones),
        **(_sample(ones, "ones") if for_get else {}),
        **(_sample(~ones, "zeros") if for_successor else {}),
    }


def _place(word: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Position of the lowest set bit of ``w`` in its word."""
    return (word << 6) + np.bitwise_count(~w & (w - _1))


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.width = (int(x) for x in arrays["meta"])
        self.low, self.high = arrays["low"], arrays["high"]
        self.ones, self.zeros = ((arrays[f"{k}_at"], arrays[k]) if k in arrays else None for k in ("ones", "zeros"))
        self.mask = np.uint64((1 << self.width) - 1)

    def _ahead(self, word: np.ndarray, w: np.ndarray, ones: bool) -> None:
        """Move on from used-up words, in place, to the next one with a set (or clear) bit."""
        go = np.flatnonzero(w == 0)
        while len(go):
            word[go] += 1
            w[go] = self.high[word[go]] if ones else ~self.high[word[go]]
            go = go[w[go] == 0]

    def _find(self, k: np.ndarray, ones: bool) -> tuple[np.ndarray, np.ndarray]:
        """Word of the k-th set (or clear) bit, and what is left of it from that bit on."""
        first, offset = self.ones if ones else self.zeros
        at = first[k >> _BLOCK] + offset[k >> _STEP]
        word = at >> 6
        w = self.high[word] if ones else ~self.high[word]
        w &= ~np.uint64(0) << (at.astype(np.uint64) & _63)
        left = k & ((1 << _STEP) - 1)
        for t in range((1 << _STEP) - 1):
            w &= w - (left > t)
            self._ahead(word, w, ones)
        return word, w

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th set (or clear) bit."""
        return _place(*self._find(k, ones))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> _6).astype(np.int64), bit & _63
        return (self.low[word] >> off | self.low[word + 1] << (_63 - off) << _1) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        i = np.asarray(i, np.int64)
        return (self._select(i, True) - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def get_pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions ``i`` and ``i + 1``, which is cheaper than two queries."""
        i = np.asarray(i, np.int64)
        word, w = self._find(i, True)
        first = _place(word, w)
        w &= w - _1
        self._ahead(word, w, True)
        high = first - i, _place(word, w) - i - 1
        return tuple(h.astype(np.uint64) << np.uint64(self.width) | self._low(i + k) for k, h in enumerate(high))

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value that is not below each ``x``, and whether it equals ``x``."""
        x = np.asarray(x, np.uint64)
        h = (x >> np.uint64(self.width)).astype(np.int64)
        at = self._select(np.maximum(h - 1, 0), False) + 1
        at[h == 0] = 0
        lo = at - h
        # The run of set bits from there on is the bucket; a long one ends at the next clear bit.
        word, off = at >> 6, at.astype(np.uint64) & _63
        w = self.high[word] >> off | self.high[word + 1] << (_63 - off) << _1
        run = np.bitwise_count(w & ~(w + _1)).astype(np.int64)
        full = np.flatnonzero(w == ~np.uint64(0))
        run[full] = self._select(h[full], False) - at[full]
        same = np.zeros(len(x), bool)
        # Binary search in the buckets that are not empty; ``met`` is the value at ``b``, once one is known to be there.
        go = np.flatnonzero(run)
        a, want = lo[go], x[go] & self.mask
        b, met = a + run[go], ~want
        while len(go):
            mid = (a + b) >> 1
            low = self._low(mid)
            below = low < want
            a, b, met = np.where(below, mid + 1, a), np.where(below, b, mid), np.where(below, met, low)
            more = a < b
            done = np.flatnonzero(~more)
            lo[go[done]], same[go[done]] = a[done], met[done] == want[done]
            more = np.flatnonzero(more)
            go, a, b, met, want = go[more], a[more], b[more], met[more], want[more]
        return lo, same


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named one-dimensional arrays to one file, each aligned to 64 bytes."""
    meta, at = {}, 0
    for name, a in arrays.items():
        meta[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(meta).encode()
    head += b" " * (-(len(head) + 8) % 64)
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_output_stream(path, compression=None) as f:
        f.write(struct.pack("<q", len(head)) + head)
        for a in arrays.values():
            f.write(memoryview(np.ascontiguousarray(a)).cast("B") if a.nbytes else b"")
            f.write(b"\0" * (-a.nbytes % 64))


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, else read."""
    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with where.open_input_file(path) as f:
            raw = np.frombuffer(f.read_buffer() if hasattr(f, "read_buffer") else pa.py_buffer(f.read()), np.uint8)
    (size,) = struct.unpack("<q", raw[:8].tobytes())
    meta = json.loads(raw[8 : 8 + size].tobytes())
    return {k: np.asarray(raw[8 + size + at : 8 + size + at + n * np.dtype(t).itemsize].view(t)) for k, (t, n, at) in meta.items()}


def nested(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def pick(prefix: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k.removeprefix(prefix + "."): v for k, v in arrays.items() if k.startswith(prefix + ".")})
