"""The binary Golay code [23, 12] as a fuzzy hash.

The code is perfect: every 23-bit word lies within three bits of exactly one codeword.
``keys(x)`` are the codewords to which x or one of its 23 neighbours decodes (one to
six of them), so two words at distance 1 share a key with the other's own codeword, and
two words at distance 2 share a key (that of a word between them).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, GENERATOR = 23, 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


@lru_cache(maxsize=1)
def decode_table() -> np.ndarray:
    """Index (0..4095) of the codeword nearest to every 23-bit word."""
    data = np.arange(4096, dtype=np.int64)
    rest = data << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    code = data << 11 | rest
    table = np.empty(1 << BITS, np.uint16)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            table[code ^ sum(1 << p for p in places)] = data
    return table


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6) codeword indices and a mask of those that count."""
    table = decode_table()
    around = np.empty((len(words), BITS + 1), np.uint16)
    around[:, 0] = table[words]
    for bit in range(BITS):
        around[:, bit + 1] = table[words ^ (1 << bit)]
    around.sort(axis=1)
    new = np.ones(around.shape, bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    out, mask = np.zeros((len(words), 6), np.int64), np.zeros((len(words), 6), bool)
    rank = np.cumsum(new, axis=1) - 1
    row, col = np.nonzero(new)
    out[row, rank[row, col]] = around[row, col]
    mask[row, rank[row, col]] = True
    return out, mask
