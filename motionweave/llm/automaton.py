"""Parallel scan of texts by a finite automaton, through its transition monoid.

A chunk does not know the state it is entered in, so it gives the whole function from entry
state to exit state, and for each entry state how many tokens begin in it.  Functions compose
associatively, so blocks, chunks and giant texts are put together in any grouping.  The
functions that strings can cause are few: they are numbered once (``maps``), and a scan moves
one number a block from byte to byte, with the counts of all entry states packed in one word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that a lane scans; its counts must fit ``_WIDTH`` bits for each state.
BLOCK, _WIDTH = 256, 10


class Automaton:
    """``step[state, class]`` is the next state, ``emit[state, class]`` is 1 where a token begins.

    ``classes`` gives each byte's class.  The last class is padding: it must change no state and begin no token.
    """

    def __init__(self, classes: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        states, kinds = step.shape
        if states * _WIDTH > 64 or (step[:, -1] != np.arange(states)).any() or emit[:, -1].any():
            raise ValueError("too many states, or the last class is not padding")
        self.classes, self.step, self.emit, self.states = classes, step, emit, states
        maps, number = [tuple(range(states))], {tuple(range(states)): 0}
        after = []
        for f in maps:  # grows while it is read
            row = []
            for c in range(kinds):
                g = tuple(int(step[s, c]) for s in f)
                if g not in number:
                    number[g] = len(maps)
                    maps.append(g)
                row.append(number[g])
            after.append(row)
        self.maps = np.array(maps, np.int64)
        self._next = np.array(after, np.int64).ravel() * kinds
        shift = (_WIDTH * np.arange(states)).astype(np.uint64)
        self._packed = (emit[self.maps].transpose(0, 2, 1).astype(np.uint64) << shift).sum(2).astype(np.uint64).ravel()
        #: Number of "first f, then g".
        self.compose = np.array([[number[tuple(int(g[s]) for s in f)] for g in maps] for f in maps], np.int64)


@dataclass
class Scan:
    """Blocks of several texts: ``first`` block of each text (and the end), their classes, functions and counts."""

    first: np.ndarray
    lengths: np.ndarray
    lanes: np.ndarray  # position in the block x block
    entered: np.ndarray  # function from the text's start to the block
    counts: np.ndarray  # block x entry state of the block
    function: np.ndarray  # of whole texts


def scan(m: Automaton, data: np.ndarray, offsets: np.ndarray) -> Scan:
    """Scan texts that lie in ``data`` from ``offsets[k]`` to ``offsets[k + 1]``."""
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total, kinds = int(first[-1]), m.step.shape[1]
    padded = np.full(total * BLOCK, kinds - 1, np.uint8)
    place = np.arange(int(offsets[-1] - offsets[0])) + np.repeat(first[:-1] * BLOCK - (offsets[:-1] - offsets[0]), lengths)
    padded[place] = m.classes[data[offsets[0] : offsets[-1]]]
    lanes = np.ascontiguousarray(padded.reshape(-1, BLOCK).T)
    at, packed = np.zeros(total, np.int64), np.zeros(total, np.uint64)
    for c in lanes:
        k = at + c
        packed += m._packed[k]
        at = m._next[k]
    f = at // kinds
    counts = (packed[:, None] >> (_WIDTH * np.arange(m.states)).astype(np.uint64)) & np.uint64((1 << _WIDTH) - 1)
    # Functions from each text's start through each block, by doubling.
    text, d = np.repeat(np.arange(len(lengths)), blocks), 1
    while d < (blocks.max() if len(blocks) else 0):
        same = np.flatnonzero(text[d:] == text[:-d])
        f[same + d] = m.compose[f[same], f[same + d]]
        d *= 2
    entered = np.zeros(total, np.int64)
    entered[1:] = np.where(text[1:] == text[:-1], f[:-1], 0)
    function = np.zeros(len(lengths), np.int64)
    function[blocks > 0] = f[first[1:][blocks > 0] - 1]
    return Scan(first, lengths, lanes, entered, counts.astype(np.int64), function)


def counts_from(m: Automaton, s: Scan, start: np.ndarray) -> np.ndarray:
    """Tokens that begin in every block if text k is entered in ``start[k]``."""
    state = m.maps[s.entered, np.repeat(start, np.diff(s.first))]
    return s.counts[np.arange(len(state)), state]


def totals(m: Automaton, s: Scan) -> np.ndarray:
    """Text x entry state: tokens that begin in the text."""
    out = np.zeros((len(s.lengths), m.states), np.int64)
    for k in range(m.states):
        sums = np.concatenate([[0], np.cumsum(counts_from(m, s, np.full(len(s.lengths), k)))])
        out[:, k] = sums[s.first[1:]] - sums[s.first[:-1]]
    return out


def select(m: Automaton, s: Scan, text: np.ndarray, start: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Bytes of ``text`` before its ``token``-th token (from 0); all of them where it has so many only.

    ``start`` is the entry state of every text.  A block's counts find the block; only that block is scanned again.
    """
    sums = np.concatenate([[0], np.cumsum(counts_from(m, s, start))])
    wanted = sums[s.first[text]] + token
    inside = wanted < sums[s.first[text + 1]]
    out = s.lengths[text].copy()
    block = np.searchsorted(sums, wanted[inside], side="right") - 1
    state = m.maps[s.entered[block], start[text[inside]]]
    left = wanted[inside] - sums[block]
    at = np.zeros(len(block), np.int64)
    for pos in range(BLOCK):
        c = s.lanes[pos, block]
        begins = m.emit[state, c] == 1
        at[begins & (left == 0)] = pos
        left -= begins
        state = m.step[state, c]
    out[inside] = (block - s.first[text[inside]]) * BLOCK + at
    return out
