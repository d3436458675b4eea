"""Numpy kernels for what the relational operators cannot express."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa


def butterworth(cutoff: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of the second-order low-pass, by the bilinear transform."""
    k = math.tan(math.pi * cutoff / fs)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return np.array([k * k * n, 2 * k * k * n, k * k * n]), np.array([1.0, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n])


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Columns of ``x`` through the filter, one step for all of them at a time."""
    out, (s, t) = np.empty_like(x), state
    for i, v in enumerate(x):
        y = b[0] * v + s
        s, t = b[1] * v - a[1] * y + t, b[2] * v - a[2] * y
        out[i] = y
    return out


def filtfilt(x: np.ndarray, cutoff: float, fs: float, pad: int = 9) -> np.ndarray:
    """Forward and backward filtering with odd extension and steady initial state, of every column.

    Signals of up to ``pad`` samples are too short for the extension and come back unchanged;
    so do columns with missing values.
    """
    whole = x if x.ndim == 2 else x[:, None]
    out, good = whole.astype(float).copy(), ~np.isnan(whole).any(0)
    if len(whole) > pad and good.any():
        b, a = butterworth(cutoff, fs)
        # State of a constant input of one.
        t = b[2] - a[2]
        s = b[1] - a[1] + t
        v = out[:, good]
        ext = np.concatenate([2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]])
        for _ in range(2):
            ext = _filter(b, a, ext, np.stack([s * ext[0], t * ext[0]]))[::-1]
        out[:, good] = ext[pad:-pad]
    return out if x.ndim == 2 else out[:, 0]


def resample_lists(lists: pa.ListArray, points: int) -> np.ndarray:
    """Every list linearly resampled to ``points`` values, one after another; missing values are NaN."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(float)
    first, last = offsets[:-1, None], np.diff(offsets)[:, None] - 1
    t = np.arange(points, dtype=float) * last / max(points - 1, 1)
    low = np.floor(t).astype(np.int64)
    a, b = values[first + low], values[first + np.minimum(low + 1, last)]
    return (a + (b - a) * (t - low)).ravel()


#: Samples that the ends of a signal are extended by before filtering.
PAD = 9
#: Samples of a piece of a long signal.
PIECE = 256


def extended(v: np.ndarray, first: bool = True, last: bool = True, pad: int = PAD) -> np.ndarray:
    """A signal, or a block of one, with its odd extension at the ends that it has."""
    head = 2 * v[0] - v[pad:0:-1] if first else v[:0]
    tail = 2 * v[-1] - v[-2 : -pad - 2 : -1] if last else v[:0]
    return np.concatenate([head, v, tail])


class LowPass:
    """Second-order Butterworth low-pass of many signals at once, each entered in a state of its own.

    With no input the state moves by the matrix ``step``; what a block adds to it does not depend
    on the state before, so the states between blocks come from the blocks' own ends.
    """

    def __init__(self, cutoff: float, fs: float) -> None:
        self.b, self.a = butterworth(cutoff, fs)
        self.step = np.array([[-self.a[1], 1.0], [-self.a[2], 0.0]])
        second = self.b[2] - self.a[2]
        #: State of a constant input of one.
        self.steady = np.array([self.b[1] - self.a[1] + second, second])
        #: Samples over which a state decays by more than the range of a double: by 2 ** -1100, times a small polynomial.
        self.memory = math.ceil(1100 * math.log(2) / (-math.log(self.a[2]) / 2))

    def __call__(self, signals: list[np.ndarray], states: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Filtered signals and their last states; ``states`` has a row for each signal."""
        size = np.array([len(v) for v in signals])
        order = np.argsort(-size, kind="stable")
        x = np.zeros((int(size.max(initial=0)), len(signals)))
        for lane, k in enumerate(order):
            x[: size[k], lane] = signals[k]
        active = np.searchsorted(-size[order], -np.arange(len(x)), side="left")
        s, t = states[order].T.copy()
        (b0, b1, b2), (_, a1, a2) = self.b, self.a
        for row, m in zip(x, active):
            v = row[:m].copy()
            y = row[:m] = b0 * v + s[:m]
            s[:m] = b1 * v - a1 * y + t[:m]
            t[:m] = b2 * v - a2 * y
        out, last = [np.empty(0)] * len(signals), np.empty_like(states)
        for lane, k in enumerate(order):
            out[k] = x[: size[k], lane]
        last[order] = np.stack([s, t], 1)
        return out, last

    def both_ways(self, signals: list[np.ndarray]) -> list[np.ndarray]:
        """Whole signals forward and backward; short or incomplete ones stay as they are."""
        good = [k for k, v in enumerate(signals) if len(v) > PAD and not np.isnan(v).any()]
        out, turned = list(signals), [extended(signals[k]) for k in good]
        for _ in range(2 if good else 0):
            turned = [v[::-1] for v in self(turned, np.stack([self.steady * v[0] for v in turned]))[0]]
        for k, v in zip(good, turned):
            out[k] = v[PAD:-PAD]
        return out

    def long(self, v: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long signal and its last state: pieces side by side, each entered in the state that those before leave."""
        pieces = np.split(v, np.arange(PIECE, len(v), PIECE))
        entry = np.zeros((len(pieces), 2))
        _, added = self(pieces, entry)
        step = np.linalg.matrix_power(self.step, PIECE)
        entry[0] = state
        for k in range(1, len(pieces)):
            entry[k] = step @ entry[k - 1] + added[k - 1]
        done, last = self(pieces, entry)
        return np.concatenate(done), last[-1]


class Stream:
    """Zero-phase filter of one signal that arrives in parts.

    The state forward is carried on.  A sample is settled once ``memory`` later ones are there:
    the filter backward has forgotten all beyond those, so it can start there.
    """

    def __init__(self, f: LowPass) -> None:
        self.f, self.raw, self.state, self.pending = f, np.empty(0), None, np.empty(0)

    def push(self, v: np.ndarray) -> np.ndarray:
        """The samples that are settled now, in order."""
        if self.state is None:
            v = np.concatenate([self.raw, v])
            if len(v) <= PAD:
                self.raw = v
                return v[:0]
            head = extended(v[: PAD + 1], True, False)[:PAD]
            _, state = self.f([head], np.stack([self.f.steady * head[0]]))
            self.state = state[0]
        if len(v):
            self.raw = np.concatenate([self.raw, v])[-PAD - 1 :] if len(v) <= PAD else v[-PAD - 1 :]
            done, self.state = self.f.long(v, self.state)
            self.pending = np.concatenate([self.pending, done])
        return self._back(len(self.pending) - self.f.memory) if len(self.pending) > 2 * self.f.memory else v[:0]

    def finish(self) -> np.ndarray:
        """The rest; a signal that is too short for the extension comes back unchanged."""
        if self.state is None:
            return self.raw
        tail = extended(self.raw, False, True)[len(self.raw) :]
        n = len(self.pending)
        self.pending = np.concatenate([self.pending, self.f([tail], np.stack([self.state]))[0][0]])
        return self._back(n)

    def _back(self, n: int) -> np.ndarray:
        y = self.pending[::-1]
        done = self.f.long(y, self.f.steady * y[0])[0][::-1][:n]
        self.pending = self.pending[n:]
        return done


#: Numbers that the kernels over pairs of channels hold at once.
BLOCK_CELLS = 4_000_000


def cross_correlations(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lag, r) of the largest absolute normalised cross-correlation of every pair of columns; the first lag on a tie.

    Every column is transformed once; pairs are products of spectra, turned back in blocks.  The
    lag is the frame of ``i`` less the frame of ``j``.  Constant or incomplete signals give (0, NaN).
    """
    n = len(m)
    m = m - m.mean(0)
    power = (m * m).sum(0)
    norm = np.sqrt(power[i] * power[j])
    size = 1 << max(0, 2 * n - 2).bit_length()
    spectra = np.fft.rfft(m, size, axis=0).T
    lag, r = np.zeros(len(i), np.int64), np.full(len(i), np.nan)
    good = np.flatnonzero(norm > 0)
    step = max(1, BLOCK_CELLS // size)
    for at in range(0, len(good), step):
        own = good[at : at + step]
        full = np.fft.irfft(spectra[i[own]] * spectra[j[own]].conj(), size, axis=1)
        full = np.concatenate([full[:, size - n + 1 :], full[:, :n]], axis=1) / norm[own, None]
        best = np.abs(full).round(9).argmax(1)
        lag[own], r[own] = best - (n - 1), full[np.arange(len(own)), best]
    return lag, r


def distance_products(m: np.ndarray) -> np.ndarray:
    """Squared distance covariances of all pairs of columns, by one product of the centred distances in blocks of rows."""
    n, k = m.shape
    step = max(1, BLOCK_CELLS // (n * k))
    blocks = [slice(at, at + step) for at in range(0, n, step)]
    rows = np.concatenate([np.abs(m[b, None] - m[None]).mean(1) for b in blocks])
    gram = np.zeros((k, k))
    for b in blocks:
        d = (np.abs(m[b, None] - m[None]) - rows[b, None] - rows[None] + rows.mean(0)).reshape(-1, k)
        gram += d.T @ d
    return gram / n**2


def distance_row_means(x: np.ndarray) -> np.ndarray:
    """Mean distance of every value to all, by prefix sums over the sorted values."""
    order, n = np.argsort(x, kind="stable"), len(x)
    y = x[order]
    before = np.cumsum(y) - y
    out = np.empty(n)
    out[order] = (y * (2 * np.arange(n) - n) + y.sum() - 2 * before) / n
    return out


def distance_product_sum(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of |x_a - x_b| |y_a - y_b| over all pairs, in n log n.

    For b before a by x, the product is (x_a - x_b)(y_a - y_b) if y_b is not above y_a, else its
    negative, so sums of 1, x, y and xy over the b below give it.  They are gathered bit by bit of
    the rank by x: values lie in order of y within runs of equal higher bits, and an a with the
    bit takes the prefix sums of the b without it.  A stable partition makes the next bit's runs.
    """
    n = len(x)
    rank = np.empty(n, np.int64)
    rank[np.argsort(x, kind="stable")] = np.arange(n)
    at = np.argsort(y, kind="stable")
    below = np.zeros((4, n))
    terms = np.stack([np.ones(n), x, y, x * y])
    for bit in reversed(range(max(1, (n - 1).bit_length()))):
        run, high = rank[at] >> (bit + 1), (rank[at] >> bit) & 1 == 1
        sums = np.cumsum(np.where(high, 0.0, terms[:, at]), axis=1)
        first = np.flatnonzero(np.diff(run, prepend=-1))
        start = np.repeat(first, np.diff(first, append=n))
        base = np.where(start > 0, sums[:, start - 1], 0.0)
        below[:, at[high]] += (sums - base)[:, high]
        # Within every run the values without the bit come first, both in order of y.
        low = np.cumsum(~high)
        lows = low - np.where(start > 0, low[start - 1], 0)
        total = np.repeat(lows[np.append(first[1:], n) - 1], np.diff(first, append=n))
        place = start + np.where(high, total + np.arange(n) - start - lows, lows - 1)
        moved = np.empty(n, np.int64)
        moved[place] = at
        at = moved
    order = np.argsort(x, kind="stable")
    all_before = np.empty((4, n))
    all_before[:, order] = np.cumsum(terms[:, order], axis=1) - terms[:, order]
    c, sx, sy, sxy = 2 * below - all_before
    return 2 * float((x * y * c - y * sx - x * sy + sxy).sum())


def distance_covariances(m: np.ndarray) -> np.ndarray:
    """Squared distance covariances (V-statistics) of all pairs of columns, in n log n each."""
    n, k = m.shape
    m = m - m[0]  # so that constant columns are zero
    m -= m.mean(0)
    rows = np.stack([distance_row_means(m[:, c]) for c in range(k)])
    out = np.empty((k, k))
    for a in range(k):
        for b in range(a, k):
            total = 2 * n * (m[:, a] ** 2).sum() if a == b else distance_product_sum(m[:, a], m[:, b])
            out[a, b] = out[b, a] = total / n**2 + rows[a].mean() * rows[b].mean() - 2 * (rows[a] * rows[b]).mean()
    return out


def digest_ranking(seed: str, iteration: int, items: list) -> list[int]:
    """Order of ``items`` by the md5 of (seed, iteration, item), as the relational tables have it."""
    return sorted(range(len(items)), key=lambda k: (hashlib.md5(f"{seed}:{iteration}:{items[k]}".encode()).hexdigest(), items[k]))


def permutations(seed: str, iterations: range, blocks: list[int]) -> np.ndarray:
    """(iterations x nodes) new label of every node; labels move within their block only."""
    members: dict[int, list[int]] = {}
    for node, block in enumerate(blocks):
        members.setdefault(block, []).append(node)
    out = np.empty((len(iterations), len(blocks)), np.int64)
    for row, k in enumerate(iterations):
        for nodes in members.values():
            out[row, nodes] = [nodes[q] for q in digest_ranking(seed, k, nodes)]
    return out


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of every row, ties at their mean."""
    x = np.atleast_2d(x)
    order = np.argsort(x, axis=1, kind="stable")
    y, n = np.take_along_axis(x, order, 1), x.shape[1]
    new = np.ones(y.shape, bool)
    new[:, 1:] = y[:, 1:] != y[:, :-1]
    at = np.arange(n)[None, :]
    first = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    stop = np.ones(y.shape, bool)
    stop[:, :-1] = new[:, 1:]
    last = np.minimum.accumulate(np.where(stop, at, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, 1)
    return out


def spearman_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank correlation of every row of x and y over the cells that both have; NaN where one side is constant."""
    x, y = np.broadcast_arrays(np.atleast_2d(x), np.atleast_2d(y))
    gap = np.isnan(x) | np.isnan(y)
    out = np.full(len(x), np.nan)
    for rows in (np.flatnonzero(~gap.any(1)), *([k] for k in np.flatnonzero(gap.any(1)))):
        if not len(rows):
            continue
        keep = ~gap[rows[0]]
        a, b = average_ranks(x[rows][:, keep]), average_ranks(y[rows][:, keep])
        if not a.shape[1]:
            continue
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        out[rows] = np.divide((a * b).sum(1), norm, out=np.full(len(a), np.nan), where=norm > 0)
    return out


def centred_distances(x: np.ndarray) -> np.ndarray:
    d = np.abs(x[:, None] - x[None, :])
    return d - d.mean(0) - d.mean(1)[:, None] + d.mean()


def distance_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """V-statistic distance correlation from centred distance matrices; 0 if either is constant."""
    aa, bb = (a * a).mean(), (b * b).mean()
    if aa * bb <= 0:
        return 0.0
    return math.sqrt(max(0.0, (a * b).mean()) / math.sqrt(aa * bb))


def louvain(w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Communities of a weighted undirected graph (diagonal: self-loops) by greedy modularity."""
    n = len(w)
    member, graph = np.arange(n), w.copy().astype(float)
    while True:
        size = len(graph)
        label, loops = np.arange(size), np.diag(graph).copy()
        degree = graph.sum(1) + loops
        total = degree.sum()
        if total <= 0:
            return member
        mass, improved = degree.copy(), False
        while True:
            moved = False
            for v in rng.permutation(size):
                old = label[v]
                mass[old] -= degree[v]
                to = np.bincount(label, graph[v], size)
                to[old] -= graph[v, v]
                gain = to - degree[v] * mass / total
                best = int(gain.argmax())
                if gain[best] <= gain[old] + 1e-12:
                    best = old
                label[v] = best
                mass[best] += degree[v]
                moved |= best != old
            improved |= moved
            if not moved:
                break
        _, label = np.unique(label, return_inverse=True)
        member = label[member]
        if not improved:
            return member
        k = label.max() + 1
        merged = np.zeros((k, k))
        np.add.at(merged, (label[:, None].repeat(size, 1), label[None, :].repeat(size, 0)), graph)
        # Inner edges were seen from both ends; self-loops count once.
        inner = np.bincount(label, loops, k)
        merged[np.diag_indices(k)] = (merged.diagonal() - inner) / 2 + inner
        graph = merged
