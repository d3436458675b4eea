"""Tail probabilities and test statistics in plain numpy and math."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_less(t: float, df: float) -> float:
    half = t_two_sided(t, df) / 2
    return half if t < 0 else 1 - half


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse normal distribution by Newton steps from a logistic start."""
    x = math.log(p / (1 - p)) / 1.702
    for _ in range(60):
        error = 1 - normal_upper(x) - p
        step = error * math.sqrt(2 * math.pi) * math.exp(min(x * x / 2, 700))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def mean_ranks(x: np.ndarray) -> np.ndarray:
    _, where, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[where]


def t_test(x: np.ndarray, y: np.ndarray, equal_var: bool = True, less: bool = False) -> tuple[float, float]:
    n, m, v, w = len(x), len(y), x.var(ddof=1), y.var(ddof=1)
    if equal_var:
        df = n + m - 2.0
        se = math.sqrt(((n - 1) * v + (m - 1) * w) / df * (1 / n + 1 / m))
    else:
        a, b = v / n, w / m
        se = math.sqrt(a + b)
        df = (a + b) ** 2 / (a * a / (n - 1) + b * b / (m - 1)) if a + b else 1.0
    if se == 0:
        return math.nan, math.nan
    t = (x.mean() - y.mean()) / se
    return t, t_less(t, df) if less else t_two_sided(t, df)


def levene(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Spread test around the medians."""
    a, b = np.abs(x - np.median(x)), np.abs(y - np.median(y))
    n = len(a) + len(b)
    grand = (a.sum() + b.sum()) / n
    between = len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    if within == 0:
        return math.nan, math.nan
    w = (n - 2) * between / within
    return w, f_upper(w, 1, n - 2)


@lru_cache(maxsize=256)
def _u_counts(n: int, m: int) -> tuple[float, ...]:
    """How many orders of n and m values give each U."""
    ways = np.zeros((n + 1, n * m + 1))
    ways[0, 0] = 1
    for top in range(1, n + m + 1):  # ranks taken by the first sample, largest last
        for k in range(min(n, top), 0, -1):
            shift = top - k  # this rank adds top - k to U
            if shift <= m:
                ways[k, shift:] += ways[k - 1, : n * m + 1 - shift]
    return tuple(ways[n])


def mann_whitney(x: np.ndarray, y: np.ndarray, less: bool = False) -> tuple[float, float]:
    """U of the first sample; exact if a side has up to 8 values and none are tied."""
    n, m = len(x), len(y)
    ranks = mean_ranks(np.concatenate([x, y]))
    u = ranks[:n].sum() - n * (n + 1) / 2
    _, ties = np.unique(np.concatenate([x, y]), return_counts=True)
    if min(n, m) <= 8 and ties.max() == 1:
        ways = np.array(_u_counts(n, m))
        share = ways / ways.sum()
        low, high = share[: int(u) + 1].sum(), share[int(u) :].sum()
        return u, float(low if less else min(1.0, 2 * min(low, high)))
    total = n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - (ties**3 - ties).sum() / (total * (total - 1))))
    if sd == 0:
        return u, 1.0
    if less:
        return u, normal_upper(-(u - n * m / 2 + 0.5) / sd)
    return u, min(1.0, 2 * normal_upper((max(u, n * m - u) - n * m / 2 - 0.5) / sd))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p after Royston's 1995 approximation."""
    n = len(x)
    x = np.sort(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n <= 5:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        else:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[1], a[-2] = -second, second
        a[0], a[-1] = -last, last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y = -math.log(gamma - math.log(1 - w))
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, v = math.log(1 - w), math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
    return w, normal_upper((y - mu) / sd)
