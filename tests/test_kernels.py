"""Numpy kernels and tail probabilities against closed forms and brute force."""

import math
from itertools import combinations

import numpy as np
import pytest

from motionweave.functions import kernels, special


def test_low_pass_keeps_constants_and_phase():
    t = np.arange(400) / 200
    assert np.allclose(kernels.filtfilt(np.full(50, 3.0), 6, 200), 3.0)
    slow = np.sin(2 * np.pi * t)
    assert np.abs(kernels.filtfilt(slow, 6, 200) - slow)[20:-20].max() < 0.01
    at_cutoff = np.sin(2 * np.pi * 6 * t)
    gain = np.abs(kernels.filtfilt(at_cutoff, 6, 200))[100:300].max()
    assert abs(gain - 0.5) < 0.02  # -3 dB twice


def test_low_pass_leaves_short_and_broken_signals():
    short = np.arange(9.0)
    assert (kernels.filtfilt(short, 6, 200) == short).all()
    broken = np.array([1.0, np.nan] * 10)
    assert np.isnan(kernels.filtfilt(broken, 6, 200)).sum() == 10


def test_cross_correlation_finds_a_shift():
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    (lag,), (r,) = kernels.cross_correlations(np.stack([np.roll(x, 7), x], 1), np.array([0]), np.array([1]))
    assert lag == 7 and r > 0.9
    lag, r = kernels.cross_correlations(np.stack([np.ones(5), x[:5]], 1), np.array([0]), np.array([1]))
    assert lag[0] == 0 and math.isnan(r[0])


def test_distance_correlation():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=300), rng.normal(size=300)
    c = kernels.centred_distances
    assert kernels.distance_correlation(c(x), c(3 * x - 2)) == pytest.approx(1)
    assert kernels.distance_correlation(c(x), c(y)) < 0.2
    assert kernels.distance_correlation(c(x), c(np.ones(300))) == 0


def test_louvain_finds_two_cliques():
    w = np.zeros((10, 10))
    w[:5, :5] = w[5:, 5:] = 1
    w[0, 9] = w[9, 0] = 0.1
    np.fill_diagonal(w, 0)
    for seed in range(5):
        c = kernels.louvain(w, np.random.default_rng(seed))
        assert len(set(c[:5])) == len(set(c[5:])) == 1 and c[0] != c[9]


def test_tails():
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.t_two_sided(0, 5) == pytest.approx(1)
    assert special.f_upper(4.964602743, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.normal_upper(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.normal_quantile(1e-6) == pytest.approx(-4.753424309, abs=1e-6)


def test_mann_whitney_exact():
    rng = np.random.default_rng(2)
    for n, m in ((3, 4), (5, 5), (4, 8)):
        x, y = rng.normal(size=n), rng.normal(size=m) + 0.5
        u, p = special.mann_whitney(x, y)
        assert u == sum(a > b for a in x for b in y)
        all_u = [sum(c) - n * (n + 1) / 2 for c in combinations(range(1, n + m + 1), n)]
        low, high = np.mean(np.array(all_u) <= u), np.mean(np.array(all_u) >= u)
        assert p == pytest.approx(min(1, 2 * min(low, high)))


def test_shapiro_separates():
    rng = np.random.default_rng(3)
    assert special.shapiro(rng.normal(size=40))[1] > 0.05
    assert special.shapiro(rng.exponential(size=40))[1] < 0.01
    assert special.shapiro(np.ones(5)) == (1.0, 1.0)
    rejected = sum(special.shapiro(rng.normal(size=20))[1] < 0.05 for _ in range(400))
    assert 6 <= rejected <= 40


def test_levene_and_t():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 4, 6, 8, 10])
    t, p = special.t_test(x, y)
    assert t == pytest.approx(-1.897366596) and p == pytest.approx(0.0943498, abs=1e-6)
    assert special.levene(x, y)[0] == pytest.approx(2.057142857)
