"""Numeric helpers against plain definitions."""

import itertools

import numpy as np

from tidewave.functions.kernels import assignment, bandpass_gain, dip_cut, filter_signal, isotonic, keep_peaks, principal_axes, unimodal


def test_equal_peaks_keep_the_first_and_the_interval_is_included():
    assert keep_peaks([0, 10], [5.0, 5.0], 10) == [True, False]
    assert keep_peaks([0, 11], [5.0, 4.0], 10) == [True, True]
    assert keep_peaks([0, 5], [4.0, 5.0], 10) == [False, True]
    # a suppressed candidate still suppresses one that the peak doesn't reach
    assert keep_peaks([0, 8, 16], [9.0, 5.0, 4.0], 10) == [True, False, False]
    assert keep_peaks([], [], 10) == []


def test_assignment_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for _ in range(60):
        gain = rng.integers(0, 20, (rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        n, m = gain.shape
        square = np.zeros((max(n, m),) * 2)
        square[:n, :m] = gain
        best = max(sum(square[i, p[i]] for i in range(len(square))) for p in itertools.permutations(range(len(square))))
        assert sum(gain[i, j] for i, j in enumerate(assignment(gain)) if j >= 0) == best


def test_isotonic_is_monotone_with_its_error():
    rng = np.random.default_rng(2)
    y, w = rng.normal(size=30), rng.random(30) + 0.1
    fit, error = isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    for i in (1, 10, 29):
        part, _ = isotonic(y[: i + 1], w[: i + 1])
        assert abs((w[: i + 1] * (y[: i + 1] - part) ** 2).sum() - error[i]) < 1e-9
    u = unimodal(y, w)
    top = int(u.argmax())
    assert (np.diff(u[: top + 1]) >= -1e-12).all() and (np.diff(u[top:]) <= 1e-12).all()


def test_dip_tells_one_mode_from_two():
    rng = np.random.default_rng(3)
    assert dip_cut(rng.normal(size=1000))[0] < 1
    dip, cut = dip_cut(np.concatenate([rng.normal(size=1000), rng.normal(6, 1, 400)]))
    assert dip > 1 and 1.5 < cut < 4.8
    assert dip_cut(np.ones(50))[0] == 0


def test_axes_are_orthonormal_and_filter_passes_its_band():
    rng = np.random.default_rng(5)
    axes = principal_axes(rng.normal(size=(100, 6)), 3)
    assert np.allclose(axes.T @ axes, np.eye(3))
    assert bandpass_gain(1000, 1000, 50, 200, 20)[0] == 0
    t = np.arange(1000) / 1000
    y = filter_signal(3 + np.sin(2 * np.pi * 100 * t), 1000, 50, 200, 20)
    assert abs(y.mean()) < 1e-9 and abs(y.std() - np.sqrt(0.5)) < 0.01
