import numpy as np
import pytest

from tidegrid.functions import kernels as K
from tidegrid.functions.coords import gaussian_weights
from tidegrid.functions.stats import beta_inc, t_two_sided
from tidegrid.operators.spectrum import window_cuts


def test_butterworth_coefficients():
    b, a = K.butterworth(4, 0.1, "low")
    assert b == pytest.approx([0.00041660, 0.00166640, 0.00249960, 0.00166640, 0.00041660], abs=1e-8)
    assert a == pytest.approx([1.0, -3.18063855, 3.86119435, -2.11215536, 0.43826514], abs=1e-8)
    b, a = K.butterworth(4, 0.1, "high")
    assert b[0] == pytest.approx(0.66201584, abs=1e-8) and b.sum() == pytest.approx(0, abs=1e-12)
    b, a = K.butterworth(4, [0.1, 0.2], "band")
    assert len(a) == 9 and b.sum() == pytest.approx(0, abs=1e-12)


def gain(b, a, period):
    z = np.exp(-2j * np.pi / period * np.arange(len(a)))
    return abs((b @ z) / (a @ z)) ** 2


def test_zero_phase_gain_matches_squared_response():
    n = 4000
    t = np.arange(n)
    for kind, cut in (("low", 2 / 84), ("high", 2 / 36), ("band", [2 / 84, 2 / 36])):
        b, a = K.butterworth(4, cut, kind)
        for period in (12, 50, 200):
            x = np.cos(2 * np.pi * t / period)
            y = K.zero_phase(x[None], b, a)[0]
            middle = slice(1500, 2500)  # away from the start-up of the narrow band
            assert np.abs(y[middle] - gain(b, a, period) * x[middle]).max() < 2e-3, (kind, period)


def test_zero_phase_keeps_constants_and_is_symmetric():
    b, a = K.butterworth(4, 0.1, "low")
    assert K.zero_phase(np.full((2, 60), 3.5), b, a) == pytest.approx(3.5, abs=1e-9)
    x = np.zeros((1, 401))
    x[0, 200] = 1
    y = K.zero_phase(x, b, a)[0]
    assert y == pytest.approx(y[::-1], abs=1e-9)
    with pytest.raises(ValueError):
        K.zero_phase(np.zeros((1, 15)), b, a)


def test_power_share_peak_and_sum():
    x = np.sin(2 * np.pi * np.arange(240) / 24) + 5
    p = K.power_share(x[None])[0]
    assert p.sum() == pytest.approx(1) and p.argmax() == 10 and p[10] == pytest.approx(1)


def test_reflect_smooth_against_plain_loop():
    rng = np.random.default_rng(0)
    p, w = rng.random((3, 20)), gaussian_weights(7)
    out = K.reflect_smooth(p, w)
    for k in range(20):
        idx = [abs(i) if i < 20 else 38 - i for i in range(k - 3, k + 4)]
        assert out[:, k] == pytest.approx(p[:, idx] @ w)
    assert sum(gaussian_weights(15)) == pytest.approx(1)


def test_spectral_box_splits_a_series():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 97))
    low, high = K.spectral_box(x, None, 0.1), K.spectral_box(x, 0.1 + 1e-12, None)
    assert low + high == pytest.approx(x - x.mean(axis=1, keepdims=True))


@pytest.mark.parametrize("wave,per_day", [("kelvin", 24), ("er", 24), ("mjo", 1), ("ig1", 24), ("mrg", 24)])
def test_wave_box_against_plain_rules(wave, per_day):
    nk, nt = 12, 720
    t_min, t_max, k_min, k_max, _, _ = K.WAVES[wave]
    nf = nt // 2 + 1
    j_lo, j_hi = round(nt / (t_max * per_day)), min(round(nt / (t_min * per_day)), nf)
    lo = max(nk + k_min, nk // 2) if k_min < 0 else min(k_min, nk // 2)
    hi = max(nk + k_max, nk // 2) if k_max < 0 else min(k_max, nk // 2)
    got = K.wave_keep(nk, nt, per_day, wave)
    for i in range(nk):
        inside = lo <= i <= hi if lo < hi else not (hi < i < lo)
        for j in range(nf):
            assert got[nk - 1 - i, j] == (inside and j_lo <= j <= j_hi)
    assert (K.wave_keep(nk, nt, per_day, wave, dispersion=True) <= got).all()


def test_wave_filter_keeps_a_wave_inside_the_box():
    lon, t = np.arange(24)[:, None], np.arange(720)[None, :]
    wave = np.cos(2 * np.pi * (3 * lon / 24 - 6 * t / 720))
    noise = np.cos(2 * np.pi * 100 * t / 720) + 0 * lon
    out = K.wave_filter(wave + noise, 24, "kelvin")
    # columns 1..12 of the mirrored axis hold one member of each conjugate pair of wavenumber 3
    assert np.corrcoef(out.ravel(), wave.ravel())[0, 1] > 0.99
    assert abs(np.corrcoef(out.ravel(), noise.ravel())[0, 1]) < 1e-6


def test_gaussian_smooth_keeps_constants():
    assert K.gaussian_smooth(np.full((10, 3), 2.0), 1.5) == pytest.approx(2.0)


def test_draws():
    c = K.draw_counts(200, 30, 50)
    assert c.shape == (200, 50) and (c.sum(axis=1) == 30).all()
    assert abs(c.mean() - 30 / 50) < 1e-12 and c.sum(axis=0).min() > 60


def test_student_probabilities():
    assert t_two_sided([2.0, 12.706, 2.228, 1.96], [10, 1, 10, 1e6]) == pytest.approx([0.073388, 0.05, 0.05, 0.05], abs=2e-5)
    assert np.isnan(t_two_sided([1.0], [0])[0]) and t_two_sided([np.inf], [5])[0] == 0
    assert beta_inc(2.0, 3.0, np.array([0.0, 0.4, 1.0])) == pytest.approx([0, 0.5248, 1])


def test_window_cuts():
    cuts = window_cuts(83)
    # the last window of a width has one step more
    assert cuts == [(0, 41), (41, 83), (0, 20), (20, 40), (40, 60), (60, 80), (62, 83)]
