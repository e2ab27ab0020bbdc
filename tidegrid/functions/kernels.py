"""Numpy kernels over a block of equally long series, shape ``(series, time)``.

They are small helpers: Spark decides which series form a block, see
:mod:`tidegrid.operators.series_kernels`.
"""

from __future__ import annotations

import numpy as np


# -- Butterworth, zero phase -------------------------------------------------------------


def butterworth(order: int, cutoff, kind: str):
    """Digital Butterworth coefficients ``(b, a)``; ``cutoff`` in units of the Nyquist frequency."""
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = 4.0 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, dtype=float)) / 2.0)
    if kind == "low":
        w = warped[0]
        zeros, poles, gain = np.empty(0, complex), poles * w, w**order
    elif kind == "high":
        w = warped[0]
        gain = np.real(1.0 / np.prod(-poles))
        zeros, poles = np.zeros(order, complex), w / poles
    elif kind == "band":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        zeros, poles, gain = np.zeros(order, complex), np.concatenate([half + root, half - root]), width**order
    else:
        raise ValueError(f"unknown filter kind {kind!r}")
    gain = gain * np.real(np.prod(4.0 - zeros) / np.prod(4.0 - poles))
    missing = len(poles) - len(zeros)
    zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(missing)])
    poles = (4 + poles) / (4 - poles)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def _recursion(x: np.ndarray, b: np.ndarray, a: np.ndarray, start: np.ndarray) -> np.ndarray:
    state = start.copy()
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        xt = x[:, t]
        yt = b[0] * xt + state[0]
        state[:-1] = state[1:] + b[1:-1, None] * xt - a[1:-1, None] * yt
        state[-1] = b[-1] * xt - a[-1] * yt
        out[:, t] = yt
    return out


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward and backward pass with odd padding of three filter lengths and settled start."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError(f"a series of {x.shape[1]} steps is too short: more than {pad} are needed")
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    ext = np.concatenate([left, x, right], axis=1)
    level = b.sum() / a.sum()
    settled = np.cumsum((b - a * level)[:0:-1])[::-1][:, None]
    fwd = _recursion(ext, b, a, settled * ext[:, 0])
    back = _recursion(fwd[:, ::-1], b, a, settled * fwd[:, -1])[:, ::-1]
    return back[:, pad:-pad]


# -- spectra -----------------------------------------------------------------------------


def power_share(x: np.ndarray) -> np.ndarray:
    """Squared Fourier amplitudes of the centred series, scaled to sum 1 per series."""
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2
    total = power.sum(axis=1, keepdims=True)
    return np.divide(power, total, out=np.full_like(power, np.nan), where=total > 0)


def reflect_smooth(p: np.ndarray, weights) -> np.ndarray:
    """Weighted moving mean along axis 1; the ends are reflected without the edge sample.

    A row no longer than half the window cannot be reflected and becomes missing.
    """
    m = len(weights)
    if m <= 1:
        return p
    half = m // 2
    if p.shape[1] <= half:
        return np.full_like(p, np.nan)
    ext = np.concatenate([p[:, half:0:-1], p, p[:, -2 : -half - 2 : -1]], axis=1)
    out = np.zeros_like(p)
    for i, w in enumerate(weights):
        out += w * ext[:, i : i + p.shape[1]]
    return out


def spectral_box(x: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """Centred series with Fourier coefficients outside ``[low, high]`` cycles per step removed."""
    n = x.shape[1]
    freq = np.fft.rfftfreq(n)
    coef = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
    if high is not None:
        coef[:, freq > high] = 0
    if low is not None:
        coef[:, freq < low] = 0
    return np.fft.irfft(coef, n=n, axis=1)


# -- zonal waves -------------------------------------------------------------------------

EARTH_RADIUS = 6.371008e6
GRAVITY = 9.80665
BETA = 2 * 7.292e-05 / EARTH_RADIUS

# period range (days), wavenumber range, equivalent-depth range (m); None = open (fixed values). The curves ig0 and ig2 have no
# box of their own: it is given with the call
WAVES = {
    "kelvin": (2.5, 20, 1, 14, 8, 90),
    "mrg": (2, 6, -250, 250, None, None),
    "ig1": (1.2, 2.6, -15, -1, 12, 90),
    "er": (10, 40, -10, -1, 8, 90),
    "mjo": (30, 96, 0, 250, None, None),
}


def _round(v: float) -> int:
    return int(np.round(v))


def wave_columns(nk: int, k_min: float, k_max: float) -> np.ndarray:
    """Which wavenumber columns stay; a lower end at or above the upper one keeps the outside."""

    def place(k):
        return max(_round(nk + k), nk // 2) if k < 0 else min(_round(k), nk // 2)

    lo, hi = place(k_min), place(k_max)
    i = np.arange(nk)
    return (i >= lo) & (i <= hi) if lo < hi else ~((i > hi) & (i < lo))


def wave_rows(nf: int, obs_per_day: float, t_min: float, t_max: float) -> np.ndarray:
    nt = (nf - 1) * 2
    lo, hi = _round(nt / (t_max * obs_per_day)), min(_round(nt / (t_min * obs_per_day)), nf)
    j = np.arange(nf)
    return (j >= lo) & (j <= hi)


Box = tuple[float, float, float, float, float | None, float | None]


def wave_box(wave: str, box: Box | None) -> Box:
    """A box as in :data:`WAVES`: the one given, or the preset."""
    if box is None and wave not in WAVES:
        raise ValueError(f"{wave} has no preset: give its box")
    return WAVES[wave] if box is None else box


def kept_frequencies(n: int, obs_per_day: float, wave: str, box: Box | None = None) -> np.ndarray:
    """Frequency rows of a preset for ``n`` time steps; row 0, which is then masked, where none is left."""
    rows = np.flatnonzero(wave_rows(n // 2 + 1, obs_per_day, *wave_box(wave, box)[:2]))
    return rows if len(rows) else np.zeros(1, dtype=int)


def _dispersion(wave: str, k: float, c: np.ndarray) -> np.ndarray | None:
    if wave == "kelvin":
        return k * c
    if wave == "er":
        return -BETA * k / (k**2 + 3 * BETA / c)
    if wave in ("mrg", "ig0"):
        if k == 0:
            return np.sqrt(BETA * c)
        root = np.sqrt(1 + 4 * BETA / (k**2 * c))
        return k * c * (0.5 + 0.5 * root) if k > 0 else k * c * (0.5 - 0.5 * root)
    if wave in ("ig1", "ig2"):
        return np.sqrt((3 if wave == "ig1" else 5) * BETA * c + k**2 * c**2)
    return None


def wave_keep(nk: int, nt: int, obs_per_day: float, wave: str, dispersion: bool = False, box: Box | None = None) -> np.ndarray:
    """Boolean mask ``(nk, nf)`` in FFT order of the coefficients a wave preset keeps."""
    t_min, t_max, k_min, k_max, h_min, h_max = wave_box(wave, box)
    nf = nt // 2 + 1
    span = (nf - 1) * 2
    keep = np.outer(wave_columns(nk, k_min, k_max), wave_rows(nf, obs_per_day, t_min, t_max))
    if dispersion and h_min is not None:
        c = np.sqrt(GRAVITY * np.array([h_min, h_max], dtype=float))
        per_cycle = 24 * 3600.0 / (2 * np.pi * obs_per_day)
        j = np.arange(nf)
        for i in range(nk):
            k = (i if i < nk / 2 else i - nk) / EARTH_RADIUS
            bounds = _dispersion(wave, k, c)
            if bounds is not None:
                lo = min(int(np.floor(bounds[0] * per_cycle * span)), nf)
                hi = max(int(np.ceil(bounds[1] * per_cycle * span)), 0)
                keep[i] &= (j >= lo) & (j <= hi)
    # column i of the mask belongs to the mirrored coefficient of the transform
    return keep[::-1]


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along axis 0, cut at four sigmas, ends mirrored with the edge sample."""
    reach = int(4.0 * sigma + 0.5)
    steps = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (steps / sigma) ** 2)
    w /= w.sum()
    n = x.shape[0]
    pos = np.mod(np.arange(n)[:, None] + steps, 2 * n)
    pos = np.where(pos >= n, 2 * n - 1 - pos, pos)
    return np.einsum("r,nrt->nt", w, x[pos])


def wave_filter(x: np.ndarray, obs_per_day: float, wave: str, smooth: float | None = None, dispersion: bool = False, box: Box | None = None) -> np.ndarray:
    """Keep a wavenumber-frequency box of a ``(lon, time)`` slice."""
    if smooth is not None:
        x = gaussian_smooth(x, smooth)
    coef = np.fft.rfft2(x)
    coef[~wave_keep(x.shape[0], x.shape[1], obs_per_day, wave, dispersion, box)] = 0
    return np.fft.irfft2(coef, s=x.shape)


# -- resampling draws --------------------------------------------------------------------

# Quadratic residues modulo a Mersenne prime: the same integers in numpy, Spark SQL and ANSI SQL.
DRAW_PRIME = 2147483647
DRAW_STEP, ITEM_STEP, MIX_A, MIX_B = 1000003, 7919, 12345, 678910


def draw_positions(n_draws: int, size: int, n_times: int, seed: int = 0) -> np.ndarray:
    """Positions ``(n_draws, size)`` drawn with replacement from ``range(n_times)``."""
    d = np.arange(n_draws, dtype=np.int64)[:, None]
    j = np.arange(size, dtype=np.int64)[None, :]
    x = (d * DRAW_STEP + j * ITEM_STEP + seed + 1) % DRAW_PRIME
    x = (x * x + MIX_A) % DRAW_PRIME
    x = (x * x + MIX_B) % DRAW_PRIME
    return x % n_times


def draw_counts(n_draws: int, size: int, n_times: int, seed: int = 0) -> np.ndarray:
    """How often each time was drawn, shape ``(n_draws, n_times)``."""
    pos = draw_positions(n_draws, size, n_times, seed)
    out = np.zeros((n_draws, n_times))
    np.add.at(out, (np.repeat(np.arange(n_draws), size), pos.ravel()), 1.0)
    return out
