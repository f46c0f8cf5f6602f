"""Spectral features of sample arrays. Arrays of one Arrow batch that have the same length are stacked and transformed together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Bands in Hz.
BAND_LF, BAND_HF, BAND_FULL, BAND_VLF = (0.1, 1.0), (1.0, 10.0), (0.1, 10.0), (0.01, 0.1)
# What is reported where a band holds no frequency, a spectrum has too few points for a slope, or a ratio has no band;
# and the least power that is ever divided by or put into a logarithm.
EMPTY_BAND, FLAT_SLOPE, NO_RATIO, LEAST_POWER = 0.0, -2.0, 1.0, 1e-30
# Points a slope needs, samples a power estimate needs, the least power a polarization is divided by.
SLOPE_POINTS, POWER_SAMPLES, LEAST_HORIZONTAL = 6, 16, 1e-10

WAVE_TYPE = ("rms_z double, rms_h double, hv_ratio double, lf_power double, hf_power double, spectral_slope double, "
             "vlf_power double, vlf_hv_ratio double")


def rms(samples: Column) -> Column:
    """Root mean square of an array after removing its mean, in the JVM."""
    n = F.size(samples)
    s1 = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n > 0, F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))))


def stacked(columns: list[pd.Series], width: int, compute: Callable[..., np.ndarray]) -> np.ndarray:
    """`compute` on blocks of rows whose arrays are equally long (all channels cut to the shortest); its rows in input order."""
    size = np.array([min((0 if a is None else len(a)) for a in row) for row in zip(*columns)], np.int64)
    out = np.full((len(size), width), np.nan)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        blocks = [np.array([np.asarray(col.iloc[i][:n], np.float64) for i in rows]) for col in columns] if n else [np.empty((len(rows), 0))] * len(columns)
        out[rows] = compute(*blocks)
    return out


def frame(values: np.ndarray, names: list[str]) -> pd.DataFrame:
    """NaN becomes NULL."""
    return pd.DataFrame(values, columns=names).astype(object).where(~np.isnan(values), None)


def line_slope(x: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Least-squares slope per row over the points in `use`."""
    n = use.sum(1)
    mx, my = (np.where(use, v, 0).sum(1) / np.maximum(n, 1) for v in (x, y))
    dx = np.where(use, x - mx[:, None], 0)
    dy = np.where(use, y - my[:, None], 0)
    return (dx * dy).sum(1) / np.where(n > 1, (dx * dx).sum(1), 1)


def power_density(x: np.ndarray, fs: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided density per row, averaged over Hann windows that overlap by half."""
    taper = np.hanning(window)
    cuts = np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, ::window // 2]
    power = np.square(np.abs(np.fft.rfft(cuts * taper, axis=2))).mean(1)
    return power * 2 / (fs * np.square(taper).sum()), np.fft.rfftfreq(window, 1 / fs)


def log_band_power(density: np.ndarray, freqs: np.ndarray, band: tuple[float, float]) -> np.ndarray:
    inside = (band[0] <= freqs) & (freqs < band[1])
    if not inside.any():
        return np.full(len(density), EMPTY_BAND)
    return np.log10(np.maximum(np.trapezoid(density[:, inside], freqs[inside], axis=1), LEAST_POWER))


def mean_ratio(ratio: np.ndarray, freqs: np.ndarray, band: tuple[float, float]) -> np.ndarray:
    inside = (band[0] <= freqs) & (freqs <= band[1])
    return ratio[:, inside].mean(1) if inside.any() else np.full(len(ratio), NO_RATIO)


def waveform_features(fs: float, seconds: float = 10.0):
    """Pandas UDF over (z, x, y) arrays: RMS, H/V ratios, band powers and spectral slope; NULLs for short or dead channels."""
    names = [x.split()[0] for x in WAVE_TYPE.split(", ")]
    window = int(fs * seconds)

    def block(*channels: np.ndarray) -> np.ndarray:
        out = np.full((len(channels[0]), len(names)), np.nan)
        if channels[0].shape[1] < window:
            return out
        z, x, y = (v - v.mean(1, keepdims=True) for v in channels)
        alive = z.any(1) & x.any(1) & y.any(1)
        if not alive.any():
            return out
        z, x, y = z[alive], x[alive], y[alive]
        (pz, f), (px, _), (py, _) = (power_density(v, fs, window) for v in (z, x, y))
        ratio = np.sqrt((px + py) / np.maximum(pz, LEAST_POWER))
        total = pz + px + py
        use = (BAND_FULL[0] <= f) & (f <= BAND_FULL[1]) & (total > 0)
        logf = np.broadcast_to(np.log10(np.maximum(f, LEAST_POWER)), total.shape)
        steep = line_slope(logf, np.log10(np.maximum(total, LEAST_POWER)), use)
        energy = lambda *parts: np.sqrt(sum(np.square(v).mean(1) for v in parts))
        out[alive] = np.stack([energy(z), energy(x, y), mean_ratio(ratio, f, BAND_FULL), log_band_power(total, f, BAND_LF), log_band_power(total, f, BAND_HF),
                               np.where(use.sum(1) >= SLOPE_POINTS, steep, FLAT_SLOPE), log_band_power(total, f, BAND_VLF), mean_ratio(ratio, f, BAND_VLF)], 1)
        return out

    @F.pandas_udf(WAVE_TYPE)
    def run(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return frame(stacked([z, x, y], len(names), block), names)
    return run


def dft_power(x: np.ndarray, fs: float, lo: float, hi: float) -> np.ndarray:
    """Mean power of the frequencies in [lo, hi] per row of x, padded with zeros to a power of two; NaN where there is none."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    if n < POWER_SAMPLES:
        return np.full(len(x), np.nan)
    padded = 2 ** int(np.ceil(np.log2(n)))
    freqs = np.fft.rfftfreq(padded, 1 / fs)[:-1]
    inside = (lo <= freqs) & (freqs <= hi)
    if not inside.any():
        return np.full(len(x), np.nan)
    return np.square(np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), padded)[:, :-1][:, inside])).mean(1) / padded


def higuchi(x: np.ndarray, k_max: int = 10) -> np.ndarray:
    """Fractal dimension per row of x. The length of the curve at stride k is, averaged over the k starting points,
    L(k) = (N - 1) / (k^2 m) sum |x[i + k] - x[i]| with m the steps from that point; the dimension is the slope of ln L(k) over
    ln(1/k). NaN for under 4 k_max samples or a curve without length at three strides."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    if n < 4 * k_max:
        return np.full(len(x), np.nan)
    strides = np.arange(1, k_max + 1)
    lengths = np.empty((len(x), k_max))
    for k in strides:
        jumps = np.abs(x[:, k:] - x[:, :-k])
        steps = (n - 1 - np.arange(k)) // k
        padded = np.pad(jumps, ((0, 0), (0, -jumps.shape[1] % k))).reshape(len(x), -1, k)
        lengths[:, k - 1] = (padded.sum(1) / steps).mean(1) * (n - 1) / k ** 2
    use = lengths > 0
    dimension = line_slope(np.broadcast_to(-np.log(strides), lengths.shape), np.log(np.where(use, lengths, 1)), use)
    return np.where(use.sum(1) >= 3, dimension, np.nan)


def ulf_features(fs: float = 1 / 60.0, lo: float = 0.001, hi: float = 0.1):
    """Pandas UDF over (z, h) arrays: band power of each, their ratio and the fractal dimension of z."""
    names = ["power_z", "power_h", "polarization", "fractal_dim"]

    def power(a: np.ndarray) -> np.ndarray:
        return dft_power(a, fs, lo, hi)[:, None]

    def one(a: np.ndarray) -> np.ndarray:
        return np.stack([dft_power(a, fs, lo, hi), higuchi(a)], 1)

    @F.pandas_udf("power_z double, power_h double, polarization double, fractal_dim double")
    def run(z: pd.Series, h: pd.Series) -> pd.DataFrame:
        pz, ph = stacked([z], 2, one), stacked([h], 1, power)[:, 0]
        ratio = np.where(ph >= LEAST_HORIZONTAL, pz[:, 0] / np.where(ph >= LEAST_HORIZONTAL, ph, 1), np.nan)
        return frame(np.stack([pz[:, 0], ph, ratio, pz[:, 1]], 1), names)
    return run


def log_spectrum(fs: float, n_freq: int = 16, f_min: float = 0.5, f_max: float = 20.0):
    """Pandas UDF: Hann amplitude spectrum sampled at log-spaced frequencies; NULL below 64 samples."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        target = np.logspace(np.log10(f_min), np.log10(min(f_max, 0.45 * fs)), n_freq)

        def one(v):
            v = np.asarray(v, dtype="float64")
            if len(v) < 64:
                return None
            v = (v - v.mean()) * np.hanning(len(v))
            f = np.fft.rfftfreq(len(v), 1.0 / fs)
            return np.interp(target, f[1:], np.abs(np.fft.rfft(v))[1:] / fs).tolist()
        return x.map(one)
    return run


def rms_envelope(samples: Column, per_bin: int) -> Column:
    """RMS of consecutive bins of `per_bin` samples, the incomplete last bin dropped; stays in the JVM."""
    n = F.floor(F.size(samples) / per_bin).cast("int")
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.sqrt(F.aggregate(F.slice(samples, i * per_bin + 1, F.lit(per_bin)), F.lit(0.0), lambda a, x: a + x * x) / per_bin))
