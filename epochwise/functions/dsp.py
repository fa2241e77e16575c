"""Vectorised spectral kernels, applied by Spark to Arrow batches of ARRAY<DOUBLE>.

Spark groups and shuffles the samples; a kernel sees one batch of equally long segments as one
matrix. Nothing here keeps state between batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from epochwise.functions.constants import BANDS, CHANNEL_FEATURES, EPS


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def lists_to_matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a (rows, length) matrix, without a Python loop."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def matrix_to_lists(mat: np.ndarray) -> pa.Array:
    rows, width = mat.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat).ravel()))


def welch_matrix(x: np.ndarray, rate: float, nperseg: int) -> np.ndarray:
    """One-sided density, Hann, 50 % overlap, constant detrend, mean over segments."""
    nper = min(nperseg, x.shape[1])
    step = nper - nper // 2
    win = hann(nper)
    starts = range(0, x.shape[1] - nper + 1, step)
    acc = np.zeros((x.shape[0], nper // 2 + 1))
    for s in starts:
        seg = x[:, s : s + nper]
        seg = (seg - seg.mean(axis=1, keepdims=True)) * win
        acc += np.abs(np.fft.rfft(seg, axis=1)) ** 2
    psd = acc / (len(starts) * rate * np.sum(win * win))
    last = psd.shape[1] if nper % 2 else psd.shape[1] - 1
    psd[:, 1:last] *= 2.0
    return psd


def welch_freqs(length: int, rate: float, nperseg: int) -> np.ndarray:
    nper = min(nperseg, length)
    return np.arange(nper // 2 + 1) * rate / nper


def feature_matrix(x: np.ndarray, rate: float, nperseg: int, log_scale: bool, eps: float) -> np.ndarray:
    """The ten channel features of each row of ``x``."""
    psd = welch_matrix(x, rate, nperseg)
    freqs = welch_freqs(x.shape[1], rate, nperseg)
    total = psd.sum(axis=1) + eps
    bands = [psd[:, (freqs >= lo) & (freqs < hi)].sum(axis=1) / total for lo, hi in BANDS.values()]
    d1 = np.diff(x, axis=1)
    d2 = np.diff(d1, axis=1)
    v0, v1, v2 = (v.var(axis=1) + eps for v in (x, d1, d2))
    mobility = np.sqrt(v1 / v0)
    # the raw variant also guards the outer division
    complexity = np.sqrt(v2 / v1) / (mobility if log_scale else mobility + eps)
    length = np.abs(d1).sum(axis=1)
    rms = np.sqrt((x * x).mean(axis=1))
    if log_scale:
        v0, length, rms = (np.log(v + eps) for v in (v0, length, rms))
    return np.column_stack([*bands, v0, mobility, complexity, length, rms])


def channel_features_udf(rate: float, nperseg: int, log_scale: bool = True, eps: float = EPS):
    """ARRAY<DOUBLE> -> struct of the ten channel features."""
    ddl = ", ".join(f"{n} double" for n in CHANNEL_FEATURES)

    @F.arrow_udf(f"struct<{ddl.replace(' double', ': double')}>")
    def features(x: pa.Array) -> pa.Array:
        if len(x) == 0:
            mat = np.zeros((0, len(CHANNEL_FEATURES)))
        else:
            mat = feature_matrix(lists_to_matrix(x), rate, nperseg, log_scale, eps)
        return pa.StructArray.from_arrays([pa.array(c) for c in mat.T.copy()], CHANNEL_FEATURES)

    return features


def welch_udf(rate: float, nperseg: int):
    """ARRAY<DOUBLE> -> ARRAY<DOUBLE> of spectral densities."""

    @F.arrow_udf("array<double>")
    def welch(x: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return matrix_to_lists(welch_matrix(lists_to_matrix(x), rate, nperseg))

    return welch


def stft_frames(length: int, nperseg: int, noverlap: int, boundary: bool) -> tuple[int, int]:
    """(zeros before, padded length) such that whole frames cover the signal."""
    lead = nperseg // 2 if boundary else 0
    size = length + 2 * lead
    hop = nperseg - noverlap
    size += (-(size - nperseg) % hop) % nperseg
    return lead, size


def stft_matrix(x: np.ndarray, nperseg: int, noverlap: int, boundary: bool = True) -> np.ndarray:
    """|STFT| as (rows, freq, frame); Hann, magnitude scaled by the window sum."""
    lead, size = stft_frames(x.shape[1], nperseg, noverlap, boundary)
    padded = np.zeros((x.shape[0], size))
    padded[:, lead : lead + x.shape[1]] = x
    win = hann(nperseg)
    hop = nperseg - noverlap
    frames = [
        np.abs(np.fft.rfft(padded[:, s : s + nperseg] * win, axis=1)) / win.sum()
        for s in range(0, size - nperseg + 1, hop)
    ]
    return np.stack(frames, axis=2)


def stft_udf(nperseg: int, noverlap: int, boundary: bool = True):
    """ARRAY<DOUBLE> -> ARRAY<DOUBLE>, flattened frequency-major."""

    @F.arrow_udf("array<double>")
    def stft(x: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.list_(pa.float64()))
        mat = stft_matrix(lists_to_matrix(x), nperseg, noverlap, boundary)
        return matrix_to_lists(mat.reshape(len(x), -1))

    return stft


def bandpass_taps(half: int, lo: float, hi: float, rate: float) -> list[float]:
    """Symmetric windowed-sinc band-pass of 2*half+1 taps (zero phase when centred)."""
    k = np.arange(-half, half + 1)
    ideal = 2 * hi / rate * np.sinc(2 * hi / rate * k) - 2 * lo / rate * np.sinc(2 * lo / rate * k)
    shape = 0.54 + 0.46 * np.cos(np.pi * k / (half + 1))
    taps = ideal * shape
    centre = np.sqrt(lo * hi) if lo > 0 else 0.0
    gain = np.sum(taps * np.cos(2 * np.pi * centre / rate * k))
    return [float(v) for v in taps / gain]


def convolved(idx: np.ndarray, value: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Centred convolution at the places ``idx``; what is between them and outside counts as zero."""
    dense = np.zeros(int(idx[-1] - idx[0]) + 1)
    dense[idx - idx[0]] = value
    half = len(taps) // 2
    if len(taps) <= 64:
        full = np.convolve(dense, taps)
    else:
        size = len(dense) + len(taps) - 1
        full = np.fft.irfft(np.fft.rfft(dense, size) * np.fft.rfft(taps, size), size)
    return full[half + idx - idx[0]]


def fir_udf(taps: list[float]):
    """(indices, values) of a block to its filtered values, at the same indices.

    ``taps`` may be of any odd number, and are taken in the order of a correlation.
    """
    kernel = np.array(taps)[::-1].copy()

    @F.arrow_udf("array<double>")
    def fir(idx: pa.Array, value: pa.Array) -> pa.Array:
        rows = [convolved(np.array(i.as_py()), np.array(v.as_py()), kernel) for i, v in zip(idx, value)]
        return pa.array(rows, pa.list_(pa.float64()))

    return fir


def morlet_kernels(scales: list[int], precision: int = 10) -> dict[int, np.ndarray]:
    """FIR kernel per scale for the real Morlet wavelet exp(-x^2/2) cos(5x) on [-8, 8].

    The wavelet is integrated on a fine grid, stretched to the scale, differenced and
    weighted by -sqrt(scale); a full convolution trimmed to the centre gives the transform.
    """
    grid = np.linspace(-8.0, 8.0, 2**precision)
    step = grid[1] - grid[0]
    primitive = np.cumsum(np.exp(-(grid**2) / 2.0) * np.cos(5.0 * grid)) * step
    out = {}
    for s in scales:
        at = (np.arange(s * 16.0 + 1) / (s * step)).astype(int)
        stretched = primitive[at[at < grid.size]][::-1]
        out[s] = -math.sqrt(s) * np.diff(np.concatenate([[0.0], stretched, [0.0]]))
    return out


def centred(n: int, kernel_size: int) -> tuple[int, int]:
    """Start and stop of the n centre values inside a full convolution."""
    # the outermost value on each side belongs to the differencing, not to the transform
    full = n + kernel_size - 3
    skip = (full - n) / 2.0
    start = math.floor(skip) + 1
    return start, start + n


def cwt_matrix(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """|CWT| of every row for one scale, by FFT convolution."""
    n = x.shape[1]
    size = n + len(kernel) - 1
    conv = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(kernel, size), size, axis=1)
    start, stop = centred(n, len(kernel))
    return np.abs(conv[:, start:stop])


def cwt_batches(scales: list[int], strip: int = 256):
    """Batches whose last column is an ARRAY<DOUBLE> to the same with all scales' magnitudes in its place, scale-major.

    A row becomes as many times longer as there are scales, so a batch is given back in strips of rows.
    """
    kernels = morlet_kernels(scales)

    def cwt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, strip):
                part = whole.slice(at, strip)
                mat = lists_to_matrix(part.column(part.num_columns - 1))
                found = matrix_to_lists(np.concatenate([cwt_matrix(mat, kernels[s]) for s in scales], axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=part.schema.names)

    return cwt
