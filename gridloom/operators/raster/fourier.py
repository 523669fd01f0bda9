"""Spectra and filters in the frequency domain: images are padded with zeros to powers of two, spectra are centred."""

from __future__ import annotations

import numpy as np

from gridloom.operators.raster.image import Kernel, store


def next_power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def spectrum(a: np.ndarray) -> np.ndarray:
    """The centred transform of a stack; it is the conjugate of the one with the other sign of the exponent."""
    _, h, w = a.shape
    padded = np.pad(a.astype(float), ((0, 0), (0, next_power(h) - h), (0, next_power(w) - w)))
    return np.fft.fftshift(np.conj(np.fft.fft2(padded)), axes=(1, 2))


def inverse(f: np.ndarray, h: int, w: int) -> np.ndarray:
    return np.fft.ifft2(np.conj(np.fft.ifftshift(f, axes=(1, 2)))).real[:, :h, :w]


def radius(f: np.ndarray, u: float = 0.0, v: float = 0.0) -> np.ndarray:
    """Distance of each frequency to the centre moved by (u, v)."""
    _, h, w = f.shape
    y, x = np.arange(h)[:, None] - (h / 2 + v), np.arange(w)[None, :] - (w / 2 + u)
    return np.sqrt(x * x + y * y)


def cut(f: np.ndarray, percent: float) -> float:
    _, h, w = f.shape
    return percent / 100.0 * np.sqrt((w / 2) ** 2 + (h / 2) ** 2)


def _shown(values: np.ndarray, h: int, w: int) -> np.ndarray:
    """Magnitudes over the largest of the whole spectrum, its upper left part of the image's size."""
    most = values.max(axis=(1, 2), keepdims=True)
    return store(np.where(most > 0, values / np.where(most > 0, most, 1) * 255.0, 0.0)[:, :h, :w])


def magnitude(a: np.ndarray) -> np.ndarray:
    return _shown(np.abs(spectrum(a)), *a.shape[1:])


def log_magnitude(a: np.ndarray) -> np.ndarray:
    return _shown(np.log(1 + np.abs(spectrum(a))), *a.shape[1:])


def low_pass_spectrum(f: np.ndarray, percent: float) -> np.ndarray:
    return np.where(radius(f) > cut(f, percent), 0, f)


def high_pass_spectrum(f: np.ndarray, percent: float) -> np.ndarray:
    return np.where(radius(f) < cut(f, percent), 0, f)


def low_pass(percent: float) -> Kernel:
    return lambda a: store(inverse(low_pass_spectrum(spectrum(a), percent), *a.shape[1:]))


def high_pass(percent: float) -> Kernel:
    return lambda a: store(inverse(high_pass_spectrum(spectrum(a), percent), *a.shape[1:]))


def low_spectrum(percent: float) -> Kernel:
    return lambda a: _shown(np.log(1 + np.abs(low_pass_spectrum(spectrum(a), percent))), *a.shape[1:])


def high_spectrum(percent: float) -> Kernel:
    return lambda a: _shown(np.log(1 + np.abs(high_pass_spectrum(spectrum(a), percent))), *a.shape[1:])


def notch(u: int, v: int, r: float) -> Kernel:
    """Without the frequencies closer than r to (u, v) and its mirror image."""

    def kernel(a: np.ndarray) -> np.ndarray:
        f = spectrum(a)
        return store(inverse(np.where((radius(f, u, v) < r) | (radius(f, -u, -v) < r), 0, f), *a.shape[1:]))

    return kernel


def enhance(percent: float, alpha: float) -> Kernel:
    return lambda a: store(a + alpha * inverse(high_pass_spectrum(spectrum(a), percent), *a.shape[1:]))


def round_trip_error(image: np.ndarray) -> float:
    a = image[None].astype(float)
    return float(((inverse(spectrum(a), *image.shape) - a) ** 2).mean())


def transform_1d(x: np.ndarray) -> np.ndarray:
    """Forward transform of a line padded to a power of two, with a positive exponent."""
    n = next_power(len(x))
    return np.conj(np.fft.fft(np.r_[x, np.zeros(n - len(x))]))
