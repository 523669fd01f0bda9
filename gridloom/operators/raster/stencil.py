"""Convolutions, rank filters and edge detectors; the border mirrors unless a docstring says otherwise."""

from __future__ import annotations

import numpy as np

from gridloom.operators.raster.image import Kernel, clamp, correlate, store, taps

#: The masks by their textbook names.
PREWITT_X = [[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]]
SOBEL_X = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
ISOTROPIC_X = [[-1, 0, 1], [-(2**0.5), 0, 2**0.5], [-1, 0, 1]]
LAPLACE_4 = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]
LAPLACE_8 = [[1, 1, 1], [1, -8, 1], [1, 1, 1]]
#: A smoothing kernel with the sum 98.
COURSE_KERNEL = [[1, 2, 3, 2, 1], [2, 6, 8, 6, 2], [3, 8, 10, 8, 3], [2, 6, 8, 6, 2], [1, 2, 3, 2, 1]]


def convolve(kernel, border: str = "mirror") -> Kernel:
    """True convolution, the kernel turned by half a circle, divided by its sum if that is not zero."""
    k = np.asarray(kernel, float)
    total = k.sum()
    return lambda a: store(correlate(a, k[::-1, ::-1], border) / (total if abs(total) > 1e-9 else 1.0))


def mean(n: int) -> Kernel:
    return convolve(np.ones((n, n))) if n % 2 else lambda a: None


def gaussian_mask(n: int, sigma: float) -> np.ndarray:
    r = np.arange(n) - n // 2
    return np.exp(-(r[:, None] ** 2 + r[None, :] ** 2) / (2 * sigma * sigma))


def gaussian(n: int, sigma: float) -> Kernel:
    return convolve(gaussian_mask(n, sigma if sigma > 0 else 1.0)) if n % 2 else lambda a: None


def ranked(n: int, border: str = "mirror"):
    r = n // 2

    def stack(a: np.ndarray) -> np.ndarray:
        at = taps(a, r, border)
        return np.stack([at(i, j) for j in range(-r, r + 1) for i in range(-r, r + 1)])

    return stack


def median(n: int) -> Kernel:
    return (lambda a: clamp(np.sort(ranked(n)(a), axis=0)[n * n // 2])) if n % 2 else lambda a: None


def minimum(n: int, border: str = "mirror") -> Kernel:
    """An even n works as n + 1."""
    return lambda a: clamp(ranked(n, border)(a).min(axis=0))


def maximum(n: int, border: str = "mirror") -> Kernel:
    return lambda a: clamp(ranked(n, border)(a).max(axis=0))


# Gradients: pairs of unclamped maps (gx, gy).


def forward(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = taps(a, 1)
    return at(1, 0) - a, at(0, 1) - a


def roberts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = taps(a, 1)
    return at(1, 0) - at(0, 1), a - at(1, 1)


def masked(mask):
    m = np.asarray(mask, float)
    return lambda a: (correlate(a, m), correlate(a, m.T))


GRADIENTS = {"d": forward, "roberts": roberts, "prewitt": masked(PREWITT_X), "sobel": masked(SOBEL_X), "iso": masked(ISOTROPIC_X)}


def gradient_x(name: str) -> Kernel:
    """The map in x, shifted by 128."""
    return lambda a: clamp(np.trunc(GRADIENTS[name](a)[0] + (128.5 if name == "iso" else 128)))


def gradient_y(name: str) -> Kernel:
    return lambda a: clamp(np.trunc(GRADIENTS[name](a)[1] + (128.5 if name == "iso" else 128)))


def norm_l1(name: str) -> Kernel:
    return lambda a: clamp(sum(np.abs(g) for g in GRADIENTS[name](a)))


def norm_l2(name: str) -> Kernel:
    return lambda a: store(np.sqrt(sum(g * g for g in GRADIENTS[name](a)).astype(float)))


def direction(name: str) -> Kernel:
    """The angle of (gx, gy), from -pi..pi to 0..255."""

    def kernel(a: np.ndarray) -> np.ndarray:
        gx, gy = (g.astype(float) + 0.0 for g in GRADIENTS[name](a))
        return store((np.arctan2(gy, gx) + np.pi) / (2 * np.pi) * 255.0)

    return kernel


def edges(name: str, level: float) -> Kernel:
    """255 where the norm exceeds the level: the sum of absolutes for Roberts, the root of squares (not rounded) else."""

    def kernel(a: np.ndarray) -> np.ndarray:
        gx, gy = GRADIENTS[name](a)
        norm = np.abs(gx) + np.abs(gy) if name == "roberts" else np.sqrt((gx * gx + gy * gy).astype(float))
        return np.where(norm > level, 255, 0)

    return kernel


def laplace(mask) -> Kernel:
    return lambda a: clamp(correlate(a, mask) + 128)


def laplace_abs(a: np.ndarray) -> np.ndarray:
    return clamp(np.abs(correlate(a, LAPLACE_8)))


def zero_crossings(a: np.ndarray) -> np.ndarray:
    """255 where the 4-neighbour Laplacian changes its sign to a neighbour inside the image."""
    lap = correlate(a, LAPLACE_4)
    at = taps(lap, 1, "fill", 0.0)
    return np.where(np.any([lap * at(*d) < 0 for d in ((-1, 0), (1, 0), (0, -1), (0, 1))], axis=0), 255, 0)


def smooth5(sigma: float) -> Kernel:
    mask = gaussian_mask(5, sigma)
    return lambda a: store(correlate(a, mask / mask.sum()))


def laplacian_of_gaussian(sigma: float) -> Kernel:
    return lambda a: laplace(LAPLACE_8)(smooth5(sigma)(a).astype(np.int64))


def zero_crossings_log(sigma: float) -> Kernel:
    return lambda a: zero_crossings(smooth5(sigma)(a).astype(np.int64))


def sharpen(a: np.ndarray) -> np.ndarray:
    return clamp(a - correlate(a, LAPLACE_8))


# Morphology.


def binary_erode(n: int) -> Kernel:
    """255 where the whole window is 255; outside counts as background."""
    r = n // 2

    def kernel(a: np.ndarray) -> np.ndarray:
        at = taps((a == 255).astype(np.int8), r, "fill", 0)
        return np.where(np.all([at(i, j) == 1 for j in range(-r, r + 1) for i in range(-r, r + 1)], axis=0), 255, 0)

    return kernel


def binary_dilate(n: int) -> Kernel:
    """255 where any pixel of the window is 255; outside is ignored."""
    r = n // 2

    def kernel(a: np.ndarray) -> np.ndarray:
        at = taps((a == 255).astype(np.int8), r, "fill", 0)
        return np.where(np.any([at(i, j) == 1 for j in range(-r, r + 1) for i in range(-r, r + 1)], axis=0), 255, 0)

    return kernel


def then(*kernels: Kernel) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        for k in kernels:
            a = np.asarray(k(a), np.int64)
        return a

    return kernel


def binary_open(n: int) -> Kernel:
    return then(binary_erode(n), binary_dilate(n))


def binary_close(n: int) -> Kernel:
    return then(binary_dilate(n), binary_erode(n))


def inner_gradient(n: int) -> Kernel:
    return lambda a: clamp(a - binary_erode(n)(a))


def outer_gradient(n: int) -> Kernel:
    return lambda a: clamp(binary_dilate(n)(a) - a)


def morphological_gradient(n: int) -> Kernel:
    return lambda a: clamp(binary_dilate(n)(a) - binary_erode(n)(a))


def grey_erode(n: int) -> Kernel:
    """Least level of the window, clamped at the border."""
    return minimum(n, "clamp")


def grey_dilate(n: int) -> Kernel:
    return maximum(n, "clamp")


def grey_open(n: int) -> Kernel:
    return then(grey_erode(n), grey_dilate(n))


def grey_close(n: int) -> Kernel:
    return then(grey_dilate(n), grey_erode(n))


def grey_gradient(n: int) -> Kernel:
    return lambda a: clamp(grey_dilate(n)(a).astype(np.int64) - grey_erode(n)(a))
