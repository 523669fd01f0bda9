"""Segmentation, binary images and region operators."""

from __future__ import annotations

from collections import deque

import numpy as np

from gridloom.operators.raster.image import Kernel, clamp, taps
from gridloom.operators.raster.point import level_counts

#: The steps of the eight directions of a chain code, from east on.
STEPS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
FAR = 999_999


def threshold(level: int) -> Kernel:
    return lambda a: np.where(a >= level, 255, 0)


def multi_threshold(levels: list[int]) -> Kernel:
    """Class k after the last of the levels that the pixel reaches, spread over 0..255."""

    def kernel(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for k, level in enumerate(levels):
            out = np.where(a >= level, k + 1, out)
        return out * 255 // max(1, len(levels))

    return kernel


def otsu_levels(a: np.ndarray) -> np.ndarray:
    """The level that maximises the variance between the pixels up to it and the rest, the least of equals; 0 if flat."""
    counts = level_counts(a).astype(float)
    levels = np.arange(256)
    below, mass = np.cumsum(counts, axis=1), np.cumsum(counts * levels, axis=1)
    above, total = below[:, -1:] - below, mass[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / below - (total - mass) / above
        between = np.where((below > 0) & (above > 0), below * above * gap * gap, 0.0)
    return between.argmax(axis=1)


def otsu(a: np.ndarray) -> np.ndarray:
    """255 from the level on, the level itself included."""
    return np.where(a >= otsu_levels(a)[:, None, None], 255, 0)


def _window_sums(a: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of squares over the part of the window inside the image."""
    out = []
    for plane in (np.ones_like(a), a, a * a):
        at = taps(plane, r, "fill", 0)
        out.append(sum(at(i, j) for j in range(-r, r + 1) for i in range(-r, r + 1)))
    return tuple(out)


def adaptive(window: int, offset: int) -> Kernel:
    def kernel(a: np.ndarray) -> np.ndarray:
        n, total, _ = _window_sums(a, window // 2)
        return np.where(a >= total // n - offset, 255, 0)

    return kernel


def adaptive_variance(window: int, least: float) -> Kernel:
    """0 where the window varies less, else by the truncated mean."""

    def kernel(a: np.ndarray) -> np.ndarray:
        n, total, squares = _window_sums(a, window // 2)
        mean = total / n
        return np.where((squares / n - mean * mean >= least) & (a >= np.trunc(mean)), 255, 0)

    return kernel


def k_means(k: int, rounds: int) -> Kernel:
    """Levels by the truncated centre of their cluster: centres start evenly spread, ties go to the first, an empty
    cluster keeps its centre. Works on histograms, so the image size does not matter."""
    k = k if 0 < k <= 256 else 2

    def kernel(a: np.ndarray) -> np.ndarray:
        counts, levels = level_counts(a).astype(float), np.arange(256.0)
        centres = np.tile(255.0 * np.arange(k) / max(1, k - 1), (len(a), 1))
        owner = np.full((len(a), 256), -1)
        active = np.ones(len(a), bool)
        for _ in range(rounds):
            nearest = np.abs(levels[None, :, None] - centres[:, None, :]).argmin(axis=2)
            moved = ((nearest != owner) & (counts > 0)).any(axis=1) & active
            owner = np.where(active[:, None], nearest, owner)
            active = moved
            if not moved.any():
                break
            for j in range(k):
                mine = counts * (owner == j)
                n = mine.sum(axis=1)
                centres[:, j] = np.where(moved & (n > 0), (mine * levels).sum(axis=1) / np.maximum(n, 1), centres[:, j])
        table = clamp(np.trunc(np.take_along_axis(centres, np.maximum(owner, 0), axis=1)))
        return np.take_along_axis(table, a.reshape(len(a), -1), axis=1).reshape(a.shape)

    return kernel


def quadtree(image: np.ndarray, spread: int) -> list[tuple[int, int, int, int]]:
    """Leaves (x, y, w, h): a block splits in four while its levels spread wider and both its sides exceed one."""
    leaves, waiting = [], [(0, 0, image.shape[1], image.shape[0])]
    while waiting:
        x, y, w, h = waiting.pop()
        block = image[y : y + h, x : x + w]
        if w <= 1 or h <= 1 or block.max() - block.min() <= spread:
            leaves.append((x, y, w, h))
        else:
            a, b = w // 2, h // 2
            waiting += [(x, y, a, b), (x + a, y, w - a, b), (x, y + b, a, h - b), (x + a, y + b, w - a, h - b)]
    return leaves


def each(function) -> Kernel:
    return lambda a: np.stack([function(x) for x in a])


def split(spread: int) -> Kernel:
    """Every leaf of the quadtree in its truncated mean."""

    def one(image: np.ndarray) -> np.ndarray:
        out = np.zeros_like(image)
        for x, y, w, h in quadtree(image, spread):
            out[y : y + h, x : x + w] = image[y : y + h, x : x + w].sum() // (w * h)
        return out

    return each(one)


def split_edges(spread: int) -> Kernel:
    """The image with the right and lower edges of the leaves in white."""

    def one(image: np.ndarray) -> np.ndarray:
        out = image.copy()
        for x, y, w, h in quadtree(image, spread):
            out[y : y + h, x + w - 1] = 255
            out[y + h - 1, x : x + w] = 255
        return out

    return each(one)


def grow(seed_x: int, seed_y: int, tolerance: float) -> Kernel:
    """The region around a seed, breadth first east, west, south, north: a pixel joins if it is within the tolerance of
    the mean so far, and is asked once. Seeds outside are moved to the border."""

    def one(image: np.ndarray) -> np.ndarray:
        h, w = image.shape
        x, y = min(max(seed_x, 0), w - 1), min(max(seed_y, 0), h - 1)
        out, asked = np.zeros_like(image), np.zeros(image.shape, bool)
        out[y, x], asked[y, x] = 255, True
        total, n, queue = int(image[y, x]), 1, deque([(x, y)])
        while queue:
            x, y = queue.popleft()
            for dx, dy in FOUR:
                u, v = x + dx, y + dy
                if 0 <= u < w and 0 <= v < h and not asked[v, u]:
                    asked[v, u] = True
                    if abs(int(image[v, u]) - total / n) <= tolerance:
                        out[v, u] = 255
                        total, n = total + int(image[v, u]), n + 1
                        queue.append((u, v))
        return out

    return each(one)


def grow_many(across: int, down: int, tolerance: float) -> Kernel:
    """Regions around a grid of seeds that share one queue; a pixel that one region refuses may join another later.
    Regions are spread over 0..255 by number, the first being 0 like what no region reaches."""

    def one(image: np.ndarray) -> np.ndarray:
        h, w = image.shape
        owner = np.full(image.shape, -1)
        total, n, queue = [], [], deque()
        for g in range(across * down):
            x = min(max((g % across + 1) * w // (across + 1), 0), w - 1)
            y = min(max((g // across + 1) * h // (down + 1), 0), h - 1)
            total.append(int(image[y, x]))
            n.append(1)
            owner[y, x] = g
            queue.append((x, y))
        while queue:
            x, y = queue.popleft()
            g = owner[y, x]
            for dx, dy in FOUR:
                u, v = x + dx, y + dy
                if 0 <= u < w and 0 <= v < h and owner[v, u] < 0 and abs(int(image[v, u]) - total[g] / n[g]) <= tolerance:
                    owner[v, u] = g
                    total[g], n[g] = total[g] + int(image[v, u]), n[g] + 1
                    queue.append((u, v))
        return np.where(owner < 0, 0, owner * 255 // max(1, across * down - 1))

    return each(one)


def _spread_distance(d: np.ndarray, axis: int) -> np.ndarray:
    """min over x' of d[x'] + |x - x'| along an axis."""
    shape = [1, 1, 1]
    shape[axis] = d.shape[axis]
    i = np.arange(d.shape[axis]).reshape(shape)
    after = np.minimum.accumulate(d - i, axis=axis) + i
    back = np.flip(np.minimum.accumulate(np.flip(d + i, axis), axis=axis), axis) - i
    return np.minimum(after, back)


def distance_d4(a: np.ndarray) -> np.ndarray:
    """City-block distance of each pixel to the nearest background one (0) of its image."""
    return np.minimum(_spread_distance(_spread_distance(np.where(a == 0, 0, FAR), 1), 2), FAR)


def distance_d8(a: np.ndarray) -> np.ndarray:
    """Chessboard distance to the nearest background pixel."""
    d = np.where(a == 0, 0, FAR)
    while True:
        at = taps(d, 1, "fill", FAR)
        best = np.minimum(d, np.min([at(x, y) for x, y in STEPS], axis=0) + 1)
        best = np.minimum(best, FAR)
        if (best == d).all():
            return d
        d = best


def distance_map(distance) -> Kernel:
    """Distances spread over 0..255 by the largest; images without background are white."""

    def kernel(a: np.ndarray) -> np.ndarray:
        d = distance(a)
        most = np.maximum(1, np.where(d < FAR, d, 0).max(axis=(1, 2), keepdims=True))
        return np.where(d >= FAR, 255, d * 255 // most)

    return kernel


def component_numbers(a: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of the pixels that are not 0, numbered from 1 in the order of their first pixels, and their number.

    Hooks every pair of neighbours to the lower root and shortens the paths, until nothing moves.
    """
    n, h, w = a.shape
    index, solid = np.arange(a.size).reshape(a.shape), a != 0
    pairs = []
    for dx, dy in [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if neighbours == 8 else []):
        here = (slice(None), slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        there = (slice(None), slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        both = solid[here] & solid[there]
        pairs.append((index[here][both], index[there][both]))
    u, v = (np.concatenate(x) for x in zip(*pairs))
    root = np.arange(a.size)
    while len(u):
        p, q = root[u], root[v]
        apart = p != q
        if not apart.any():
            break
        u, v, p, q = u[apart], v[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(shorter := root[root], root):
            root = shorter
    first = (root == np.arange(a.size)).reshape(a.shape) & solid
    number = np.cumsum(first.reshape(n, -1), axis=1)
    own = number.ravel()[root].reshape(a.shape)
    return np.where(solid, own, 0), number[:, -1]


def components(neighbours: int) -> Kernel:
    """Components by number in 32..255."""

    def kernel(a: np.ndarray) -> np.ndarray:
        own, number = component_numbers(a, neighbours)
        return np.where(own > 0, 32 + own * 223 // np.maximum(1, number)[:, None, None], 0)

    return kernel


def chain_code(image: np.ndarray) -> tuple[int, int, list[int], int]:
    """(start x, start y, code, length): from the first object pixel (255), the next is looked for from direction
    (last + 5) mod 8 on, until the start is met again; length -1 without object, 0 for a lone pixel."""
    h, w = image.shape
    found = np.argwhere(image == 255)
    if not len(found):
        return -1, -1, [], -1
    start_y, start_x = (int(x) for x in found[0])
    x, y, at, code = start_x, start_y, 0, []
    while len(code) < h * w:
        for k in range(8):
            d = (at + k) % 8
            u, v = x + STEPS[d][0], y + STEPS[d][1]
            if 0 <= u < w and 0 <= v < h and image[v, u] == 255:
                break
        else:
            break
        code.append(d)
        x, y, at = u, v, (d + 5) % 8
        if (x, y) == (start_x, start_y):
            break
    return start_x, start_y, code, len(code)


def chain_image(a: np.ndarray) -> np.ndarray:
    """The image with the start of its chain at 200 and its path at 128."""

    def one(image: np.ndarray) -> np.ndarray:
        x, y, code, n = chain_code(image)
        out = image.copy()
        if n > 0:
            out[y, x] = 200
            for d in code:
                x, y = x + STEPS[d][0], y + STEPS[d][1]
                out[y, x] = 128
        return out

    return each(one)(a)


def hysteresis(low: int, high: int) -> Kernel:
    """255 from high on; what reaches low joins if one of its eight neighbours has, but not on the border."""

    def kernel(a: np.ndarray) -> np.ndarray:
        strong, weak = a >= high, (a >= low) & (a < high)
        weak[:, [0, -1]] = False
        weak[:, :, [0, -1]] = False
        while True:
            at = taps(strong.astype(np.int8), 1, "fill", 0)
            joined = weak & ~strong & np.any([at(x, y) == 1 for x, y in STEPS], axis=0)
            if not joined.any():
                return np.where(strong, 255, 0)
            strong = strong | joined

    return kernel
