"""Point, histogram and arithmetic operators as Column expressions over an array of grey levels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.raster.image import PIXELS, clamp, store, taps, whole

Level = Callable[[Column], Column]


def mapped(v: Column, level: Level) -> Column:
    return F.transform(v, level).cast(PIXELS)


def invert(v: Column) -> Column:
    return mapped(v, lambda x: 255 - x)


def threshold(v: Column, level: int) -> Column:
    return mapped(v, lambda x: F.when(x >= level, 255).otherwise(0))


def saturate(v: Column, low: int, high: int) -> Column:
    """Up to low (inclusive) 0, from high 255, linear between."""
    return mapped(v, lambda x: F.when(x <= low, 0).when(x >= high, 255).otherwise(whole(255.0 * (x - low) / (high - low))))


def piecewise(v: Column, low: int, high: int, level: int) -> Column:
    """[0, low] goes to [0, level], [low, high] to [level, 255], the rest to 255."""
    dark = lambda x: whole(F.lit(float(level)) * x / low) if low > 0 else F.lit(0)
    middle = lambda x: whole(level + F.lit(float(255 - level)) * (x - low) / (high - low)) if high > low else F.lit(255)
    return mapped(v, lambda x: F.when(x <= low, dark(x)).when(x <= high, middle(x)).otherwise(255))


def gamma(v: Column, g: float) -> Column:
    """255 (x / 255)^(1/g): above 1 brightens; not positive counts as 1."""
    table = np.trunc(255 * (np.arange(256) / 255) ** (1 / (g if g > 0 else 1.0)) + 0.5).astype(int)
    lut = F.array(*[F.lit(int(x)) for x in table])
    return mapped(v, lambda x: F.get(lut, x.cast("int")))


def scale(v: Column, ratio: float) -> Column:
    return mapped(v, lambda x: whole(x * F.lit(float(ratio))))


def stretch(v: Column) -> Column:
    """The levels from the least to the largest spread over 0..255; a flat image becomes 0."""
    low, high = F.array_min(v), F.array_max(v)
    return mapped(v, lambda x: F.when(high > low, whole(F.lit(255.0) * (x - low) / (high - low))).otherwise(0))


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Null where the images differ in the number of pixels."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f).cast(PIXELS))


def add(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: F.least(F.lit(255), x.cast("int") + y))


def subtract(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: F.greatest(F.lit(0), x.cast("int") - y))


def multiply(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: F.floor(x.cast("int") * y / 255).cast("int"))


def blend(a: Column, b: Column, alpha: float) -> Column:
    return pairwise(a, b, lambda x, y: whole(F.lit(float(alpha)) * x + F.lit(1.0 - alpha) * y))


def bit_and(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x.bitwiseAND(y))


def bit_or(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x.bitwiseOR(y))


def bit_xor(a: Column, b: Column) -> Column:
    return pairwise(a, b, lambda x, y: x.bitwiseXOR(y))


def bit_not(v: Column) -> Column:
    return mapped(v, lambda x: F.bitwise_not(x).bitwiseAND(F.lit(255).cast("smallint")))


def not_and(a: Column, b: Column) -> Column:
    """NOT a AND b: what is in b only."""
    return pairwise(a, b, lambda x, y: F.bitwise_not(x).bitwiseAND(y).bitwiseAND(F.lit(255).cast("smallint")))


def luminance(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(v)


def contrast_deviation(v: Column) -> Column:
    """Population standard deviation, from exact integer sums."""
    n = F.size(v)
    total = F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x)
    squares = F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    return F.sqrt((n * squares - total * total).cast("double")) / n


def contrast_range(v: Column) -> Column:
    """(max - min) / (max + min), 0 for a black image."""
    low, high = F.array_min(v).cast("double"), F.array_max(v)
    return F.coalesce(F.try_divide(high - low, high + low), F.lit(0.0))


def row_profile(v: Column, w: Column, h: Column, y: int) -> Column:
    line = F.greatest(F.lit(0), F.least(F.lit(y), h - 1))
    return F.slice(v, line * w + 1, w)


def column_profile(v: Column, w: Column, h: Column, x: int) -> Column:
    place = F.greatest(F.lit(0), F.least(F.lit(x), w - 1))
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.get(v, y * w + place))


def to_grey(r: Column, g: Column, b: Column) -> Column:
    """0.299 R + 0.587 G + 0.114 B."""
    triples = F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))
    return F.transform(triples, lambda p: whole(0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"])).cast(PIXELS)


def histogram(images: DataFrame) -> DataFrame:
    """(image_id, level, n) of the 256 levels, those without pixels too."""
    counts = images.select("image_id", F.explode("v").alias("level")).groupBy("image_id", "level").agg(F.count("*").alias("n"))
    every = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(255)).cast(PIXELS)).alias("level"))
    return every.join(counts, ["image_id", "level"], "left").select("image_id", F.col("level").cast("int").alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


def level_counts(a: np.ndarray) -> np.ndarray:
    """Histograms of a stack, a row of 256 per image."""
    n = len(a)
    keys = (np.arange(n)[:, None] * 256 + a.reshape(n, -1)).ravel()
    return np.bincount(keys, minlength=256 * n).reshape(n, 256)


def equalize(a: np.ndarray) -> np.ndarray:
    """Each level by its share of pixels not above it."""
    counts = level_counts(a)
    share = np.cumsum(counts, axis=1) / a[0].size
    table = store(share * 255)
    return np.take_along_axis(table, a.reshape(len(a), -1), axis=1).reshape(a.shape)


def equalize_local(window: int):
    """Each pixel by the share of its window, clamped at the border, that is not above it."""
    r = window // 2

    def kernel(a: np.ndarray) -> np.ndarray:
        at = taps(a, r, "clamp")
        below = sum((at(i, j) <= a).astype(np.int64) for j in range(-r, r + 1) for i in range(-r, r + 1))
        return store(below / (2 * r + 1) ** 2 * 255.0)

    return kernel


def _sources(n: int, factor: float) -> tuple[int, np.ndarray]:
    size = int(n * factor + 0.5)
    return size, np.arange(size) / factor


def zoom_nearest(fx: float, fy: float):
    def kernel(a: np.ndarray) -> np.ndarray:
        _, h, w = a.shape
        x, y = (np.clip((s + 0.5).astype(int), 0, n - 1) for n, (_, s) in ((w, _sources(w, fx)), (h, _sources(h, fy))))
        return clamp(a[:, y][:, :, x])

    return kernel


def _bilinear(a: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    _, h, w = a.shape
    x, y = xs.astype(int), ys.astype(int)
    tx, ty = (xs - x)[None, None, :], (ys - y)[None, :, None]
    pick = lambda dx, dy: a[:, np.clip(y + dy, 0, h - 1)][:, :, np.clip(x + dx, 0, w - 1)]
    return store((1 - tx) * (1 - ty) * pick(0, 0) + tx * (1 - ty) * pick(1, 0) + (1 - tx) * ty * pick(0, 1) + tx * ty * pick(1, 1))


def zoom_bilinear(fx: float, fy: float):
    return lambda a: _bilinear(a, _sources(a.shape[2], fx)[1], _sources(a.shape[1], fy)[1])


def resize(width: int, height: int):
    """Bilinear, to a size."""
    return lambda a: _bilinear(a, np.arange(width) / (width / a.shape[2]), np.arange(height) / (height / a.shape[1]))


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of four neighbours for the Catmull-Rom spline at t."""
    return [(-t + 2 * t**2 - t**3) / 2, (2 - 5 * t**2 + 3 * t**3) / 2, (t + 4 * t**2 - 3 * t**3) / 2, (t**3 - t**2) / 2]


def zoom_bicubic(fx: float, fy: float):
    def kernel(a: np.ndarray) -> np.ndarray:
        _, h, w = a.shape
        xs, ys = _sources(w, fx)[1], _sources(h, fy)[1]
        x, y = xs.astype(int), ys.astype(int)
        wide = sum(k[None, None, :] * a[:, :, np.clip(x + d, 0, w - 1)] for d, k in zip((-1, 0, 1, 2), _cubic(xs - x)))
        return store(sum(k[None, :, None] * wide[:, np.clip(y + d, 0, h - 1)] for d, k in zip((-1, 0, 1, 2), _cubic(ys - y))))

    return kernel
