"""The image row, the borders and the runner of kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray | None]
PIXELS = "array<smallint>"
SCHEMA = f"image_id long, w int, h int, v {PIXELS}"


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images: a component e becomes the grey level floor((e + 0.53) * 255), kept in 0..255."""
    level = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.53) * 255))).cast("smallint")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.transform("embedding", level).alias("v"))


def colour_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images (image_id, w, h, r, g, b) of three consecutive grey ones each; an incomplete last one is left out."""
    grey = from_embeddings(spark, sf_dir)
    plane = lambda k: F.max(F.when(F.col("image_id") % 3 == k, F.col("v")))
    rows = grey.groupBy(F.floor(F.col("image_id") / 3).cast("long").alias("id")).agg(F.first("w").alias("w"), F.first("h").alias("h"), plane(0).alias("r"), plane(1).alias("g"), plane(2).alias("b"))
    return rows.where("r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL").withColumnRenamed("id", "image_id")


def listed(images: DataFrame, column: str = "v") -> DataFrame:
    """(image_id, w, h, pixels): the grey levels as text, for comparison."""
    return images.select("image_id", "w", "h", F.array_join(F.col(column).cast("array<string>"), ",").alias("pixels"))


def whole(x: Column) -> Column:
    """A computed level as it is stored: a half added, truncated toward zero and kept in 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), (x + 0.5).cast("int")))


def store(a: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc(a + 0.5), 0, 255).astype(np.int16)


def clamp(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255).astype(np.int16)


def border_index(n: int, r: int, border: str) -> np.ndarray:
    """Where the positions -r .. n + r - 1 read: mirrored at the edge pixel and then clamped, or clamped at once."""
    i = np.arange(-r, n + r)
    if border == "mirror":
        i = np.where(i < 0, -i, i)
        i = np.where(i >= n, 2 * (n - 1) - i, i)
    return np.clip(i, 0, n - 1)


def padded(a: np.ndarray, r: int, border: str = "mirror", fill: float = 0) -> np.ndarray:
    if border == "fill":
        return np.pad(a, ((0, 0), (r, r), (r, r)), constant_values=fill)
    _, h, w = a.shape
    return a[:, border_index(h, r, border)][:, :, border_index(w, r, border)]


def taps(a: np.ndarray, r: int, border: str = "mirror", fill: float = 0) -> Callable[[int, int], np.ndarray]:
    """at(dx, dy): the image of the neighbours there."""
    p, (_, h, w) = padded(a, r, border, fill), a.shape
    return lambda dx, dy: p[:, r + dy : r + dy + h, r + dx : r + dx + w]


def correlate(a: np.ndarray, mask, border: str = "mirror") -> np.ndarray:
    """Sum of mask[dy][dx] times the neighbour there; the mask is square and odd."""
    mask = np.asarray(mask, float)
    r = len(mask) // 2
    at = taps(a, r, border)
    out = np.zeros(a.shape)
    for (j, i), m in np.ndenumerate(mask):
        if m:
            out += m * at(i - r, j - r)
    return out


#: Levels that a kernel reads or makes at a time, and that one Arrow batch takes, about.
LEVELS = 1 << 21


def in_pieces(kernel: Kernel, stack: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(first, end, result) of a kernel on runs of a stack, so short that neither a run nor its result has more than about
    LEVELS levels; a first run of one image tells how many a result has."""
    at, step = 0, 1
    while at < len(stack):
        end = min(at + step, len(stack))
        found = kernel(stack[at:end])
        yield at, end, found
        at, step = end, max(1, LEVELS // max(1, stack[0].size, 0 if found is None else found[0].size))


def run(images: DataFrame, kernel: Kernel, column: str = "v") -> DataFrame:
    """(image_id, w, h, v) with the kernel's result, images of one size in a stack; a null result or image gives null v."""

    def rows(ids: pa.Array, w, h, found: np.ndarray | None) -> pa.RecordBatch:
        n = len(ids)
        if found is None:
            lists = pa.nulls(n, pa.list_(pa.int16()))
        else:
            _, h, w = found.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (w * h), pa.int32()), pa.array(np.asarray(found, np.int16).ravel()))
        wide, high = (pa.array(np.broadcast_to(x, n), pa.int32()) for x in (w, h))
        return pa.RecordBatch.from_arrays([ids, wide, high, lists], ["image_id", "w", "h", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pixels = batch.column(0), batch.column(3)
            w, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            sizes = np.column_stack([w, h])
            valid = ~np.asarray(pixels.is_null())
            for size in np.unique(sizes[valid], axis=0):
                same = np.flatnonzero((sizes == size).all(axis=1) & valid)
                step = max(1, LEVELS // max(1, int(size[0]) * int(size[1])))
                for lo in range(0, len(same), step):
                    at = same[lo : lo + step]
                    flat = pixels.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                    for first, end, found in in_pieces(kernel, flat.astype(np.int64).reshape(len(at), size[1], size[0])):
                        yield rows(ids.take(pa.array(at[first:end])), size[0], size[1], found)
            if not valid.all():
                yield rows(ids.filter(pa.array(~valid)), w[~valid], h[~valid], None)

    return images.select(F.col("image_id").cast("long").alias("image_id"), "w", "h", F.col(column).cast(PIXELS).alias("v")).mapInArrow(work, SCHEMA)


def run_each(images: DataFrame, function: Callable[[np.ndarray], tuple], schema: str, column: str = "v") -> DataFrame:
    """(image_id, ...) with what the function returns for each image (h, w), for results that are no image."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            found = [(r["image_id"], *function(np.array(r["v"], np.int64).reshape(r["h"], r["w"]))) for r in rows if r["v"] is not None]
            yield pa.RecordBatch.from_pylist([dict(zip(["image_id", *names], x)) for x in found], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = _parse_datatype_string(f"image_id long, {schema}")
    arrow = to_arrow_schema(full)
    return images.select(F.col("image_id").cast("long").alias("image_id"), "w", "h", F.col(column).alias("v")).mapInArrow(work, full)
