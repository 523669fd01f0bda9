"""Correlations of many columns from blocks of rows: the work grows with the pairs, the plan does not."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, columns of a strip, and strips that one task merges, at most.
ROWS, STRIP, MERGE = 4096, 64, 16
PART = "strip int, part long, moments binary"


def moments(x: np.ndarray) -> np.ndarray:
    """(6, columns, columns): of each pair of columns a and b, over the rows where neither is missing (NaN), the count, both
    means, both sums of squares about them and the sum of products about them.

    Columns are shifted by their mean before products are summed. Where a column hardly varies over the rows of a pair, the
    sums are made from its values themselves, so a constant one has a sum of exactly 0.
    """
    known = ~np.isnan(x)
    m = known.astype(float)
    shift = np.where(known, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    z = np.where(known, x - shift, 0.0)
    n, squares = m.T @ m, (z**2).T @ m
    mean = (z.T @ m) / np.maximum(n, 1)
    about, products = squares - n * mean**2, z.T @ z - n * mean * mean.T
    level = mean + shift[:, None]
    for a, b in np.argwhere((n > 0) & (about <= 1e-6 * np.maximum((z**2).sum(axis=0)[:, None], n * shift[:, None] ** 2))):
        both = known[:, a] & known[:, b]
        u, v = x[both, a], x[both, b]
        level[a, b] = u[0] if (u == u[0]).all() else u.mean()
        about[a, b] = ((u - level[a, b]) ** 2).sum()
        products[a, b] = products[b, a] = ((u - level[a, b]) * (v - v.mean())).sum()
    return np.stack([n, level, level.T, about, about.T, products])


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The moments of two blocks together."""
    n = one[0] + two[0]
    share = two[0] / np.maximum(n, 1)
    both = one[0] * two[0] > 0
    a, b = np.where(both, two[1] - one[1], 0.0), np.where(both, two[2] - one[2], 0.0)
    weight = one[0] * share
    means = [np.where(one[0] > 0, one[i] + step * share, two[i]) for i, step in ((1, a), (2, b))]
    return np.stack([n, *means, one[3] + two[3] + a * a * weight, one[4] + two[4] + b * b * weight, one[5] + two[5] + a * b * weight])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns in their order, rows where one is null left out; null where r has no value: no
    such rows, a constant column, or a value that is NaN or infinite on the pair's rows. A table
    without rows has no pairs.

    A task sums its blocks of rows and gives one strip a STRIP of columns; strips are merged so many at a time, in rounds
    until one is left of each, and pairs are made from strips. Nothing passes through the driver but the names.
    """
    c = len(columns)
    if c < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    strips = ceil(c / STRIP)

    def block(batch: pa.RecordBatch) -> np.ndarray:
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(c)], axis=1)
        null = np.stack([batch.column(i).is_null().to_numpy(zero_copy_only=False) for i in range(c)], axis=1)
        broken = ~np.isfinite(x) & ~null
        found = moments(np.where(null, np.nan, np.where(broken, 0.0, x)))
        if broken.any():
            spoilt = broken.T.astype(float) @ (~null).astype(float)
            found[3:][:, (spoilt > 0) | (spoilt.T > 0)] = np.nan  # stays NaN in every merge
        return found

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                one = block(batch.slice(at, ROWS))
                total = one if total is None else merged(total, one)
        if total is not None:
            cut = [total[:, s * STRIP : (s + 1) * STRIP].tobytes() for s in range(strips)]
            yield pa.RecordBatch.from_arrays([pa.array(range(strips), pa.int32()), pa.array(cut, pa.binary())], ["strip", "moments"])

    def shaped(data: bytes) -> np.ndarray:
        return np.frombuffer(data).reshape(6, -1, c)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(merged, [shaped(data) for data in pdf["moments"]])
        return pd.DataFrame({"strip": [pdf["strip"].iloc[0]], "part": [pdf["part"].iloc[0] // MERGE], "moments": [total.tobytes()]})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, _, _, aa, bb, ab = shaped(row["moments"])
                for k in range(len(n)):
                    at = row["strip"] * STRIP + k
                    has = (n[k] > 0) & (aa[k] > 0) & (bb[k] > 0)  # not so where a sum is NaN
                    r = np.clip(ab[k] / np.sqrt(np.where(has, aa[k], 1.0)) / np.sqrt(np.where(has, bb[k], 1.0)), -1, 1)
                    later = slice(at + 1, c)
                    yield pa.RecordBatch.from_arrays([pa.array([columns[at]] * (c - at - 1), pa.string()), pa.array(columns[later], pa.string()), pa.array(r[later], mask=~has[later])], ["a", "b", "r"])

    rows = df.select(*[F.col(f"`{name}`").cast("double").alias(f"c{i}") for i, name in enumerate(columns)])
    parts = rows.mapInArrow(summed, "strip int, moments binary").select("strip", F.spark_partition_id().cast("long").alias("part"), "moments")
    tasks = rows.rdd.getNumPartitions()
    while tasks > MERGE:
        parts = parts.groupBy("strip", F.floor(F.col("part") / MERGE)).applyInPandas(together, PART)
        tasks = ceil(tasks / MERGE)
    return parts.groupBy("strip").applyInPandas(together, PART).mapInArrow(pairs, "a string, b string, r double")
