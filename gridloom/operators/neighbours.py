"""Nearest neighbours on Voronoi cells, and what needs all distances by blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tile, of query tiles that a task holds, and of candidate tiles that it reads past them, at most.
ROWS, HELD, READ = 2048, 1 << 17, 1 << 20
#: Queries whose distances to a tile are made at a time.
BLOCK = 64


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            yield pa.RecordBatch.from_pydict({"ids": pa.array([ids.tobytes()], pa.binary()), "cells": pa.array([flat.tobytes()], pa.binary())})


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of the rows of a to those of b, summed column by column."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        total += np.abs(x[:, None] - y[None, :]) ** p
    return total ** (1 / p)


def _pairs(x: np.ndarray, y: np.ndarray, row: np.ndarray, column: np.ndarray, p: float) -> np.ndarray:
    """The distances of some pairs, as distances makes them."""
    total = np.zeros(len(row))
    for a, b in zip(x.T, y.T):
        total += np.abs(a[row] - b[column]) ** p
    return total ** (1 / p)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square Euclidean distances by a matrix product, and for each row of x more than what rounding can change in them."""
    own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    return own[:, None] + other - 2 * x @ y.T, 1e-9 * (own + other.max())


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """(columns, distances) of the k nearest rows of y to each of x (fewer, if there are not so many), the first of equals.

    For p >= 2 a distance of n components is at least n^(1/p - 1/2) times the Euclidean one, so the k-th of some near rows
    bounds how far the others can lie; only rows within that are measured.
    """
    k = min(k, len(y))
    if p >= 2 and len(y) > 8 * k:
        square, slack = _squares(x, y)
        head = np.argpartition(square, 8 * k - 1, axis=1)[:, : 8 * k]
        near = _pairs(x, y, np.repeat(np.arange(len(x)), 8 * k), head.ravel(), p).reshape(len(x), -1)
        reach = np.partition(near, k - 1, axis=1)[:, k - 1] * x.shape[1] ** (0.5 - 1 / p)
        row, column = np.nonzero(square <= (reach**2 * (1 + 1e-9) + slack)[:, None])
        d = _pairs(x, y, row, column, p)
        order = np.lexsort((column, d, row))
        kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        if len(kept) == k * len(x):  # not so for values that are no numbers
            return column[kept].reshape(-1, k), d[kept].reshape(-1, k)
    parts = max(1, (1 << 15) // max(1, len(x)))  # what stays in a core's cache
    d = np.concatenate([distances(x, y[at : at + parts], p) for at in range(0, len(y), parts)], axis=1)
    column = _least(d, k)[1].reshape(len(x), -1) if np.isfinite(d).all() else np.argsort(d, axis=1, kind="stable")[:, :k]
    return column, np.take_along_axis(d, column, axis=1)


def _groups(queries: int, candidates: int, cores: int) -> tuple[int, int]:
    """How many groups of query tiles and of candidate tiles meet each other. Both grow with the tables, and there are
    enough pairs of groups for all cores where there are enough tiles."""
    of_queries = max(1, ceil(queries / HELD))
    return of_queries, max(1, ceil(candidates / READ), min(ceil(candidates / ROWS), ceil(2 * cores / of_queries)))


Meet = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _meet(train: DataFrame, test: DataFrame, pair: Meet, schema: str, id_col: str, vector_col: str, wide: int = 1) -> DataFrame:
    """What pair gives of the (query ids, query vectors, ids, vectors) of each tile of test with each of train.

    A pair of groups of tiles meets in one task, which holds the query tiles, a bounded number, and reads the others.
    Vectors of test may be so many times as wide as those of train; a task holds the fewer of them then.
    """
    narrow = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    of_test, of_train = _groups(wide * test.count(), train.count(), train.sparkSession.sparkContext.defaultParallelism)
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = narrow(train).mapInArrow(_tiles, "ids binary, cells binary")
    tiles = tiles.select("ids", "cells", place(of_train).alias("s"), every(of_test).alias("q"))
    asked = narrow(test).mapInArrow(_tiles, "ids binary, cells binary")
    asked = asked.select(F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), place(of_test).alias("q"), every(of_train).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                cells, q_cells = (np.frombuffer(row[c], "<f8").reshape(len(n), -1) for c, n in (("cells", ids), ("q_cells", q_ids)))
                for at in range(0, len(q_ids), BLOCK):
                    yield from pair(q_ids[at : at + BLOCK], q_cells[at : at + BLOCK], ids, cells)

    met = tiles.join(asked.hint("shuffle_hash"), ["q", "s"])
    return met.select("ids", "cells", "q_ids", "q_cells").mapInArrow(run, schema)


#: Bytes of queries and of what is known of them that a task holds, and rows of a tile that is read past them, at most.
BYTES, PAST = 96 << 20, 32768


class Fold:
    """What a group of queries (ids, vectors) has learnt of the rows that were read past it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x

    def read(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows in the order of their ids; each row is read once."""

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _against(train: DataFrame, test: DataFrame, fold: Callable[[np.ndarray, np.ndarray], Fold], schema: str, held: int, parts: int = 1) -> DataFrame:
    """What fold gives for groups of test (id, x) after all of train (id, x), or each of so many parts of it, was read past.

    Queries are dealt to groups by a hash of their id, of about `held` rows and enough for all cores. A task holds its group
    and reads train in tiles of at most PAST rows, so its memory depends on neither table. Train travels once a group.
    """
    n = test.count()
    cores = train.sparkSession.sparkContext.defaultParallelism
    groups = max(1, ceil(n / held), min(n, ceil(2 * cores / parts)))

    def mixed(ids: np.ndarray, of: int) -> np.ndarray:
        h = (ids.astype("<i8").view("<u8") + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)).astype(np.int64) % of

    def tiled(side: int, of: int, rows: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, x = _arrays(batch)
                place = mixed(ids, of)
                order = np.lexsort((ids, place))
                ends = np.flatnonzero(np.r_[np.diff(place[order]) != 0, True]) + 1
                for at, end in zip([0, *ends[:-1]], ends):
                    for lo in range(at, end, rows):
                        some = order[lo : min(lo + rows, end)]
                        small = x[some].astype("<f4")
                        narrow_ = bool((small == x[some]).all())
                        cells_ = (small if narrow_ else x[some].astype("<f8")).tobytes()
                        columns = [[int(place[some[0]])], [side], [4 if narrow_ else 8], [ids[some].astype("<i8").tobytes()], [cells_]]
                        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "side", "bytes", "ids", "cells"])

        return run

    narrow = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    row = "g int, side int, bytes int, ids binary, cells binary"
    asked = narrow(test).mapInArrow(tiled(0, groups, PAST), row).select("*", every(parts).alias("s"))
    past = narrow(train).mapInArrow(tiled(1, parts, PAST), row).withColumnRenamed("g", "s").select("*", every(groups).alias("g"))
    place = (F.col("g") * parts + F.col("s")).alias("place")
    columns = [place, "side", "bytes", "ids", "cells"]
    dealt = asked.select(*columns).union(past.select(*columns)).repartitionById(groups * parts, F.col("place")).sortWithinPartitions("place", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, state, rest = None, [], None, []

        def flush() -> None:
            if state is not None and rest:
                ids, x = (np.concatenate(v) for v in zip(*rest))
                order = np.argsort(ids, kind="stable")
                state.read(ids[order], np.ascontiguousarray(x[order], np.float64))
            rest.clear()

        for batch in batches:
            for place_, side, width, ids, cells_ in zip(*[c.to_pylist() for c in batch.columns]):
                ids = np.frombuffer(ids, "<i8")
                x = np.frombuffer(cells_, f"<f{width}").reshape(len(ids), -1)
                if place_ != now:
                    flush()
                    if state is not None:
                        yield from state.end()
                    elif first:
                        yield from fold(*(np.concatenate(v) for v in zip(*first))).end()
                    now, first, state = place_, [], None
                if side == 0:
                    first.append((ids.astype(np.int64), x.astype(np.float64)))
                    continue
                if state is None and first:
                    state, first = fold(*(np.concatenate(v) for v in zip(*first))), []
                rest.append((ids, x))
                if sum(len(r[0]) for r in rest) >= PAST:
                    flush()
        flush()
        if state is not None:
            yield from state.end()
        elif first:
            yield from fold(*(np.concatenate(v) for v in zip(*first))).end()

    return dealt.mapInArrow(run, schema)


#: Rows for each pivot, the most pivots, and the rows of a cell that one task holds.
PER_PIVOT, PIVOTS, PART = 256, 512, 8192


@dataclass
class Cells:
    """Voronoi cells of a table around some of its rows: how many rows each has, the least and largest distance of them to
    their pivot, and the k least, inf where there are fewer."""

    pivots: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    p: float

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, the first of equally near ones, and the distances to all pivots."""
        d = distances(x, self.pivots, self.p)
        return d.argmin(axis=1), d

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that can hold one of a row's k nearest, ties included.

        A cell's rows lie within their distance to its pivot of it, so the k-th least sum of a pivot's distance and a
        row's distance to it bounds the k-th neighbour's. By the triangle inequality no row of a cell is nearer than the
        gap between the distance to its pivot and the range of the cell's own; for p = 2 nor is it nearer than the plane
        that separates the cell from the row's own.
        """
        own, d = self.of(x)
        k = self.near.shape[1]
        sums = (d[:, :, None] + self.near[None]).reshape(len(x), -1)
        reach = np.partition(sums, k - 1, axis=1)[:, k - 1]
        least = np.maximum(d - self.high, self.low - d)
        if self.p == 2:
            between = distances(self.pivots, self.pivots, 2)[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d**2 - d[np.arange(len(x)), own][:, None] ** 2) / (2 * between)
            least = np.maximum(least, np.where(between > 0, plane, 0.0))
        return np.nonzero((least <= (reach * (1 + 1e-9) + 1e-12)[:, None]) & (self.size > 0))


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch (id, x)."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.reshape(batch.num_rows, -1)


def _rows(cell: np.ndarray, part: np.ndarray, side: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
    columns = [pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(ids), side, np.int32)), pa.array(ids), lists]
    return pa.RecordBatch.from_arrays(columns, ["cell", "part", "side", "id", "x"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def cells(rows: DataFrame, k: int, p: float = 2, pivots: int | None = None) -> Cells | None:
    """The cells of rows (id, x), None of none. The pivots, the rows of the least hashes, are as many as the table asks
    for, up to PIVOTS; the driver sees them and, of each cell, its size, range and k least distances."""
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots or min(PIVOTS, ceil(n / PER_PIVOT))).collect() if n else []
    if not some:
        return None
    empty = np.zeros(len(some))
    found = Cells(np.array([r["x"] for r in some], np.float64), empty, empty, empty, np.zeros((len(some), k)), p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            own, d = found.of(_arrays(batch)[1])
            own_d = d[np.arange(len(own)), own]
            order = np.lexsort((own_d, own))
            cell, first, size = np.unique(own[order], return_index=True, return_counts=True)
            near = [own_d[order][f : f + min(k, m)].tolist() for f, m in zip(first, size)]
            high = np.maximum.reduceat(own_d[order], first)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(size), pa.array(high), pa.array(near, pa.list_(pa.float64()))], ["cell", "n", "high", "near"])

    parts = rows.mapInArrow(run, "cell int, n long, high double, near array<double>")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    least = parts.select("cell", F.explode("near").alias("d")).withColumn("rank", rank).where(F.col("rank") <= k)
    size, low, high, near = np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some)), np.full((len(some), k), np.inf)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("high").alias("high")).collect():
        size[r["cell"]], high[r["cell"]] = r["n"], r["high"]
    for r in least.collect():
        near[r["cell"], r["rank"] - 1] = r["d"]
    low = np.where(size > 0, near[:, 0], 0.0)
    return Cells(found.pivots, size, low, high, near, p)


def routed(test: DataFrame, known: Cells, part: int = PART) -> DataFrame:
    """(cell, part, side, id, x): the rows of test (id, x), once for each part of each cell that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 256):
            ids, x = _arrays(batch)
            row, cell = known.visited(x)
            parts = np.ceil(known.size[cell] / part).astype(np.int64)
            row, cell, number = np.repeat(row, parts), np.repeat(cell, parts), np.concatenate([np.arange(m) for m in parts]) if len(parts) else parts
            yield _rows(cell, number, 1, ids[row], x[row])

    return test.mapInArrow(run, "cell int, part int, side int, id long, x array<double>")


def nearest(train: DataFrame, test: DataFrame, k: int, p: float = 2, id_col: str = "id", vector_col: str = "x", pivots: int | None = None, part: int = PART) -> DataFrame:
    """(test_id, rank, train_id, distance): the k nearest rows of train to each of test, ties to the smaller id; p >= 1.

    An exact join on Voronoi cells: rows of train go to the cell of their nearest pivot, rows of test to the cells that can
    hold one of their k nearest, and no other pair is compared. Cells of more than `part` rows are dealt to tasks that
    hold so many, and each task sends k rows a query on. Vectors have one length and no missing values; rows that repeat an
    id each count. An empty table gives an empty result.
    """
    narrow = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    train, test = narrow(train), narrow(test)
    schema = "test_id long, train_id long, distance double"
    known = cells(train, k, p, pivots)
    if known is None:
        return train.sparkSession.createDataFrame([], schema + ", rank int")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            ids, x = _arrays(batch)
            cell = known.of(x)[0]
            parts = np.maximum(1, np.ceil(known.size[cell] / part)).astype(np.uint64)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            yield _rows(cell, spread % parts, 0, ids, x)

    kept = train.mapInArrow(own, "cell int, part int, side int, id long, x array<double>")
    dealt = kept.union(routed(test, known, part)).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sorted_ = None, [], None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
            for at, end in zip(starts, [*starts[1:], len(key)]):
                *place, side = key[at].tolist()
                ids, x = _arrays(batch.slice(at, end - at).select([3, 4]))
                if place != now:
                    now, held, sorted_ = place, [], None
                if side == 0:
                    held.append((ids, x))
                elif held:
                    if sorted_ is None:
                        all_ids, cells_ = (np.concatenate(v) for v in zip(*held))
                        order = np.argsort(all_ids, kind="stable")
                        sorted_ = all_ids[order], cells_[order]
                    for lo in range(0, len(ids), BLOCK):
                        near, d = nearest_rows(x[lo : lo + BLOCK], sorted_[1], k, p)
                        columns = [np.repeat(ids[lo : lo + BLOCK], near.shape[1]), sorted_[0][near].ravel(), d.ravel()]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["test_id", "train_id", "distance"])

    found = dealt.mapInArrow(run, schema)
    order = Window.partitionBy("test_id").orderBy("distance", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def summaries(train: DataFrame, test: DataFrame, p: float = 2, id_col: str = "id", vector_col: str = "x") -> DataFrame:
    """(test_id, n, lo, mean, hi) of the distances of each row of test to all rows of train of another id; a row without
    any has no summary. A pair of tiles sends one row a query on."""

    def summed(q_ids: np.ndarray, q_cells: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        d, other = distances(q_cells, cells, p), q_ids[:, None] != ids[None, :]
        n = other.sum(axis=1)
        parts = [q_ids, n, np.where(other, d, np.inf).min(axis=1), np.where(other, d, 0.0).sum(axis=1), np.where(other, d, -np.inf).max(axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(x[n > 0]) for x in parts], ["test_id", "n", "lo", "total", "hi"])

    found = _meet(train, test, summed, "test_id long, n long, lo double, total double, hi double", id_col, vector_col)
    ends = F.min("lo").alias("lo"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("hi").alias("hi")
    return found.groupBy("test_id").agg(F.sum("n").alias("n"), *ends)


def kernel(train: DataFrame, test: DataFrame, gamma: float, id_col: str = "id", vector_col: str = "x") -> DataFrame:
    """(i, j, k): exp(-gamma |x_i - x_j|^2) of each row i of test and each j of train, a row a cell."""

    def cells_of(q_ids: np.ndarray, q_cells: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = np.exp(-gamma * distances(q_cells, cells, 2) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, len(ids))), pa.array(np.tile(ids, len(q_ids))), pa.array(k.ravel())], ["i", "j", "k"])

    return _meet(train, test, cells_of, "i long, j long, k double", id_col, vector_col)


def classify(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(test_id, predicted): the most frequent label of the neighbours, the least of equals. labels: (train_id, label)."""
    votes = neighbours.join(labels, "train_id").groupBy("test_id", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("test_id").agg(F.max_by("label", F.struct("n", (-F.col("label")).alias("l"))).alias("predicted"))


def regress(neighbours: DataFrame, targets: DataFrame) -> DataFrame:
    """(test_id, predicted): mean target weighted by inverse distance; exact matches, if any, alone. targets: (train_id, y)."""
    rows = neighbours.join(targets, "train_id").withColumn("exact", F.col("distance") == 0)
    sums = rows.groupBy("test_id").agg(
        F.max("exact").alias("any_exact"),
        F.avg(F.when(F.col("exact"), F.col("y"))).alias("at"),
        F.sum(F.when(~F.col("exact"), F.col("y") / F.col("distance"))).alias("a"),
        F.sum(F.when(~F.col("exact"), 1 / F.col("distance"))).alias("b"),
    )
    return sums.select("test_id", F.when(F.col("any_exact"), F.col("at")).otherwise(F.col("a") / F.col("b")).alias("predicted"))


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least numbers of each row (fewer, if there are not so many), the first of equal ones."""
    k = min(k, d.shape[1])
    row, column = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((column, d[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def by_share(rows: DataFrame, k: int, shares: int, p: float = 2) -> DataFrame:
    """(share, test_id, rank, train_id, distance): for each share and row, the k nearest rows of other folds whose number is
    at most the share. rows: (id, x, fold, number) with numbers from 1 to shares, so shares are nested.

    One pass serves all shares: a pair of tiles sends a row that is among the k nearest of any share once, and the shares
    that hold it are told from its number after the shuffle.
    """
    tagged = rows.select("id", F.concat(F.array(F.col("fold").cast("double"), F.col("number").cast("double")), F.col("x").cast("array<double>")).alias("x"))

    def best(q_ids: np.ndarray, q_cells: np.ndarray, ids: np.ndarray, cells_: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, number, same = q_cells[:, 2:], cells_[:, 2:], cells_[:, 1], q_cells[:, :1] == cells_[:, 0]
        far, slack = (distances(x, y, p), np.zeros(len(x))) if p != 2 else _squares(x, y)
        far[same] = np.inf
        # shares are nested, so no row beyond the k-th of the least share that has k rows is among the k nearest of one
        reach = np.full(len(x), np.inf)
        for share in range(1, shares + 1):
            some = far[:, number <= share]
            if some.shape[1] >= k:
                kth = np.partition(some, k - 1, axis=1)[:, k - 1] + 2 * slack
                if np.isfinite(kth).all() or share == shares:
                    reach = kth
                    break
        q, t = np.nonzero((far <= reach[:, None]) | ((number < share) & ~same) if len(x) else far < 0)
        keep = ~same[q, t]
        q, t = q[keep], t[keep]
        d = _pairs(x, y, q, t, p)
        order = np.lexsort((ids[t], d, q))
        q, t, d = q[order], t[order], d[order]
        take = np.zeros(len(q), bool)
        for share in range(1, shares + 1):
            held = np.flatnonzero(number[t] <= share)
            take[held[np.arange(len(held)) - np.searchsorted(q[held], q[held]) < k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q_ids[q[take]], ids[t[take]], number[t[take]].astype(np.int32), d[take])], ["test_id", "train_id", "number", "distance"])

    met = _meet(tagged, tagged, best, "test_id long, train_id long, number int, distance double", "id", "x")
    each = met.withColumn("share", F.explode(F.sequence("number", F.lit(shares)))).drop("number")
    order = Window.partitionBy("share", "test_id").orderBy("distance", "train_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("share", "test_id", "rank", "train_id", "distance")


class _Exchanged(Fold):
    """The k nearest (distance, id, label) of each variant of the queries: the row as it is, and with each component taken
    from each of the others. Queries are (x, others), rows (label, x).

    A variant that takes o for x_i has square distance d + (o - x_i)(o + x_i - 2 y_i) to a row y at d from the query itself.
    With the least and largest y_i of a tile that bounds how far a row may lie from the query to be among the variant's k
    nearest; only rows within it are measured for it. Bounds come from a matrix product with a margin, distances from the
    terms themselves.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, repeats: int):
        n = x.shape[1] // (1 + repeats)
        self.ids, self.own, self.put = ids, np.ascontiguousarray(x[:, :n]), x[:, n:].reshape(len(ids), repeats, n).transpose(0, 2, 1).reshape(len(ids), -1)
        self.k, self.repeats, self.n = k, repeats, n
        shape = (len(ids), 1 + n * repeats, k)
        self.d, self.id, self.label = np.full(shape, np.inf), np.full(shape, np.iinfo(np.int64).max), np.zeros(shape, np.int32)

    def read(self, ids: np.ndarray, x: np.ndarray) -> None:
        label, y, k, r = x[:, 0].astype(np.int32), np.ascontiguousarray(x[:, 1:]), self.k, self.repeats
        ends, square, flat = (y.min(axis=0), y.max(axis=0)), (y * y).sum(axis=1), np.ascontiguousarray(y.T)

        def room(gap: np.ndarray, both: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return gap * np.maximum(np.abs(both - np.repeat(2 * lo, r)), np.abs(both - np.repeat(2 * hi, r)))

        for at in range(0, len(self.ids), BLOCK):
            own = self.own[at : at + BLOCK]
            norm = (own * own).sum(axis=1)
            near, slack = norm[:, None] + square - 2 * own @ y.T, 1e-9 * (norm + square.max())
            mine, put = np.repeat(own, r, axis=1), self.put[at : at + BLOCK]
            gap, both = np.abs(put - mine), put + mine
            for q, d in enumerate(near, at):
                left = np.arange(len(ids))
                if np.isinf(self.d[q, :, -1]).any():  # the nearest rows first, which bound the others
                    head = np.argpartition(d, min(8 * k, len(d)) - 1)[: 8 * k]
                    step = max(1, (1 << 18) // len(head))
                    for lo in range(0, self.d.shape[1], step):
                        v = np.arange(lo, min(lo + step, self.d.shape[1]))
                        self.measure(q, np.repeat(v, len(head)), np.tile(head, len(v)), ids, label, y)
                    left = np.delete(left, head)
                known, b = self.d[q, :, -1] + slack[q - at], q - at
                reach = known + np.r_[0.0, room(gap[b], both[b], *ends)]
                left = left[d[left] <= reach.max()]
                if not len(left):
                    continue
                left = left[np.argsort(d[left])]
                count, least = np.searchsorted(d[left], reach, "right"), 0
                change, shift = np.r_[0.0, (put - mine)[b]], np.r_[0.0, both[b]]
                first, found, waiting = np.ascontiguousarray(y[left[:2048]].T), [], 0
                for most in [*(1 << np.arange(3, 12)), len(left)]:
                    some = np.flatnonzero((count > least) & (count <= most))
                    step = max(1, (1 << 16) // int(most)) if most <= 2048 else 1
                    for v in (some[lo : lo + step] for lo in range(0, len(some), step)):
                        rows, i = left[: count[v].max()], np.maximum(v - 1, 0) // r
                        far = first[:, : len(rows)][i] if most <= 2048 else flat[i[0]][rows][None]
                        far = d[rows] + change[v][:, None] * (shift[v][:, None] - 2 * far)
                        row, column = np.nonzero(far <= known[v][:, None])
                        found.append((v[row], rows[column]))
                        waiting += len(row)
                        if waiting >= 1 << 18:
                            self.measure(q, *map(np.concatenate, zip(*found)), ids, label, y)
                            found, waiting = [], 0
                    least = max(least, most)
                if waiting:
                    self.measure(q, *map(np.concatenate, zip(*found)), ids, label, y)

    def measure(self, q: int, variants: np.ndarray, rows: np.ndarray, ids: np.ndarray, label: np.ndarray, y: np.ndarray) -> None:
        """Pairs of a variant and a row, with their distances from the terms."""
        once, at = np.unique(rows, return_inverse=True)
        terms = (self.own[q] - y[once]) ** 2
        i, some = np.maximum(variants - 1, 0), variants > 0
        d = terms.sum(axis=1)[at]
        d[some] = (d - terms[at, i // self.repeats] + (self.put[q, i] - y[rows, i // self.repeats]) ** 2)[some]
        self.merge(q, variants, d, ids[rows], label[rows])

    def merge(self, q: int, variants: np.ndarray, d: np.ndarray, ids: np.ndarray, label: np.ndarray) -> None:
        k, hit = self.k, np.unique(variants)
        v = np.concatenate([np.repeat(hit, k), variants])
        all_d, all_id, all_label = (np.concatenate([a[q, hit].ravel(), b]) for a, b in ((self.d, d), (self.id, ids), (self.label, label)))
        order = np.lexsort((all_id, all_d, v))
        v = v[order]
        kept = order[np.arange(len(v)) - np.searchsorted(v, v) < k]
        for mine, new in ((self.d, all_d), (self.id, all_id), (self.label, all_label)):
            mine[q, hit] = new[kept].reshape(-1, k)

    def end(self) -> Iterator[pa.RecordBatch]:
        variants = np.arange(self.d.shape[1]) - 1
        feature = np.where(variants < 0, -1, variants // self.repeats).astype(np.int32)
        repeat = np.where(variants < 0, -1, variants % self.repeats).astype(np.int32)
        for at in range(0, len(self.ids), BLOCK):
            label, known = self.label[at : at + BLOCK], self.d[at : at + BLOCK] < np.inf
            votes = ((label[..., :, None] == label[..., None, :]) & known[..., None, :]).sum(axis=-1) * known
            best = np.where(known & (votes == votes.max(axis=-1, keepdims=True)), label, np.iinfo(np.int32).max).min(axis=-1)
            q, v = np.nonzero(known.any(axis=-1))
            columns = [self.ids[at + q], feature[v], repeat[v], best[q, v].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["test_id", "feature", "repeat", "predicted"])


def exchanged(train: DataFrame, test: DataFrame, k: int, repeats: int) -> DataFrame:
    """(test_id, feature, repeat, predicted): the label that the k nearest rows vote for if a row of test takes one component
    from another row; feature and repeat are -1 for the row as it is. The least label of equals, ties to the smaller id.

    train: (id, x, label), test: (id, x, others) with a vector for each repeat. Euclidean, and exact; a task holds a group of
    queries with the k nearest rows of each variant, and reads all of train past it. Labels are whole numbers.
    """
    marked = train.select("id", F.concat(F.array(F.col("label").cast("double")), F.col("x").cast("array<double>")).alias("x"))
    asked = test.select("id", F.concat(F.col("x").cast("array<double>"), F.flatten(F.col("others").cast("array<array<double>>"))).alias("x"))
    width = asked.agg(F.max(F.size("x"))).first()[0] or 1
    held = max(16, BYTES // (width * (20 * k + 8)))
    return _against(marked, asked, lambda ids, x: _Exchanged(ids, x, k, repeats), "test_id long, feature int, repeat int, predicted int", held)
