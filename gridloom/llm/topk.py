"""Operator 2: exact top-k search by tiled matrix products and a tree of merges of top lists."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import spool

#: The most rows and bytes of a tile.
QUERY_ROWS, SHARD_ROWS, TILE_BYTES = 1024, 8192, 4 << 20
#: The most bytes of query tiles that a task holds while it reads shard tiles.
HELD_BYTES = 64 << 20
#: Bytes of shard tiles that a group of them has at most, unless one tile is larger.
GROUP_BYTES = 1 << 30
#: Top lists that one step of the tree merges.
FAN = 16


def _packed(batches: Iterator[pa.RecordBatch], rows: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Vectors of one partition as matrices of one width, of at most so many rows and TILE_BYTES: (dim, n, kind, ids,
    cells), the cells in the smallest of the kinds i2, i4 and f8 that holds them."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, cells = (np.concatenate(x) for x in zip(*parts))
        largest = np.abs(cells).max(initial=0)
        kind = "i2" if largest < 1 << 15 else "i4" if largest < 1 << 31 else "f8"
        row = {"dim": [dim], "n": [len(ids)], "kind": [kind], "ids": [ids.astype("<i8").tobytes()], "cells": [cells.astype(f"<{kind}").tobytes()]}
        kinds = {"dim": pa.int32(), "n": pa.int32(), "kind": pa.string(), "ids": pa.binary(), "cells": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array(row[c], t) for c, t in kinds.items()})

    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        dims = np.diff(lists.offsets.to_numpy())
        flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
        whole = np.r_[0, np.cumsum(dims)]
        key = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        for dim in np.unique(dims):
            most = max(1, min(rows, TILE_BYTES // (8 * max(1, int(dim)))))
            at = np.flatnonzero(dims == dim)
            cells = np.floor(scale * flat[whole[at][:, None] + np.arange(dim)])
            parts = waiting.setdefault(int(dim), [])
            for lo in range(0, len(at), most):
                parts.append((key[at[lo : lo + most]], cells[lo : lo + most]))
                if sum(len(p[0]) for p in parts) > most:
                    last = parts.pop()
                    yield out(int(dim), parts)
                    parts[:] = [last]
    for dim, parts in waiting.items():
        if parts:
            yield out(dim, parts)


def _groups(query_bytes: int, shard_bytes: int, shard_tiles: int, cores: int) -> tuple[int, int]:
    """How many groups of query tiles and of shard tiles meet each other: as few as the bytes of a group allow, which
    keeps the copies few, but enough pairs of groups for all cores. Both grow with the tables."""
    queries, shards = max(1, ceil(query_bytes / HELD_BYTES)), max(1, ceil(shard_bytes / GROUP_BYTES))
    return queries, max(shards, min(shard_tiles, ceil(2 * cores / queries)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS, groups: tuple[int, int] | None = None, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product, ties to the smaller id.

    Components x become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows without
    id, take no part; vectors of different lengths are not compared, and those of length zero score zero with each
    other; a query meets every row but those of its own id. Equal rows are each a candidate. An empty table gives an
    empty result. The products are exact: in doubles while they stay below 2^53, in integers above.

    Tiles of queries and of shards are dealt to groups, and every pair of groups to one task. It holds the query tiles,
    a bounded number of bytes, reads the shard tiles one by one and keeps a list of k for each query. Lists are then
    merged `fan` at a time, by groups of shards, until one is left.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    schema = "dim int, n int, kind string, ids binary, cells binary"
    tiles, _ = spool(usable(queries).mapInArrow(lambda b: _packed(b, query_rows, scale), schema), "queries")
    shards, _ = spool(usable(vectors).mapInArrow(lambda b: _packed(b, shard_rows, scale), schema), "shards")
    size = F.coalesce(F.sum(F.octet_length("cells") + F.octet_length("ids")), F.lit(0))
    (query_bytes,), (shard_bytes, shard_tiles) = tiles.agg(size).first(), shards.agg(size, F.count("*")).first()
    of_queries, of_shards = groups or _groups(query_bytes, shard_bytes, shard_tiles, spark.sparkContext.defaultParallelism)

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    place = F.xxhash64("ids", "dim")
    held = tiles.select("*", F.lit(0).alias("side"), F.pmod(place, F.lit(of_queries)).cast("int").alias("q"), numbers(of_shards).alias("s"))
    read = shards.select("*", F.lit(1).alias("side"), numbers(of_queries).alias("q"), F.pmod(place, F.lit(of_shards)).cast("int").alias("s"))
    columns = ["dim", "q", "s", "side", "n", "kind", "ids", "cells"]
    dealt = held.select(columns).union(read.select(columns))
    dealt = dealt.repartition(min(of_queries * of_shards, 1 << 16), "dim", "q", "s").sortWithinPartitions("dim", "q", "s", "side")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(columns)}
                if (key := (row["dim"], row["q"], row["s"])) != now:
                    yield from (x for b in best for x in b.out(now[2]))
                    now, best = key, []
                ids, cells = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["cells"], f"<{row['kind']}").reshape(row["n"], row["dim"])
                if row["side"] == 0:
                    best.append(Best(ids, cells, k))
                else:
                    order = np.argsort(ids, kind="stable")
                    for b in best:
                        b.meet(ids[order], cells[order])
        yield from (x for b in best for x in b.out(now[2]))

    lists = dealt.mapInArrow(meet, "query_id long, node int, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    while of_shards > fan:
        of_shards = ceil(of_shards / fan)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "node").orderBy(*order)))
        lists = ranked.where(F.col("rank") <= k).select("query_id", "node", "vec_id", "score")
    last = Window.partitionBy("query_id").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best of all shard tiles so far, for the queries of one tile."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, k: int):
        self.ids, self.cells, self.k = ids, cells, k
        self.largest = float(np.abs(cells.astype(np.float64)).max(initial=0))
        self.query, self.vec, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def meet(self, ids: np.ndarray, cells: np.ndarray) -> None:
        """A shard tile in the order of its ids."""
        kind = np.float64 if (self.largest * np.abs(cells.astype(np.float64)).max(initial=0) or 1.0) * max(1, cells.shape[1]) < 2.0**53 else np.int64
        across = cells.astype(kind).T
        found = [(self.query, self.vec, self.score)]
        for lo in range(0, len(self.ids), 256):
            score = (self.cells[lo : lo + 256].astype(kind) @ across).astype(np.int64)
            i, j = self._select(score, ids, self.ids[lo : lo + 256])
            found.append((lo + i, ids[j], score[i, j]))
        query, vec, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        keep = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]

    def _select(self, score: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each row's k best: all above its k-th score, then those equal to it, the smallest ids first."""
        allowed = ids[None, :] != queries[:, None]
        score[~allowed] = np.iinfo(np.int64).min
        take = min(self.k, len(ids))
        bar = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
        above, equal = score > bar[:, None], score == bar[:, None]
        room = take - above.sum(axis=1)
        return np.nonzero((above | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))) & allowed)

    def out(self, node: int) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(self.ids[self.query]), pa.array(np.full(len(self.vec), node, np.int32)), pa.array(self.vec), pa.array(self.score)]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "node", "vec_id", "score"])
