"""Operator 11: ranked lexical search on K2-treaps, compressed quadtrees over grids of terms and documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import spool

#: The most documents and postings of a grid, unless one document has more.
GRID_DOCS, GRID_POSTINGS = 8192, 1 << 21
#: Bytes of items that a task holds while it reads grids; below it, items are broadcast.
HELD_BYTES = 16 << 20
#: Top lists that one step of the tree merges.
FAN = 16
#: Document ranges that are opened at once.
OPENED = 128
#: A term, for SQL; bytes that are no part of one become spaces, A to Z small letters. All of UTF-8 beyond ASCII is kept.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_PLAIN = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: The same with one letter for all that is kept.
_MARKS = bytes(32 if c == 32 else 97 for c in _PLAIN)
#: Children of a cell below a quadrant, by its mask: the number of bits set.
_BITS = np.array([bin(m).count("1") for m in range(16)], np.int32)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def size_of(text: bytes) -> int:
    """The number of its terms."""
    marks = text.translate(_MARKS)
    return marks.count(b" a") + marks.startswith(b"a")


def totals(texts: DataFrame) -> tuple[int, int]:
    """How many texts, the only column, have terms, and how many terms they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [size_of(x.as_py() or b"") for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"docs": [sum(n > 0 for n in sizes)], "terms": [sum(sizes)]})

    sums = texts.select(F.col(texts.columns[0]).cast("binary")).mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return sums[0] or 0, sums[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What an occurrence count adds per unit of weight, in a document of n terms, docs and terms being the corpus's sums."""
    m = 75 + (25 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Each bit of x, at most 16 of them, at twice its place."""
    x = x.astype(np.int64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = (x | (x << shift)) & mask
    return x


@dataclass
class Treap:
    """Squares of 2^depth rows by 2^depth columns, one above the other, as quadtrees in the order of levels.

    A cell has the largest value below it and a mask of its four quadrants that hold points; the children of all cells
    follow each other in the order of their parents, so a child's place is a running sum of mask bits. A cell of a single
    point is not divided: it has mask 0, and the point's row and column stand in the order of such cells.
    """

    depth: int
    mask: np.ndarray
    value: np.ndarray
    row: np.ndarray
    column: np.ndarray

    @classmethod
    def build(cls, row: np.ndarray, column: np.ndarray, value: np.ndarray, depth: int) -> Treap:
        """Of distinct points; every square up to the last must have one."""
        code = ((row.astype(np.int64) >> depth) << 2 * depth) | (_spread(row & ((1 << depth) - 1)) << 1) | _spread(column)
        order = np.argsort(code)
        code, row, column, value = code[order], row[order], column[order], value[order]
        masks, values, rows, columns = [], [], [], []
        for level in range(depth + 1):
            cell = code >> 2 * (depth - level)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
            count = np.diff(np.r_[first, len(cell)])
            values.append(np.maximum.reduceat(value, first) if len(first) else value[:0])
            alone = count == 1
            mask = np.zeros(len(first), np.uint8)
            rows.append(row[first[alone]])
            columns.append(column[first[alone]])
            left = np.repeat(~alone, count)
            if left.any():
                quadrant = (code >> 2 * (depth - level - 1)) & 3
                mask = np.bitwise_or.reduceat((1 << quadrant).astype(np.uint8), first)
                mask[alone] = 0
            masks.append(mask)
            code, row, column, value = code[left], row[left], column[left], value[left]
        return cls(depth, *(np.concatenate(x) for x in (masks, values, rows, columns)))

    def packed(self) -> bytes:
        parts = [self.mask, self.value.astype("<i4"), self.row.astype("<i4"), self.column.astype("<u2")]
        return zlib.compress(b"".join(p.tobytes() for p in parts), 1)

    @classmethod
    def unpacked(cls, data: bytes, depth: int, cells: int, points: int) -> Treap:
        data, at, out = zlib.decompress(data), 0, []
        for kind, n in (("u1", cells), ("<i4", cells), ("<i4", points), ("<u2", points)):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        return cls(depth, *out)

    def opened(self) -> Treap:
        """Ready for descents: each cell's four children, which for a single point's cell are itself, and that point's row
        and column in one number (-1 for other cells). The last cell stands for none."""
        none = len(self.mask)
        roots = none - int(_BITS[self.mask].sum())
        self.none, self.largest = np.int32(none), int(self.value.max(initial=0))
        child, alone = np.full((none + 1, 4), none, np.int32), np.flatnonzero(self.mask == 0)
        child[:-1][((self.mask[:, None] >> np.arange(4, dtype=np.uint8)) & 1) == 1] = np.arange(roots, none, dtype=np.int32)
        child[alone] = alone[:, None]
        self.child, self.own = child.ravel(), np.full(none + 1, -1, np.int64)
        self.own[alone] = (self.row.astype(np.int64) << 16) | self.column
        self.most = np.r_[self.value, 0].astype(np.float64)
        return self

    def _bounds(self, cell: np.ndarray, point: np.ndarray, size: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of ranges of so many columns, and the sums of what they have at most. point: the row and the range's
        first column in one number; cells of a single point elsewhere are none."""
        cell = np.where((self.own[cell] ^ point) >= size, self.none, cell)
        return cell, (self.most[cell].astype(weights.dtype, copy=False) @ weights).astype(np.int64)

    def top(self, rows: np.ndarray, weights: np.ndarray, best: Best, ids: Ids) -> None:
        """Bring the columns of the largest sums of weights * values over the rows into best.

        The paths of all rows go down together, by ranges of columns: the sum of what the rows' cells have at most is a
        bound for each column of the range. The ranges of the largest bounds are opened first, OPENED at a time; those
        that cannot enter the list are left.
        """
        exact = np.float64 if int(weights.sum()) * self.largest < 1 << 53 else np.int64
        of_row, rows, weights = rows.astype(np.int64) << 16, rows.astype(np.int32), weights.astype(exact)
        cell, bound = self._bounds((rows >> self.depth)[None, :], of_row, 1 << self.depth, weights)
        level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(bound):
            keep = best.may_enter(bound, place << (self.depth - level), ids)
            bound, level, place, cell = bound[keep], level[keep], place[keep], cell[keep]
            if not len(bound):
                return
            if len(bound) > OPENED:
                chosen = np.zeros(len(bound), bool)
                chosen[np.argpartition(-bound, OPENED)[:OPENED]] = True
            else:
                chosen = np.ones(len(bound), bool)
            done = chosen & (level == self.depth)
            if done.any():
                best.add(bound[done], place[done], ids)
            going = chosen & ~done
            under, half = level[going] + 1, 2 * place[going]
            shift = (self.depth - under)[:, None]
            below = 4 * cell[going] + 2 * ((rows >> shift.astype(np.int32)) & 1)
            start = of_row | (half[:, None] << shift)
            parts = [(bound[~chosen], level[~chosen], place[~chosen], cell[~chosen])]
            for right in (0, 1):
                child, most = self._bounds(self.child[below + right], start + (right << shift), 1 << shift, weights)
                parts.append((most, under, half + right, child))
            bound, level, place, cell = (np.concatenate(x) for x in zip(*parts))


@dataclass
class Ids:
    """The ids of a grid's columns, in their order; the last `nulls` have none."""

    ids: np.ndarray
    nulls: int

    def at(self, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the column has no id, and its id."""
        column = np.minimum(column, len(self.ids) - 1)
        return column >= len(self.ids) - self.nulls, self.ids[column]


class Best:
    """The k best documents of an item so far: largest scores first, then smallest ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.null, self.id = k, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def may_enter(self, bound: np.ndarray, column: np.ndarray, ids: Ids) -> np.ndarray:
        """column: the first one of each range, which has its smallest id."""
        if len(self.score) < self.k:
            return bound > 0
        null, first = ids.at(column)
        before = (null < self.null[-1]) | ((null == self.null[-1]) & (first < self.id[-1]))
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & before)

    def add(self, score: np.ndarray, column: np.ndarray, ids: Ids) -> None:
        real = column < len(ids.ids)
        null, i = ids.at(column[real])
        score, null, i = np.r_[self.score, score[real]], np.r_[self.null, null], np.r_[self.id, i]
        order = np.lexsort((i, null, -score))[: self.k]
        self.score, self.null, self.id = score[order], null[order], i[order]


_INDEX = "depth int, docs int, nulls int, cells int, points int, ids binary, terms binary, dfs binary, treap binary"


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grid_docs: int = GRID_DOCS, grid_postings: int = GRID_POSTINGS) -> tuple[DataFrame, int, int]:
    """The grids of all documents, as a written table, and the numbers of documents with terms and of their terms.

    A grid has the documents of one part of the table as columns, in the order of their ids, and all their terms as rows,
    the most frequent first. Documents without terms are in no grid. The corpus's sums, on which impacts depend, come
    from a first pass without a shuffle.
    """
    text = F.col(text_col)
    n_docs, n_terms = totals(docs.select(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Grid()
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(raw.as_py() or b"")
                if not terms:
                    continue
                counts = Counter(terms)
                if now.ids and (len(now.ids) == grid_docs or now.postings + len(counts) > grid_postings):
                    yield now.out(n_docs, n_terms)
                    now = Grid()
                now.add(doc, counts, len(terms))
        if now.ids:
            yield now.out(n_docs, n_terms)

    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"))
    table, _ = spool(plain.mapInArrow(run, _INDEX), "grids")
    return table, n_docs, n_terms


class Grid:
    """The documents of a grid while it is filled."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc: int | None, counts: Counter, size: int) -> None:
        number = self.vocabulary.setdefault
        self.ids.append(doc)
        self.sizes.append(size)
        self.rows.append(np.array([number(t, len(self.vocabulary)) for t in counts], np.int32))
        self.counts.append(np.array(list(counts.values()), np.int32))
        self.postings += len(counts)

    def out(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        docs = len(self.ids)
        order = sorted(range(docs), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        row, tf = (np.concatenate([x[i] for i in order]).astype(np.int64) for x in (self.rows, self.counts))
        column = np.repeat(np.arange(docs), [len(self.rows[i]) for i in order])
        size = np.array([self.sizes[i] for i in order], np.int64)[column]
        df = np.bincount(row, minlength=len(self.vocabulary))
        by_df = np.argsort(-df, kind="stable")
        place = np.empty(len(by_df), np.int64)
        place[by_df] = np.arange(len(by_df))
        depth = max(1, (docs - 1).bit_length())
        treap = Treap.build(place[row], column, impacts(tf, size, n_docs, n_terms), depth)
        terms = list(self.vocabulary)
        out = {"depth": depth, "docs": docs, "nulls": sum(i is None for i in self.ids), "cells": len(treap.mask), "points": len(treap.row), "ids": np.array([self.ids[i] or 0 for i in order], "<i8").tobytes()}
        out |= {"terms": zlib.compress(b" ".join(terms[i] for i in by_df), 1), "dfs": zlib.compress(df[by_df].astype("<i4").tobytes(), 1), "treap": treap.packed()}
        return pa.RecordBatch.from_pylist([out], schema=pa.schema([(c, pa.int32() if t == "int" else pa.binary()) for c, t in (x.split() for x in _INDEX.split(", "))]))


def document_counts(grids: DataFrame) -> DataFrame:
    """(term binary, df long): the documents that hold each term, as sums over grids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, dfs in zip(batch.column(0), batch.column(1)):
                names = zlib.decompress(terms.as_py()).split(b" ")
                counts = np.frombuffer(zlib.decompress(dfs.as_py()), "<i4").astype(np.int64)
                for lo in range(0, len(names), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + (1 << 16)], pa.binary()), pa.array(counts[lo : lo + (1 << 16)])], ["term", "df"])

    return grids.select("terms", "dfs").mapInArrow(run, "term binary, df long")


def asked(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, term, times): the terms of each different item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, item, t, n) for key, item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)) for t, n in Counter(terms_of(raw.as_py())).items()]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.binary(), pa.int64()])], ["key", "item", "term", "times"])

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    keyed = rows.select(F.sha2(F.concat_ws(":", F.coalesce(F.col("item").cast("string"), F.lit("")), "text"), 256).alias("key"), "item", F.col("text").cast("binary").alias("text"))
    return keyed.mapInArrow(run, "key string, item long, term binary, times long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", grid_docs: int = GRID_DOCS, grid_postings: int = GRID_POSTINGS, held_bytes: int = HELD_BYTES, fan: int = FAN) -> DataFrame:
    """(item, rank, id, score): for each item the k documents of the largest scores above 0, ties by ascending id.

    Every task answers the items on the grids that it reads, one by one, and keeps a list of k for each item, which also
    cuts the search in later grids; lists are merged `fan` at a time. Items of up to held_bytes go to all tasks, by a
    broadcast of that size at most; more are dealt to groups, and each pair of a group of items and a grid meets once.

    Null texts have no terms; null ids are documents or items like any other and come last among equal scores. Rows that
    repeat an id are documents of their own. Rows that repeat an item's id and text are asked once; different texts of
    one id are ranked each on its own. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    grids, n_docs, _ = index(docs, id_col, text_col, grid_docs, grid_postings)
    terms, _ = spool(asked(items, item_col, item_text), "asked")
    counts = document_counts(grids).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    entry = F.struct("term", "times", "df")
    questions, _ = spool(terms.join(counts, "term").groupBy("key", "item").agg(F.collect_list(entry).alias("terms")), "questions")
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["term"]) + 64)
    held, of_grids = questions.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0], grids.count()
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def answer(rows: Iterable[tuple[str, object]], questions: dict[str, Question]) -> None:
        """Questions come in before the grids they meet."""
        for kind, row in rows:
            if kind == "item":
                questions[row[0]] = Question(row[1], row[2], n_docs, k)
            elif questions:
                meet(row, questions.values())

    def lists(questions: dict[str, Question], node: int) -> Iterator[pa.RecordBatch]:
        for key, q in questions.items():
            best, n = q.best, len(q.best.score)
            if n:
                columns = [pa.array([key] * n), pa.array([q.item] * n, pa.int64()), pa.array([node] * n, pa.int32()), pa.array(best.id, mask=best.null), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "item", "node", "id", "score"])

    schema = "key string, item long, node int, id long, score long"
    if held <= held_bytes:
        known = [(r["key"], r["item"], [tuple(t) for t in r["terms"]]) for r in questions.collect()]
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            questions: dict[str, Question] = {}
            answer((("item", x) for x in shared.value), questions)
            answer((("grid", {c: batch.column(j)[i].as_py() for j, c in enumerate(names)}) for batch in batches for i in range(batch.num_rows)), questions)
            yield from lists(questions, TaskContext.get().partitionId())

        found = grids.mapInArrow(run, schema)
    else:
        of_items, of_grids = math.ceil(held / held_bytes), max(1, of_grids)

        def numbers(n: int):
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _INDEX.split(", "))]
        left = questions.select(F.pmod(F.xxhash64("key"), F.lit(of_items)).cast("int").alias("q"), numbers(of_grids).alias("s"), F.lit(0).alias("side"), "key", "item", "terms", *[c.alias("g_" + n) for c, n in zip(none, names)])
        right = grids.select(numbers(of_items).alias("q"), F.pmod(F.xxhash64("ids", "terms"), F.lit(of_grids)).cast("int").alias("s"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("item"), F.lit(None).cast(questions.schema["terms"].dataType).alias("terms"), *[F.col(n).alias("g_" + n) for n in names])
        dealt = left.union(right).repartition(min(of_items * of_grids, 1 << 16), "q", "s").sortWithinPartitions("q", "s", "side")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, questions = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    q, s, side, *rest = (batch.column(j)[i].as_py() for j in range(batch.num_columns))
                    if (q, s) != now:
                        yield from lists(questions, now[1] if now else 0)
                        now, questions = (q, s), {}
                    if side == 0:
                        rest[2] = [(t["term"], t["times"], t["df"]) for t in rest[2]]
                    answer([("item", rest[:3]) if side == 0 else ("grid", dict(zip(names, rest[3:])))], questions)
            yield from lists(questions, now[1] if now else 0)

        found = dealt.mapInArrow(run, schema)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    while of_grids > fan:
        of_grids = math.ceil(of_grids / fan)
        found = found.withColumn("node", F.floor(F.col("node") / fan).cast("int"))
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "node").orderBy(*order)))
        found = ranked.where(F.col("rank") <= k).drop("rank")
    last = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return last.where(F.col("rank") <= k).select("item", "rank", "id", "score")


class Question:
    """An item's terms with their weights, and its list so far."""

    def __init__(self, item: int | None, terms: list[tuple[bytes, int, int]], docs: int, k: int):
        self.item, self.best = item, Best(k)
        self.terms = [(bytes(t), times * weight(docs, df)) for t, times, df in terms]


def meet(row: dict, questions: Iterable[Question]) -> None:
    """Bring the documents of one grid into the lists of all questions."""
    wanted = {t for q in questions for t, w in q.terms if w}
    rows = {t: i for i, t in enumerate(zlib.decompress(row["terms"]).split(b" ")) if t in wanted}
    treap = Treap.unpacked(row["treap"], row["depth"], row["cells"], row["points"]).opened()
    ids = Ids(np.frombuffer(row["ids"], "<i8"), row["nulls"])
    for q in questions:
        here = [(rows[t], w) for t, w in q.terms if w and t in rows]
        if here:
            treap.top(*np.array(here, np.int64).T, q.best, ids)
