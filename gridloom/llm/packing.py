"""Operator 8: best-fit packing of tokenized documents with large-item matching."""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, lean, spool

CAPACITY, END_ID = 1024, 2
#: Entries of a worker's table of tokenized words.
CACHE = 500_000
#: Texts of an Arrow batch.
TEXTS = 1000
#: Runs of white space or of other characters that are left to `tokenizers`, whose matching needs no stack for them.
LONG = re.compile(r"\s{256}|\S{2048}")


class Tokenizer:
    """Ids as little-endian unsigned 32-bit bytes, those that `tokenizers` gives for a file such as byte_bpe_50k.json.

    The same vocabulary as ranks gives the same ids faster. Added tokens of the file stand for their own ids, as there.
    No token crosses a single space between two other characters, so a text is cut there and the words, most of which
    recur, are looked up; other texts are done whole, and those with very long runs by `tokenizers` itself.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64
        import json

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.plain = json_path, None
        with open(json_path, encoding="utf-8") as file:
            self.added = {t["content"]: struct.pack("<I", t["id"]) for t in json.load(file)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = Words(self)

    def ids(self, text: str) -> bytes:
        if self.cut and len(parts := self.cut.split(text)) > 1:
            return b"".join(self.added.get(x) or self.segment(x) for x in parts if x)
        return self.segment(text)

    def whole(self, text: str) -> bytes:
        if len(text) >= 256 and LONG.search(text):
            ids = self.by_tokenizers(text)
        else:
            ids = self.encoder.encode_ordinary(text)
        return struct.pack("<%dI" % len(ids), *ids)

    def by_tokenizers(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer as Plain

            self.plain = Plain.from_file(self.json_path)
            self.plain.encode_special_tokens = True  # added tokens have been cut out before
        return self.plain.encode(text, add_special_tokens=False).ids

    def segment(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        head, *rest = text.split(" ")
        if not rest or not head or head[-1].isspace():
            return self.whole(text)
        if len(self.words) > CACHE:
            self.words.clear()
        try:
            return self.whole(head) + b"".join(map(self.words.__getitem__, rest))
        except Joined:
            return self.whole(text)


class Joined(Exception):
    """A word that a token may join to its neighbours."""


class Words(dict):
    """Word -> ids of the word after a space, for words that neither start nor end with white space."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Joined
        self[word] = ids = self.tokenizer.whole(" " + word)
        return ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """(id, piece, start, length, crc, task, place) of every document: its ids and the end id, in pieces of the capacity.

    Only documents longer than the capacity are cut; their first piece takes the remainder, the others are full. place
    numbers the pieces of a length that one task made, from 0; the two hold for one write of the table.
    vocabulary: the paths of the tokenizer's file and of its ranks, and the pattern; without it, the public byte_bpe_50k.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary:
            json_path, ranks_path, pattern = vocabulary
        else:
            import public_tokenizers

            json_path, ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        tokenizer, end = Tokenizer(str(json_path), str(ranks_path), pattern), struct.pack("<I", end_id)
        task, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                size = n % capacity or capacity
                while at < n:
                    rows.append((doc, piece, at, size, crc32(ids[4 * at : 4 * (at + size)]), task, made[size]))
                    made[size] += 1
                    at, piece, size = at + size, piece + 1, capacity
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "start", "length", "crc", "task", "place"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(lean(run), "id long, piece int, start long, length long, crc long, task int, place long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, last rank + 1, first sequence, pieces in a row, offset) for so many pieces of each length.

    Works on counts per length, at most one for each length up to the capacity. Lengths above a third of the capacity
    are matched first, longest first, each with the longest partner that fits beside it (two of them fill a bin, three
    never fit); the others, longest first, go where the least room is left. Bins of equal content are one group.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    groups: list[list] = []  # [bins, content [(length, in a row)]]
    rooms: list[tuple[int, int]] = []  # (room, group), sorted

    def add(bins: int, content: list[tuple[int, int]]) -> None:
        room = capacity - sum(n * q for n, q in content)
        groups.append([bins, content])
        insort(rooms, (room, len(groups) - 1))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= min(n, capacity - n) and left[m] > (m == n)), None)
            if partner is None:
                add(left[n], [(n, 1)])
                left[n] = 0
            elif partner == n:
                add(left[n] // 2, [(n, 2)])
                left[n] %= 2
            else:
                bins = min(left[n], left[partner])
                add(bins, [(n, 1), (partner, 1)])
                left[n] -= bins
                left[partner] -= bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(rooms, (n, -1))
            if at == len(rooms):
                in_row = min(left[n], capacity // n)
                bins = left[n] // in_row
                add(bins, [(n, in_row)])
                left[n] -= bins * in_row
                continue
            room, g = rooms.pop(at)
            bins, content = groups[g]
            in_row = min(left[n], room // n)
            used = min(bins, left[n] // in_row)
            left[n] -= used * in_row
            groups[g][0] = 0
            if bins > used:
                add(bins - used, content)
            add(used, [*content, (n, in_row)])
    slots, taken, first = [], dict.fromkeys(counts, 0), 0
    for bins, content in groups:
        if not bins:
            continue
        offset = 0
        for n, in_row in content:
            slots.append((n, taken[n], taken[n] + bins * in_row, first, in_row, offset))
            taken[n] += bins * in_row
            offset += n * in_row
        first += bins
    return slots


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """(id, piece, start, length, crc, sequence, offset) of every piece; sequences are full to the capacity or have the
    rest empty, and offsets leave no gap.

    The counts per length, at most `capacity` numbers, go to the driver, which plans the bins; the slots, at most a few
    per length and step of the plan, come back as a broadcast table. A piece's rank among those of its length is its
    place in the task that made it, after the counts of the tasks before: the window has a row for each task and length,
    and no task orders the pieces of a length. Null texts are empty documents: the end id alone. Null and repeated ids
    and repeated rows are documents like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with batches_of(spark, TEXTS):
        cut, _ = spool(pieces(docs, id_col, text_col, capacity, end_id, vocabulary), "pieces")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks, _ = spool(cut.groupBy("length", "task").agg(F.count("*").alias("n")).withColumn("before", before), "tasks")
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)
    assert len(slots) <= 8 * capacity * capacity
    lows = {n: np.array([s[1:] for s in slots if s[0] == n], np.int64) for n in counts}
    ranked = cut.join(tasks.select("length", "task", "before"), ["length", "task"])
    ranked = ranked.select("id", "piece", "start", "length", "crc", (F.col("before") + F.col("place")).alias("rank"))
    shared = spark.sparkContext.broadcast(lows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, slot = np.flatnonzero(length == n), shared.value[int(n)]
                s = slot[np.searchsorted(slot[:, 0], rank[at], side="right") - 1]
                step = rank[at] - s[:, 0]
                sequence[at] = s[:, 2] + step // s[:, 3]
                offset[at] = s[:, 4] + step % s[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "crc", "sequence", "offset"])

    return ranked.mapInArrow(run, "id long, piece int, start long, length long, crc long, sequence long, offset long")
