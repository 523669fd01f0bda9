"""Operator 1: SimHash near-duplicates, found exactly with pivot distance tables.

Stages: fingerprint every whole text; reduce to distinct fingerprints; precompute each one's Hamming distances to
reference fingerprints (pivots); meet fingerprints that agree in enough blocks of bits (pigeonhole, lossless); discard
pairs by the largest difference of a pivot coordinate (triangle inequality, lossless); verify the survivors by XOR;
join the links into components.

A pivot coordinate alone tells two random 64-bit codes apart in under half of all cases, so pivots cannot be the only
index: the blocks decide which rows of the table meet, the pivots which of these are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, connected_components, lean, membership, spool, unspool

SEED = 42
#: Texts are cut into words in runs of about so many bytes, so that a very long one needs little memory.
RUN_BYTES = 1 << 20
#: The most rows of a hot key that meet in one task come from two tiles of this size.
TILE = 8192
#: Sixteen reference fingerprints, from the hash of their number.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(16)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_runs(raw: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(raw):
        end = min(len(raw), at + RUN_BYTES)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
        at = end


def shingles(raw: bytes | None, size: int) -> Iterator[list[int]]:
    """Hashes of a text's shingles, repeats included, run by run; of a shorter text that of all its words, if any."""
    tail, digest, some = [], xxhash.xxh64_intdigest, False
    for words in _word_runs(raw or b""):
        words = tail + words
        if hashes := [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)))]:
            some = True
            yield hashes
        tail = words[1 - size :] if size > 1 else []
    if not some and tail:
        yield [digest(b" ".join(tail), SEED)]


def fingerprint(raw: bytes | None, shingle: int = 4, distinct: bool = False) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8; 0 without words. distinct: equal shingles vote once."""
    votes, n = np.zeros(64, np.int64), 0

    def add(hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[:] += bits.sum(axis=0, dtype=np.int64)

    runs = shingles(raw, shingle)
    for hashes in [list({h for run in runs for h in run})] if distinct else runs:
        if hashes:
            add(hashes)
            n += len(hashes)
    return int(sum(1 << int(j) for j in np.flatnonzero(2 * votes > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distinct: bool = False) -> DataFrame:
    """(id, fp) of every row, fp the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(x.as_py(), shingle, distinct)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return plain.mapInArrow(lean(run), "id long, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """The distances of fingerprints to the sixteen pivots, a row each."""
    return np.bitwise_count(fp.view(np.uint64)[:, None] ^ np.array(PIVOTS, np.uint64)[None, :]).astype(np.int8)


def with_pivots(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp) with their row of the pivot table, a byte for each pivot; computed once and carried from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(1).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in table], pa.binary())], ["node", "fp", "pivots"])

    return nodes.select("node", "fp").mapInArrow(run, "node long, fp long, pivots binary")


def block_keys(distance: int, blocks: int) -> Column:
    """An array of keys of fp: two fingerprints within the distance share one of them at least.

    Of `blocks` blocks of bits at most `distance` differ, so the rest agree; a key holds one choice of that many blocks.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(n).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            bits = F.shiftrightunsigned(F.col("fp"), edges[b]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def choose_blocks(distance: int, codes: int) -> int:
    """The fewest blocks for which a key of random fingerprints has no more than about four of them."""
    for blocks in range(distance + 2, distance + 5):
        if codes >> (64 * (blocks - distance) // blocks) <= 4:
            break
    return blocks


def _tile_pairs(node: Column, tiles: Column) -> Column:
    """The pairs of tiles, as numbers, that a node goes to: its own tile with each."""
    own = F.pmod(F.xxhash64(node), tiles)
    return F.transform(F.sequence(F.lit(0).cast("long"), tiles.cast("long") - 1), lambda j: F.least(own, j) * F.lit(1 << 31) + F.greatest(own, j))


#: Runs of so many fingerprints under one key, or fewer, give all their links; longer ones a spanning forest.
SHORT = 64


def links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = TILE, short: int | None = SHORT) -> DataFrame:
    """Edges (a, b, whole, partial) between nodes (node, fp) within the distance. Of a key with at most `short` nodes all
    of its pairs that link are emitted, marked whole; of a larger one a spanning forest of them, marked partial, so that
    the edges are never all pairs of a large family. A pair found in both ways has both marks, as each forest needs all
    of its edges. short None: all pairs of every key.

    A key with more than `tile` nodes is dealt out as pairs of tiles, so no task gets it whole.
    """
    blocks = blocks or choose_blocks(distance, nodes.count())
    assert comb(blocks, distance) < 1 << 20
    keyed = with_pivots(nodes).select(F.explode(block_keys(distance, blocks)).alias("key"), "node", "fp", "pivots")
    hot, _ = spool(keyed.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "hot")  # few: the planner knows its size
    others = _tile_pairs(F.col("node"), F.col("tiles"))
    dealt = (
        keyed.join(hot, "key", "left")
        .withColumn("tile", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)))
        .select("key", "tile", "node", "fp", "pivots")
        .repartition("key", "tile")
        .sortWithinPartitions("key", "tile")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            table = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.int8).reshape(-1, len(PIVOTS))
            if rest is not None:
                rows, table = np.concatenate([rest[0], rows]), np.concatenate([rest[1], table])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            rest = rows[cut:], table[cut:]
            if cut:
                yield _as_edges(_forest(rows[:cut], table[:cut], distance, short))
        if rest is not None:
            yield _as_edges(_forest(*rest, distance, short))

    edges = dealt.mapInArrow(run, "a long, b long, partial boolean")
    return edges.groupBy("a", "b").agg(F.max(~F.col("partial")).alias("whole"), F.max("partial").alias("partial"))


def _as_edges(pairs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    a, b, partial = pairs
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(partial)], ["a", "b", "partial"])


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray | int, j: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs (i, j) link: no pivot coordinate differs by more than the distance, nor do the bits."""
    kept = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= distance)
    one = fp[i] if np.isscalar(i) or np.ndim(i) == 0 else fp[i[kept]]
    return kept[np.bitwise_count((one ^ fp[j[kept]]).view(np.uint64)) <= distance]


def _forest(rows: np.ndarray, table: np.ndarray, distance: int, short: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside each run of equal (key, tile): all of a short run's, a spanning forest of a long one's."""
    node, fp = (np.ascontiguousarray(rows[:, i]) for i in (2, 3))
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(rows)])
    most = sizes.max() if short is None else short
    a, b, partial = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    left = np.where(np.repeat(sizes <= most, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(rows)), 1)
    for step in range(1, int(left.max())):
        i = np.flatnonzero(left > step)
        near = _near(fp, table, i, i + step, distance)
        a.append(node[i[near]])
        b.append(node[i[near] + step])
        partial.append(np.zeros(len(near), bool))
    for start, size in zip(starts[sizes > most], sizes[sizes > most]):
        waiting = np.arange(start, start + size)
        while len(waiting):  # breadth first: every row is compared with those that nothing has reached yet
            reached, waiting = [waiting[0]], waiting[1:]
            while reached and len(waiting):
                x = reached.pop()
                near = _near(fp, table, int(x), waiting, distance)
                if len(near):
                    a.append(np.full(len(near), node[x]))
                    b.append(node[waiting[near]])
                    partial.append(np.ones(len(near), bool))
                    reached.extend(waiting[near])
                    waiting = np.delete(waiting, near)
    return np.concatenate(a), np.concatenate(b), np.concatenate(partial)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component) of every row: component is the smallest id whose fingerprint a chain of links reaches.

    Texts without words have fingerprint 0, which links like any other. Null ids get their group's component; a group
    without any id has a null one. Repeated rows stay repeated. An empty table gives an empty result.
    """
    coded, _ = spool(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes, _ = spool(coded.groupBy("fp").agg(F.min("id").alias("first")), "codes")
    parts = connected_components(links(codes.select(F.col("fp").alias("node"), "fp"), distance, short=8))
    classed = codes.join(parts, codes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    lowest = classed.groupBy("class").agg(F.min("first").alias("component"))
    return coded.join(classed.join(lowest, "class").select("fp", "component"), "fp").select("id", "fp", "component")


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, digest, id, hashes) of (node, digest, id, text): the sorted distinct hashes of a text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingle_set(x.as_py(), size).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["node", "digest", "id", "hashes"])

    plain = texts.select("node", "digest", "id", F.col("text").cast("binary").alias("raw"))
    return plain.mapInArrow(lean(run), "node long, digest binary, id long, hashes binary")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with the column same: whether the sets' intersection is that share of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_())], ["a", "b", "same"])

    # pairs grow with the documents: merged at every size, never broadcast
    first, second = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}")).hint("merge") for c in "ab")
    rows = pairs.join(first, "a").join(second, "b").select("a", "b", "ha", "hb")
    return rows.mapInArrow(lean(run), "a long, b long, same boolean")


#: Texts of a family that one task compares come from two tiles of this size; shared hashes are counted so many at a time.
FAMILY_TILE, COLUMNS = 512, 4096


def _similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with that similarity, from products of their incidence matrix."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    owner, flat = np.repeat(np.arange(n), sizes), np.concatenate(sets) if n else np.empty(0, np.uint64)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    same = both >= similarity * (sizes[:, None] + sizes[None, :] - both)
    edges, waiting = [], np.ones(n, bool)
    for root in range(n):
        if waiting[root]:
            waiting[root], reached = False, [root]
            while reached:
                x = reached.pop()
                for y in np.flatnonzero(same[x] & waiting):
                    waiting[y] = False
                    edges.append((x, int(y)))
                    reached.append(int(y))
    return edges


#: Members of a family with which all others are compared, one after another, before pairs of tiles are; members that
#: meet one copy of a leader's set.
LEADERS, PART = 4, 2048


def _distances(families: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """(component, leader, node, d): the Jaccard distance of each family's leader (component, leader, n) to all members
    (component, node), n of them. Members are dealt to parts, and a leader's set is sent once to each part."""
    parts = F.ceil(F.col("n") / PART).cast("int")
    member = families.join(leaders, "component").select("component", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(1).alias("side"), "node")
    leader = leaders.select("component", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"), F.col("leader").alias("node"))
    rows = member.union(leader).join(sets.withColumnRenamed("id", "node").hint("merge"), "node").repartition("component", "part").sortWithinPartitions("component", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, own = None, None
        for batch in batches:
            out = []
            for component, side, node, hashes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(hashes, "<u8")
                if side == 0:
                    first, own = node, x
                else:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    out.append((component, first, node, 1 - both / max(1, len(own) + len(x) - both) if len(own) or len(x) else 0.0))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.float64()])], ["component", "leader", "node", "d"])

    return rows.select("component", "side", "node", "hashes").mapInArrow(run, "component long, leader long, node long, d double")


def _family_links(families: DataFrame, sets: DataFrame, similarity: float, tile: int = FAMILY_TILE, leaders: int = LEADERS) -> DataFrame:
    """Edges (a, b) between similar texts of a family (node, component), enough to connect all that its similar pairs do.

    Families of one tile are compared whole in one task. Of a larger one the first member, its leader, is compared with
    all others, then the first of those that no leader is similar to, and so on. Members similar to a leader are its
    group and linked to it, so a link inside a group adds nothing. Two kinds of links are left:

    - of members in no group, which are compared with all members;
    - between groups. Jaccard distance is a metric, so a member with a link into another group is no farther from that
      group's leader than the group's radius and the largest distance of a link. Members that near to each other's
      groups are compared, unless a member of both has joined the groups already.

    Both go in pairs of tiles that carry the texts' sets; each gives a spanning forest of the pairs that are similar.
    """
    spark, reach = families.sparkSession, 1 - similarity + 1e-9
    large = families.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    none = F.lit(0).cast("long")
    small = families.join(large, "component", "left_anti").select("component", none.alias("pair"), none.alias("own_i"), none.alias("own_j"), "node")
    families, _ = spool(families.join(large.select("component"), "component", "left_semi").select("component", "node"), "large")
    sized, _ = spool(families.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    rest, past, measured, some = families, [], [], not families.isEmpty()
    held = spool(sets.join(families.select(F.col("node").alias("id")), "id", "left_semi"), "held")[0] if some else sets
    for step in range(leaders if some else 0):
        leader = rest.groupBy("component").agg(F.min("node").alias("leader")).join(sized, "component")
        found, _ = spool(_distances(families, leader, held).withColumn("step", F.lit(step)), "leaders")
        measured.append(found)
        rest, path = spool(rest.join(found.where(F.col("d") <= reach).select("node"), "node", "left_anti").select("component", "node"), "rest")
        for done in past:
            unspool(spark, done)
        past = [path]
        if rest.isEmpty():
            break
    edges = [found.where((F.col("d") <= reach) & (F.col("leader") != F.col("node"))).select(F.col("leader").alias("a"), F.col("node").alias("b")) for found in measured]
    count = lambda df, name, *by: df.groupBy("component", *by).agg(F.ceil(F.count("*") / tile).cast("long").alias(name))
    own = lambda n: F.pmod(F.xxhash64("node"), n).alias(f"own_{n}")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(f"own_{n}")
    sizes = count(rest, "i").join(count(families, "j"), "component")
    first = rest.join(sizes, "component").select("component", none.alias("pair"), own("i"), every("j"), "node")
    second = families.join(sizes, "component").select("component", none.alias("pair"), every("i"), own("j"), "node")
    dealt = small.union(first.union(second).distinct())
    if len(measured) > 1:
        known = reduce(DataFrame.union, measured).select("component", "node", "step", "d")
        inside = known.where(F.col("d") <= reach)
        radius = inside.groupBy("component", "step").agg(F.max("d").alias("radius"))
        joined = inside.select("component", "node", F.col("step").alias("x")).join(inside.select("component", "node", F.col("step").alias("y")), ["component", "node"]).where("x < y").select("component", "x", "y").distinct()
        # (x, y): the member is of x's group and near enough to y's to have a link into it
        near = inside.select("component", "node", F.col("step").alias("x")).join(known.select("component", "node", F.col("step").alias("y"), "d"), ["component", "node"]).where("x <> y")
        near = near.join(radius.withColumnRenamed("step", "y"), ["component", "y"]).where(F.col("d") <= F.col("radius") + reach)
        near = near.select("component", "node", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("x") < F.col("y")).alias("left")).join(joined, ["component", "x", "y"], "left_anti")
        near, _ = spool(near.withColumn("pair", (1 + F.col("x") * leaders + F.col("y")).cast("long")).select("component", "pair", "left", "node"), "near")
        left, right = near.where("left"), near.where("NOT left")
        sizes = count(left, "i", "pair").join(count(right, "j", "pair"), ["component", "pair"])
        first = left.join(sizes, ["component", "pair"]).select("component", "pair", own("i"), every("j"), "node")
        second = right.join(sizes, ["component", "pair"]).select("component", "pair", every("i"), own("j"), "node")
        dealt = dealt.union(first.union(second).distinct())
    keys = ["component", "pair", "own_i", "own_j"]
    rows = dealt.join(sets.withColumnRenamed("id", "node"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held = None, [], []

        def out() -> pa.RecordBatch:
            edges = np.array(_similar_forest(held, similarity), np.int64).reshape(-1, 2)
            ids = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[edges[:, 0]]), pa.array(ids[edges[:, 1]])], ["a", "b"])

        for batch in batches:
            for *now, node, hashes in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now != key:
                    if nodes:
                        yield out()
                    key, nodes, held = now, [], []
                nodes.append(node)
                held.append(np.frombuffer(hashes, "<u8"))
        if nodes:
            yield out()

    edges.append(rows.select(*keys, "node", "hashes").mapInArrow(run, "a long, b long"))
    return reduce(DataFrame.union, edges)


#: Shingles in HOT of about SAMPLE texts are ordered last and not counted; others are counted in shards of about SHARD.
SAMPLE, HOT, SHARD = 5000, 50, 1 << 20
#: The order of the hot shingles, above any count.
LAST = 1 << 62
#: Bytes of a hash that move to its shard, which the others choose.
LOW = 5


def _shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    return np.unique(np.array([h for part in shingles(raw, size) for h in part], "<u8"))


def _hot_shingles(plain: DataFrame, size: int, texts: int) -> np.ndarray:
    """The hashes, sorted, of shingles that many texts of a sample hold: at most its shingles / HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(x.as_py(), size).view("<i8"))], ["hash"])

    some = plain.where(F.pmod(F.xxhash64("id"), F.lit(max(1, texts // SAMPLE))) == 0).mapInArrow(lean(run), "hash long")
    found = some.groupBy("hash").count().where(F.col("count") >= HOT).select("hash").collect()
    return np.sort(np.array([r.hash for r in found], "<i8").view("<u8"))


def _ranked_shingles(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, n, hash, df) of the shingles that a text of n distinct ones shares with another one, df being the number of
    texts that hold the shingle, or LAST for hot ones. Hashes move to their counts packed into arrays, by shard, a text's
    node and n once a shard; hot ones, which would meet in one task, are not counted and are dealt by text.

    hash is a number made of the shard and the low bytes of the shingle's hash, of hot ones -1 - their place. Shingles
    that share one count as one, everywhere alike: a text may then have a key too many, but lacks none.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    texts, volume = plain.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
    shards, hot = 1 + volume // (6 * SHARD), _hot_shingles(plain, size, texts)

    def pack(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        flat, sizes = np.concatenate([x for _, x in held]), np.array([len(x) for _, x in held])
        nodes, owner = np.array([i for i, _ in held], "<i8"), np.repeat(np.arange(len(held)), sizes)
        shard = ((flat >> np.uint64(8 * LOW)) % np.uint64(shards)).astype(np.int64)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
            common = hot[place] == flat
            shard[common] = -1 - nodes[owner[common]] % shards
            flat = np.where(common, place.astype("<u8"), flat)
        low = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW]
        order = np.argsort(shard, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
        columns = [[], [], [], []]
        for part in np.split(order, starts[1:]):
            who, times = np.unique(owner[part], return_counts=True)
            for column, x in zip(columns, (nodes[who], sizes[who].astype("<i4"), times.astype("<i4"), low[part])):
                column.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(shard[order[starts]]), *[pa.array(x, pa.binary()) for x in columns]], ["shard", "node", "n", "times", "hash"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1)):
                found = _shingle_set(x.as_py(), size)
                found = found if len(found) else np.zeros(1, "<u8")  # texts without words are alike
                held.append((i.as_py(), found))
                total += len(found)
                if total >= 1 << 20:
                    yield pack(held)
                    held, total = [], 0
        if held:
            yield pack(held)

    def count(shard: int, held: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        node, n, times, low = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held), ("<i8", "<i4", "<i4", np.uint8)))
        flat = np.zeros((len(low) // LOW, 8), np.uint8)
        flat[:, :LOW] = low.reshape(-1, LOW)
        flat = flat.view("<i8").reshape(-1)
        if shard < 0:
            df, flat = np.full(len(flat), LAST), -1 - flat
        else:
            _, inverse, seen = np.unique(flat, return_inverse=True, return_counts=True)
            df, flat = seen[inverse], flat + (shard << 8 * LOW)
        more = df > 1
        columns = [pa.array(x[more]) for x in (np.repeat(node, times), np.repeat(n, times), flat, df.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["node", "n", "hash", "df"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(i) for i in range(5))):
                if shard.as_py() != key:
                    if held:
                        yield count(key, held)
                    key, held = shard.as_py(), []
                held.append(tuple(x.as_py() for x in row))
        if held:
            yield count(key, held)

    dealt = plain.mapInArrow(lean(deal), "shard long, node binary, n binary, times binary, hash binary")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(tally), "node long, n int, hash long, df long")


def prefix_pairs(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, short: int = SHORT) -> DataFrame:
    """Candidates (a, b, whole, partial) that hold every pair of texts with the similarity, as links does: pairs under
    keys of at most `short` texts, stars of longer ones, whose trees are families.

    Of two sets of n and m elements that are so similar, similarity * max(n, m) elements or more are common. So whatever
    the order of all elements, they share one of the first n - ceil(similarity * n) + 1 of each; the order is by rarity,
    and shingles of a single text, which come first, need no key.
    """
    own = F.sort_array(F.collect_list(F.struct("df", "hash")))
    lists = _ranked_shingles(docs, id_col, text_col, size).groupBy("node").agg(F.first("n").alias("n"), own.alias("own"))
    left = (F.size("own") + 1 - F.ceil(similarity * F.col("n") - 1e-9)).cast("int")  # prefix without those of one text
    lists = lists.withColumn("left", left).where("left > 0")
    keyed, _ = spool(lists.select(F.explode(F.slice(F.col("own").getField("hash"), 1, F.col("left"))).alias("key"), "node", "n"), "prefixes")
    counts = keyed.groupBy("key").agg(F.count("*").alias("count"), F.min("node").alias("first")).where("count > 1")
    known = keyed.join(counts, "key")
    few = known.where(F.col("count") <= short)
    first, second = (few.select("key", F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    sized = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    pairs = first.join(second, "key").where(F.col("a") < F.col("b")).where(sized).select("a", "b").distinct()
    stars = known.where((F.col("count") > short) & (F.col("first") < F.col("node"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    return pairs.select("a", "b", F.lit(True).alias("whole"), F.lit(False).alias("partial")).union(
        stars.select("a", "b", F.lit(False), F.lit(True))
    )


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """node and digest of a row: a hash of id and text, and the text's MD5, which tells rows of equal hashes apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(F.col(id_col).cast("long"), text).alias("node"), F.unhex(F.md5(text)).alias("digest")]


#: Rows with texts or sets in an Arrow batch, which the JVM and the Python worker hold whole.
ROWS = 1000


def _verified_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, distance: int, short: int, tile: int, leaders: int) -> DataFrame:
    """(node, component, digest, id) of the rows that are near copies, written; component is a node."""
    named = docs.select(*row_keys(id_col, text_col), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nodes, _ = spool(fingerprints(named, "node", "text", 1, distinct=True).select(F.col("id").alias("node"), "fp"), "words")
    found = links(nodes, distance, short=short).where("a <> b").union(prefix_pairs(named, "node", "text", shingle, similarity, short))
    pairs, _ = spool(found.groupBy("a", "b").agg(F.max("whole").alias("whole"), F.max("partial").alias("partial")), "candidates")
    members = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    members, _ = spool(members, "members")
    some = named.where(membership(members.select(F.col("node").alias("h")))(F.col("node")))  # texts of few others move with them
    sets = _shingle_sets(some.join(members.hint("merge"), "node", "left_semi"), shingle).groupBy("node").agg(F.min_by(F.struct("digest", "id", "hashes"), "digest").alias("row"))
    known, _ = spool(sets.select("node", "row.digest", "row.id", "row.hashes"), "sets")  # of rows with equal hashes, one
    sets, known = known.select(F.col("node").alias("id"), "hashes"), known.drop("hashes")
    found = _similar(pairs.where("whole"), sets, similarity).where("same").select("a", "b")
    families, _ = spool(connected_components(pairs.where("partial").select("a", "b")), "families")
    found = found.union(_family_links(families, sets, similarity, tile, leaders))
    return spool(connected_components(found).join(known, "node"), "groups")[0]


def verified_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 6, short: int = SHORT, tile: int = FAMILY_TILE, leaders: int = LEADERS) -> DataFrame:
    """(node, digest, id, component, kept) of the rows that are near copies: texts whose sets of shingles of so many words
    have that Jaccard similarity. component is the smallest id that a chain of such pairs reaches, and kept marks the row
    that has it. Others have no row; node and digest are those of row_keys.

    Candidates come from prefixes of the texts' rarest shingles, which miss no pair with the similarity, and also from
    fingerprints over the distinct words; every candidate is then verified on whole texts. Keys with few texts give all
    their candidate pairs. Larger ones give a forest, whose trees are families, in which links are sought anew. Every
    row is a text of its own, with a null id too, and rows that share an id are not confused; null ids come last. Rows
    that repeat both id and text are one node. An empty table gives an empty result.
    """
    with batches_of(docs.sparkSession, ROWS):
        groups = _verified_groups(docs, id_col, text_col, shingle, similarity, distance, short, tile, leaders)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "node")).alias("first"))
    out = groups.join(first, "component")
    return out.select("node", "digest", "id", F.col("first.id").alias("component"), (F.col("node") == F.col("first.node")).alias("kept"))
