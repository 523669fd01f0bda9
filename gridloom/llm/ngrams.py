"""Character n-gram costs of whole texts by sharded counts, for operator 3.

Texts are read once and dealt out as bags: in blocks of texts, each shard of n-grams gets the n-grams of the block and for
each the texts that hold it, with counts. Trusted bags are summed to counts; an interpolated modified Kneser-Ney model is
fitted by grouping and joining tables of n-grams; the cost of every n-gram goes to its shard, meets the bags there, and
the shards' sums are added for each text. Symbols are the characters themselves, of any number; only the digits 0-9 are
read as 0, so that numbers and keys, which no text foretells, do not set the scale. No table of n-grams comes to the
driver or whole to a task, and texts themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import SystemRandom

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, lean, spool

ORDER, FOLDS = 4, 2
#: Texts (a power of two, at most 2^16) and characters of a block; texts are cut into runs, which overlap.
BLOCK, CHARS, RUN = 2048, 1 << 22, 1 << 20
#: Blocks that meet a copy of a shard's costs; bytes of text for which there is a shard more than SHARDS.
GROUP, SHARDS, VOLUME = 64, 8, 32 << 30
#: Characters whose n-grams are numbered at once; texts and bags of an Arrow batch.
PIECE, TEXTS, BAGS = 1 << 18, 1000, 16
#: Of the compression of bags.
LEVEL = 6
#: Costs are whole multiples of this, so that sums do not depend on the order of their parts.
UNIT = 2.0**-20
#: The least probability: discounts are zero where no count is small.
LEAST = 1e-12

DOC = ["block", "place", "home", "id", "lang", "digest", "symbols"]
BAG = ["shard", "grams", "sizes", "places", "counts", "folds"]


def fold_of(text_col: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(folds)).cast("int")


def _packed(x: np.ndarray, kind: str) -> bytes:
    """The numbers, byte plane by byte plane, compressed."""
    raw = x.astype(kind)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw.view(np.uint8).reshape(len(raw), -1).T.tobytes(), asbytes=True)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(raw[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(kind).reshape(-1)


def _shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        h = (h ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(shards)).astype(np.int64)


def _pairs(runs: list[np.ndarray], places: list[int], seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two ranks in one number for each point of some runs but the last, with the places of all these points."""
    base, ends = int(seen.max()) + 1, np.cumsum([len(x) for x in runs])
    cuts = np.unique(np.minimum(np.searchsorted(ends, np.arange(PIECE, ends[-1] + PIECE, PIECE)) + 1, len(runs)))
    for lo, hi in zip([0, *cuts], cuts):
        rank = seen[np.concatenate(runs[lo:hi])]
        owner = np.repeat(np.array(places[lo:hi], np.int32), [len(x) for x in runs[lo:hi]])
        yield rank[:-1].astype(np.int64) * base + rank[1:], owner


def bags(runs: list[np.ndarray], places: list[int], shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, grams, sizes, places, counts) of runs of code points, each after ORDER - 1 others: the different n-grams, a
    row of points each, the number of texts that hold each, and for each n-gram these texts, ascending, with counts. Empties
    runs, and beside them holds one number of 64 bits for each point."""
    seen = np.zeros(0x110000, np.int32)
    for x in runs:
        seen[x] = 1
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = np.arange(len(alphabet))
    base, kinds = len(alphabet), None
    wide = base * base
    if wide * wide * BLOCK >= 1 << 62:
        kinds = np.unique(np.concatenate([np.unique(pair) for pair, _ in _pairs(runs, places, seen)]))
        wide = len(kinds)
    key, at = np.empty(sum(len(x) - ORDER + 1 for x in runs), np.int64), 0
    for pair, owner in _pairs(runs, places, seen):
        pair = pair if kinds is None else np.searchsorted(kinds, pair)
        own = ((pair[:-2] * wide + pair[2:]) * BLOCK + owner[3:])[owner[3:] == owner[:-3]]
        key[at : at + len(own)] = own
        at += len(own)
    runs.clear()
    del seen
    key.sort()
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.empty(len(edges), np.uint32)
    counts[:-1], counts[-1] = edges[1:] - edges[:-1], len(key) - edges[-1]
    code = key[edges]
    del key, edges
    place = (code % BLOCK).astype(np.uint16)
    code //= BLOCK
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    sizes = np.diff(starts, append=len(code))
    first, last = np.divmod(code[starts], wide)
    del code
    if kinds is not None:
        first, last = kinds[first], kinds[last]
    grams = alphabet[np.stack([*np.divmod(first, base), *np.divmod(last, base)], axis=1)]
    shard = _shard_of(grams, shards)
    of_pair = np.repeat(shard, sizes)
    for s in np.unique(shard):
        own, mine = shard == s, of_pair == s
        yield int(s), grams[own], sizes[own], place[mine], counts[mine]


def _steps(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences of places, from zero at each n-gram."""
    steps, starts = np.diff(places, prepend=0), np.cumsum(sizes) - sizes
    steps[starts] = places[starts]
    return steps


def _places(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends, starts = np.cumsum(steps.astype(np.int64)), np.cumsum(sizes) - sizes
    return ends - np.repeat(ends[starts] - steps[starts], sizes)


def deal(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int = FOLDS) -> DataFrame:
    """Rows of two kinds, in one table. With a place: a run of a text, at that place of its block; home is the text's own
    number. With a shard: the bag of a block's n-grams of that shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.unhex(F.md5(text)).alias("digest"), fold_of(text_col, folds).alias("fold"), text.alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    shards = SHARDS + (docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0) // VOLUME
    schema = f"block long, place int, home long, id {kinds['id']}, lang {kinds['lang']}, digest binary, symbols long, shard int, grams binary, sizes binary, places binary, counts binary, folds binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, lead = SystemRandom(), np.full(ORDER - 1, ord("\n"), np.uint32)
        block, chars, runs, owners, rows, found = draw.getrandbits(48), 0, [], [], [], []

        def block_rows() -> Iterator[pa.RecordBatch]:
            """Places go by language and length, so that texts with the same n-grams are neighbours."""
            own = pa.Table.from_batches(rows)
            langs = own.column(1).to_pylist()
            order = sorted(range(len(found)), key=lambda i: (str(langs[i]), found[i][1]))
            homes, symbols = (pa.array([found[i][k] for i in order], pa.int64()) for k in (0, 1))
            columns = [c.combine_chunks() for c in own.take(pa.array(order)).columns]
            blank = [pa.nulls(len(order), pa.int32() if k == "shard" else pa.binary()) for k in BAG]
            head = [pa.array([block] * len(order), pa.int64()), pa.array(range(len(order)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*head, homes, *columns, symbols, *blank], DOC + BAG)
            some = [k for k, i in enumerate(order) if found[i][1]]
            if not some:
                return
            fold = _packed(np.array(owners)[order], "u1")
            ordered = [runs[order[k]] for k in some]
            runs.clear()
            out = [(s, _packed(g.reshape(-1), "<u4"), _packed(n, "<u2"), _packed(_steps(p, n), "<u2"), _packed(c, "<u4"), fold) for s, g, n, p, c in bags(ordered, some, shards)]
            bag = [pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*out))]
            blank = [pa.nulls(len(out), t) for t in (pa.int32(), pa.int64(), *(c.type for c in columns), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(out), pa.int64()), *blank, *bag], DOC + BAG)

        for batch in batches:
            for i, (fold, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4))):
                points, home = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32), None
                points = np.where((points > ord("0")) & (points <= ord("9")), np.uint32(ord("0")), points)
                for begin in range(0, max(1, len(points)), RUN):
                    if len(found) == BLOCK or chars >= CHARS:
                        yield from block_rows()
                        block, chars, runs, owners, rows, found = draw.getrandbits(48), 0, [], [], [], []
                    home = block * BLOCK + len(found) if home is None else home
                    own = points[begin : begin + RUN]
                    runs.append(np.concatenate([points[begin - ORDER + 1 : begin] if begin else lead, own]))
                    owners.append(fold)
                    found.append((home, len(own)))
                    chars += len(own)
                    rows.append(batch.slice(i, 1).select([0, 1, 2]))
        if found:
            yield from block_rows()

    return plain.mapInArrow(lean(run), schema)


def counted(bag: DataFrame, marks: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(shard, gram, n0, n1, ...) of every n-gram: how often the trusted texts of each fold hold it. marks (block, marks)
    are the places of a block's trusted texts."""
    names = ["shard", "gram", *[f"n{f}" for f in range(folds)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, grams, sizes, places, counts, fold, marks in zip(*(batch.column(i) for i in range(7))):
                sizes, fold = _unpacked(sizes.as_py(), "<u2").astype(np.int64), _unpacked(fold.as_py(), "u1")
                trusted = np.zeros(len(fold), bool)
                trusted[np.array(marks.as_py() or [], np.int64)] = True
                place, n = _places(_unpacked(places.as_py(), "<u2"), sizes), _unpacked(counts.as_py(), "<u4").astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(np.where(trusted[place] & (fold[place] == f), n, 0), starts) for f in range(folds)]
                names_ = _strings(_unpacked(grams.as_py(), "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), s.as_py(), np.int32)), pa.array(names_, pa.string()), *[pa.array(x.astype(np.int64)) for x in sums]], names)

    rows = bag.join(marks, "block", "left").select("shard", "grams", "sizes", "places", "counts", "folds", "marks")
    found = rows.mapInArrow(lean(run), ", ".join(["shard int", "gram string", *[f"n{f} long" for f in range(folds)]]))
    return found.groupBy("shard", "gram").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in range(folds)])


def _strings(points: np.ndarray) -> list[str]:
    whole = points.tobytes().decode("utf-32-le")
    return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)]


def probabilities(grams: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(fold, gram, p) of every n-gram of counted's table, seen or not, for each fold by the model of the other folds'
    trusted texts.

    Counts of the highest order are those of the texts; a lower order counts the different symbols before an n-gram.
    Discounts for counts of one, two and more come from the counts of counts of each order. The lowest order is mixed with
    an equal share for each symbol of the table and one for all others."""
    others = [sum((F.col(f"n{g}") for g in range(folds) if g != f or folds == 1), F.lit(0)) for f in range(folds)]
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), n.alias("n")) for f, n in enumerate(others)])).alias("cell")
    full, _ = spool(grams.select("gram", cells).select("cell.fold", "gram", F.col("cell.n").alias("n")), "grams")
    tail = lambda c, k: F.substring(c, 1 - k, k - 1) if k > 1 else F.lit("")
    tables, wanted = {ORDER: full.where("n > 0")}, {ORDER: full.select("fold", "gram")}
    for k in range(ORDER - 1, 0, -1):
        tables[k], _ = spool(tables[k + 1].groupBy("fold", tail("gram", k + 1).alias("gram")).agg(F.count("*").alias("n")), "lower")
        wanted[k], _ = spool(wanted[k + 1].select("fold", tail("gram", k + 1).alias("gram")).distinct(), "wanted")
    symbols = wanted[1].select("gram").distinct().count() + 1
    lower = None
    for k in range(1, ORDER + 1):
        t, discount = tables[k], F.lit(0.0)
        for fold, n1, n2, n3, n4 in t.groupBy("fold").agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).collect():
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
            d = [max(0.0, i - (i + 1) * y * b / a) if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            own = F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
            discount = F.when(F.col("fold") == fold, own).otherwise(discount)
        context = F.substring("gram", 1, k - 1).alias("context")
        contexts = t.groupBy("fold", context).agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
        found = wanted[k].join(t.withColumn("less", F.col("n") - discount).select("fold", "gram", "less"), ["fold", "gram"], "left")
        found = found.select("fold", "gram", "less", context, tail("gram", k).alias("suffix")).join(contexts, ["fold", "context"], "left")
        found = found.withColumn("lower", F.lit(1 / symbols)) if lower is None else found.join(lower, ["fold", "suffix"])
        p = F.coalesce(F.col("less") / F.col("total"), F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("lower")
        done, _ = spool(found.select("fold", "gram", p.alias("p")), "probabilities")
        lower = done.select("fold", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return done


def summed(bag: DataFrame, costs: DataFrame, blocks: int, folds: int = FOLDS) -> DataFrame:
    """(block, place, cost) from the bags and (shard, gram, costs), an array with a cost for each fold: a row for each
    shard that a run has n-grams in. Costs are copied to each group of blocks."""
    groups = 1 + blocks // GROUP

    def run(key: tuple, held: pa.Table, table: pa.Table) -> pa.Table:
        known = np.array(table.column("gram").to_pylist(), "U4")
        order = np.argsort(known)
        known, found = known[order], np.array(table.column("costs").to_pylist(), np.int64).reshape(-1, folds)[order]
        out = []
        for block, grams, sizes, places, counts, fold in zip(*(held.column(c) for c in ("block", "grams", "sizes", "places", "counts", "folds"))):
            sizes, fold = _unpacked(sizes.as_py(), "<u2").astype(np.int64), _unpacked(fold.as_py(), "u1")
            own = found[np.searchsorted(known, np.array(_strings(_unpacked(grams.as_py(), "<u4")), "U4"))]
            place = _places(_unpacked(places.as_py(), "<u2"), sizes)
            each = own[np.repeat(np.arange(len(sizes)), sizes), fold[place]] * _unpacked(counts.as_py(), "<u4").astype(np.int64)
            sums = np.bincount(place, weights=each, minlength=len(fold))  # whole numbers below 2^53
            some = np.flatnonzero(sums)
            out.append((np.full(len(some), block.as_py(), np.int64), some.astype(np.int32), sums[some].astype(np.int64)))
        return pa.table([np.concatenate(x) for x in zip(*out)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64())], ["block", "place", "cost"])

    left = bag.withColumn("group", F.pmod("block", F.lit(groups))).groupBy("shard", "group")
    right = costs.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).groupBy("shard", "group")
    return left.cogroup(right).applyInArrow(run, "block long, place int, cost long")


def costed(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS) -> DataFrame:
    """(id, lang, _digest, _cost, _symbols) of every row of docs: the MD5 of its text, the sum of -log p over the whole text
    by the model of the other folds' trusted texts, and its length. trusted has the ids of these under id_col. Each text is
    in the fold of its hash, so neither it nor its copies teach the model that scores it."""
    with batches_of(docs.sparkSession, TEXTS):
        dealt, _ = spool(deal(docs, id_col, text_col, lang_col, folds), "bags")
    runs, bag = dealt.where("place IS NOT NULL").select(*DOC), dealt.where("shard IS NOT NULL").select("block", *BAG)
    good = runs.join(trusted.select(F.col(id_col).alias("id")), "id", "left_semi")
    marks, _ = spool(good.groupBy("block").agg(F.sort_array(F.collect_list(F.col("place").cast("short"))).alias("marks")), "marks")
    with batches_of(docs.sparkSession, BAGS):
        grams, _ = spool(counted(bag, marks, folds), "counts")
    by_fold = F.transform(F.sort_array(F.collect_list(F.struct("fold", (-F.log(F.greatest("p", F.lit(LEAST))) / UNIT).cast("long").alias("cost")))), lambda x: x["cost"])
    costs, _ = spool(grams.select("shard", "gram").join(probabilities(grams, folds).groupBy("gram").agg(by_fold.alias("costs")), "gram"), "costs")
    blocks = runs.select("block").distinct().count()
    sums = summed(bag, costs, blocks, folds).groupBy("block", "place").agg(F.sum("cost").alias("cost"))
    found = runs.join(sums, ["block", "place"], "left").groupBy("home").agg(*[F.first(c).alias(c) for c in ("id", "lang", "digest")], (F.coalesce(F.sum("cost"), F.lit(0)) * UNIT).alias("_cost"), F.sum("symbols").alias("_symbols"))
    return found.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.col("digest").alias("_digest"), "_cost", "_symbols")
