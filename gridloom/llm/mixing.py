"""Operator 9 [native]: mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD

#: A group of equal source and size is dealt to so many blocks, in the order of a hash of the id.
BLOCKS = 1024
#: The hash: one step of the multiplicative generator modulo the prime 2^31 - 1.
_PRIME, _FACTOR = (1 << 31) - 1, 48271


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size), one row per source.

    Sources by code point, null last, weigh as the weights repeat. Targets share the sum of all sizes by weight and stop
    at `limit` times the source's size; what is over is shared again by weight until none is above. Closed form: in the
    order of limit to weight, the level is the largest quotient of the rest of the sum and the rest of the weights.
    The windows here run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int") + 1)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * limit).alias("most"))
    everything = Window.partitionBy(F.lit(1))
    rising = everything.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(rising), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0))
    level = rows.withColumn("level", rest / share).withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _spread(column: str) -> Column:
    mixed = F.pmod(F.pmod(F.coalesce(F.col(column), F.lit(0)), F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME))
    return F.shiftright(mixed, 21).cast("int")


def offset(source: str = "source") -> Column:
    """The one offset of a source, in [0, 1)."""
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(source), F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row, and the columns named in keep.

    Every document of a source expects target / source_size copies. In the order of size (largest first), hash of the
    id and id, the copies expected so far are summed, the source's offset is added, and a document is taken once for
    each whole number that its own share crosses: copies differ from the expected ones by less than one, and ordering
    by size keeps the words taken within about one large document of the target.
    The place of a document in its source comes from counts per (source, size, block) and prefix sums over these, so no
    task orders a whole source. Null texts have size 0, a null source is a source of its own, null ids come first.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *keep)
    rows = rows.withColumn("block", _spread("id"))
    blocks = rows.groupBy("source", "size", "block").agg(F.count("*").alias("n"))
    by_block = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before_block", F.coalesce(F.sum("n").over(by_block), F.lit(0)))
    sizes = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("source", "size", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("before_size"))
    goals = targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, limit)
    place = F.row_number().over(Window.partitionBy("source", "size", "block").orderBy(F.col("id").asc_nulls_first()))
    out = rows.withColumn("place", place)

    def joined(left: DataFrame, right: DataFrame, *names: str) -> DataFrame:
        right = right.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in right.columns if c not in names])
        on = [F.col("source").eqNullSafe(F.col("_source"))] + [F.col(n) == F.col(f"_{n}") for n in names[1:]]
        return left.join(right, on).drop(*[f"_{n}" for n in names])

    steps = joined(joined(blocks.drop("n"), before, "source", "size"), goals.drop("weight"), "source")
    out = joined(out, steps, "source", "size", "block")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("before_size") + F.col("before_block") + F.col("place")
    copies = F.floor(offset() + upto * rate) - F.floor(offset() + (upto - 1) * rate)
    copies = F.least(F.lit(limit), copies).cast("int")
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *keep)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix themselves, each as often as it was taken, with the columns of docs."""
    names = docs.columns
    packed = docs.withColumn("_row", F.struct(*[F.col(f"`{n}`") for n in names]))
    taken = mix(packed, keep=("_row",), **options)
    return taken.where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies"))).alias("_row")).select(*[F.col(f"_row.`{n}`") for n in names])
