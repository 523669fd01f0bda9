"""Surrogate keys, fan-out and constraint checks."""

from __future__ import annotations

from math import ceil

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dimension(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Distinct rows of the columns with a key from 1 in their order, null first; for dimensions with few labels."""
    order = Window.orderBy(*[F.col(c).asc_nulls_first() for c in columns])
    return df.select(*columns).distinct().select(F.row_number().over(order).alias(key), *columns)


def sequence(df: DataFrame, order: list[str | Column], key: str, after: int = 0) -> DataFrame:
    """All rows with consecutive keys from after + 1 in a total order.

    Rows are dealt out by ranges of the order and numbered within each; the sizes of the ranges, a number for each
    partition, give the offsets. No task sees all rows.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    out = dealt.withColumn("_place", place).join(F.broadcast(offsets), "_part")  # one row per partition
    return out.withColumn(key, (F.col("_before") + F.col("_place") + after).cast("long")).drop("_part", "_before", "_place")


#: Distinct values on the driver from which blocks are bounded, and distinct values of a block, about.
SAMPLE, BLOCK = 4096, 100_000


def blocks(df: DataFrame, columns: list[str], sample: int = SAMPLE, size: int = BLOCK) -> Column:
    """The number of a row's block, in the order of the columns, nulls first; equal values are in one block.

    Of df's distinct values the `sample` with the least hashes come to the driver. They are a random sample, the same one
    each time, whose largest hash tells how many there are; so blocks hold about `size` of them, but are sample / 4 at
    most. The bounds are constants: a block computed anew, after the loss of an executor, is the same.
    """
    found = df.select(*columns, F.xxhash64(*columns).alias("_hash")).distinct().orderBy("_hash").limit(sample).collect()
    share = (found[-1]["_hash"] + 2**63) / 2**64 if len(found) == sample else 1.0
    n = min(sample // 4, ceil(len(found) / max(share, 2.0**-64) / size))
    if n <= 1:
        return F.lit(0)
    ordered = sorted((tuple(r)[:-1] for r in found), key=lambda r: [(v is not None, v) for v in r])
    kinds = {f.name: f.dataType for f in df.schema}
    bounds = [ordered[i * len(ordered) // n] for i in range(1, n)]
    edges = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(columns, b)]) for b in bounds])
    return F.size(F.filter(edges, lambda b: b <= F.struct(*columns)))


def ranked(df: DataFrame, columns: list[str], key: str, block: Column | None = None) -> DataFrame:
    """All rows with the dense rank, from 1, of the columns, nulls first. Blocks are ranked one by one and go on after the
    distinct values of those before; without blocks one task ranks all, which is for columns of few values. Nothing is
    held: blocks come out alike whenever they are made."""
    own = df.withColumn("_block", F.lit(0) if block is None else block)
    place = F.dense_rank().over(Window.partitionBy("_block").orderBy(*[F.col(c).asc_nulls_first() for c in columns]))
    sizes = own.select("_block", *columns).distinct().groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if block is None:
        return own.withColumn(key, place.cast("long")).drop("_block")
    offsets = F.broadcast(sizes.select("_block", before.alias("_before")))  # a row for each block
    return own.withColumn("_place", place).join(offsets, "_block").withColumn(key, (F.col("_before") + F.col("_place")).cast("long")).drop("_block", "_before", "_place")


def fan_out(dim: DataFrame, label: str) -> DataFrame:
    """Labels that several rows of a dimension bear, so a join by label alone multiplies rows."""
    return dim.groupBy(label).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def resolve(df: DataFrame, dim: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Join with a dimension on all natural keys (strict) or, as a label join would, on the first alone."""
    on = keys if strict else keys[:1]
    return df.join(dim.drop(*[k for k in keys if k not in on]), on)


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Violations of a UNIQUE constraint."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def orphans(df: DataFrame, parent: DataFrame, column: str, parent_column: str) -> DataFrame:
    """Violations of a foreign key: values without parent row, null excepted."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")
