"""Shared-folder tables, table access and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context. Where neither is
    set, as in tests, a local session gets a temporary one; on a cluster that would lose rows, so it is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


#: Tables that spool wrote in the scopes that are open, innermost last; outside a scope none are noted.
_scopes: list[list[str]] = []


def spool(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage; also returns the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def unspool(spark: SparkSession, path: str) -> None:
    """Delete a spooled table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was spooled inside it. For work whose result is written before that: results that are read
    later, outside of any scope, keep their tables, whatever other work does meanwhile."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            unspool(spark, path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in the work that is run inside, for rows that hold whole texts or sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with Arrow's unused memory given back at its end: the worker lives on, beside the tasks that come next."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return runs


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of a filter for each key, up to so many words of 64 bits (2 MB); with more keys than that fills it lets more pass.
FILTER_BITS, FILTER_WORDS = 16, 1 << 18


def membership(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test of 64-bit hashes, true for all in hashes (h) and for few others: a Bloom filter of two bits a key."""
    wanted, words = hashes.count() * FILTER_BITS // 64, 1
    while words < min(wanted, FILTER_WORDS):
        words *= 2
    bits = lambda h: [x.bitwiseAND(64 * words - 1) for x in (h, F.shiftrightunsigned(h, 32))]
    places = hashes.select(F.explode(F.array(*bits(F.col("h")))).alias("p"))
    found = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits"))
    line = hashes.sparkSession.range(words).join(found, F.col("id") == F.col("w"), "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    held, _ = spool(line.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("words")), "filter")

    def test(h: Column) -> Column:
        first, second = (F.bit_get(F.get(held.scalar(), F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1 for p in bits(h))
        return first & second

    return test


def without(rows: DataFrame, gone: DataFrame, on: Column | list[str], own: Column, others: Column) -> DataFrame:
    """rows left_anti gone, for gone rows that are few beside rows with whole texts. own and others are a hash of the key,
    of rows and of gone; rows that a filter of the others' excludes stay where they are, only the rest move to the join."""
    maybe = membership(gone.select(others.alias("h")))(own)
    return rows.where(~maybe).union(rows.where(maybe).join(gone, on, "left_anti").select(*rows.columns))


#: Edges of a node that meet its minimum in one task, at least, and nodes of more edges, at most.
SPLIT, LARGE_NODES = 1024, 100_000


def _with_minimum(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with the column m of least (u, m, n), n being the number of the node's edges. Edges of nodes with very
    many are dealt to parts; of such nodes there are LARGE_NODES at most, as they share the `n` edges."""
    split = max(SPLIT, 2 * n // LARGE_NODES)
    large = least.where(F.col("n") > split).select("u", F.ceil(F.col("n") / split).cast("int").alias("parts"))
    dealt = edges.join(F.broadcast(large), "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), "parts").cast("int"), F.lit(0))).drop("parts")
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / split).cast("int"), F.lit(1)) - 1))
    return dealt.join(least.select("u", "m", parts.alias("part")), ["u", "part"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps, each a pre-aggregated minimum per node and an equi-join that deals a hub's
    edges to parts, until the edge set stands still. Every round is written to the shared folder, so neither lineage nor
    the driver grows.
    """
    spark = edges.sparkSession
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, path = spool(oriented, "edges")
    seen = _digest(current)
    while seen[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_minimum(both, lowest, 2 * seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = spool(large, "edges")
        parent = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_minimum(large, parent, 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = small.union(parent.select("u", F.col("m").alias("v"))).distinct()
        following, next_path = spool(step, "edges")
        unspool(spark, path)
        unspool(spark, large_path)
        current, path, now = following, next_path, _digest(following)
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(
        F.count("*"),
        F.coalesce(F.sum(F.shiftright(F.xxhash64("u", "v"), 20)), F.lit(0)),
        F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0)),
    ).first()
    return tuple(row)
