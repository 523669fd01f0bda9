"""The corpus pipeline: quality, exact and near duplicates, mixing and packing, each stage written before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, mixing, packing, quality, simhash
from gridloom.llm.common import scratch, shared_dir, spool, table, unspool, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose perplexity exceeds that of nearly all trusted ones of their language."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; texts are linked by shingles of five words, of which they
    share 0.8 or more. Rows are told apart by id and text."""
    dropped, _ = spool(simhash.verified_duplicates(docs, shingle=5, similarity=0.8).where("NOT kept").select("node", "digest"), "dropped")
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns of any name pass through under plain ones
    rows = docs.toDF(*names)
    place = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    keyed = rows.select("*", *simhash.row_keys(place["doc_id"], place["text"]))
    return without(keyed, dropped, ["node", "digest"], F.col("node"), F.col("node")).select(*names).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has no tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result is written for the next one; what it wrote for itself is deleted then, and
    so is its input."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            unspool(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
