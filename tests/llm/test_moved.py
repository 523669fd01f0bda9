"""What whole-text stages move, and that what stays where it is is judged alike."""

import random

import pytest
from pyspark.sql import functions as F
from test_dedup import test_cut_and_extended_copies as cut_and_extended_copies

import corpus_pipeline
from gridloom.llm import common, simhash


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("words", [1, 1 << 18])
def test_without_is_an_anti_join(spark, monkeypatch, words):
    """With a filter that excludes few, too; repeated rows, a null in the key, nothing gone."""
    monkeypatch.setattr(common, "FILTER_WORDS", words)
    rows = spark.range(2000).selectExpr("id % 1900 AS k", "IF(id % 3 = 0, NULL, 'x') AS lang", "id AS v")
    gone = spark.range(300).selectExpr("id * 5 AS k", "IF(id % 2 = 0, NULL, 'x') AS _lang").withColumnRenamed("k", "_k")
    for some in (gone, gone.limit(0)):
        same = (F.col("k") == F.col("_k")) & F.col("lang").eqNullSafe(F.col("_lang"))
        want = rows.join(some, same, "left_anti")
        found = common.without(rows, some, same, F.xxhash64("k"), F.xxhash64("_k"))
        assert sorted(r.v for r in found.collect()) == sorted(r.v for r in want.collect()) and found.columns == rows.columns


def test_filter_excludes_most(spark):
    test = common.membership(spark.range(1000).select(F.xxhash64("id").alias("h")))
    rows = spark.range(11_000).select("id", test(F.xxhash64("id")).alias("maybe"))
    assert rows.where("id < 1000 AND NOT maybe").count() == 0 and rows.where("id >= 1000 AND maybe").count() < 500


def test_near_dedup_moves_no_more_than_the_texts(spark, monkeypatch, tmp_path):
    """Long texts without copies but a few; joins by merge, as with tables too large to broadcast."""
    monkeypatch.setattr(simhash, "SAMPLE", 10)
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(1500)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(300 + i, t + " end") for i, t in enumerate(texts[:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    assert docs.count() == 306
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        corpus_pipeline.near_dedup_stage(spark, docs, "").write.parquet(f"{tmp_path}/out")
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == set(range(300))
    assert moved < 1.2 * sum(len(t) for _, t in rows)


def test_shingles_that_share_a_number(spark, monkeypatch):
    """With one byte of each hash most numbers stand for several shingles, and no similar pair is lost."""
    monkeypatch.setattr(simhash, "LOW", 1)
    cut_and_extended_copies(spark, monkeypatch, 64, 50, 1 << 14)
