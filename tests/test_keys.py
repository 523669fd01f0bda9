"""Ranks by blocks, maps from numbers to dimension keys, curves of any scores, densities and probes."""

import socket

import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, keys, metrics
from gridloom.plans import warehouse
from gridloom.sources import probe


def test_ranks_go_on_over_blocks(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")).alias("a"), (F.col("id") % 3).cast("decimal(5,2)").alias("b"))
    rows = rows.union(spark.sql("SELECT CAST(NULL AS STRING), CAST(1 AS DECIMAL(5,2)) UNION ALL SELECT 'k5', NULL"))
    block = keys.blocks(rows, ["a", "b"], sample=400, size=100)
    assert 10 < rows.select(block.alias("x")).distinct().count() <= 100
    found = [tuple(r) for r in keys.ranked(rows, ["a", "b"], "k", block).collect()]
    order = sorted({r[:2] for r in found}, key=lambda r: [(v is not None, v) for v in r])
    assert {r[:2]: r[2] for r in found} == {r: i + 1 for i, r in enumerate(order)} and len(found) == 3002
    assert sorted(found, key=str) == sorted((tuple(r) for r in keys.ranked(rows, ["a", "b"], "k").collect()), key=str)


def test_blocks_of_few_values_are_one(spark):
    rows = spark.createDataFrame([("x",), ("y",)], "a string")
    assert [r.k for r in keys.ranked(rows, ["a"], "k", keys.blocks(rows, ["a"])).orderBy("a").collect()] == [1, 2]
    assert keys.ranked(rows.limit(0), ["a"], "k", keys.blocks(rows.limit(0), ["a"])).count() == 0


def test_facts_hold_nothing(spark):
    """No table stays held, and labels of products, clients and stores do not travel with the lines."""
    sf, held = "/root/testdata/sf0.001", spark.sparkContext._jsc.getPersistentRDDs().size()
    out = warehouse.QUERIES["fact_ventes_A"](spark, sf)
    assert out.count() > 0 and spark.sparkContext._jsc.getPersistentRDDs().size() == held
    source, known = warehouse.key_map(spark, sf, ["product", "category"], "product_id")
    assert source == ["part_key"] and sorted(known.columns) == ["cost", "part_key", "product_id"]


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_curve_of_any_scores(spark, scale):
    rows = spark.range(5000).select(((F.xxhash64("id") % 1000) * scale).alias("score"), (F.xxhash64("id", F.lit(1)) % 3 == 0).alias("positive"))
    data = [(r.score, r.positive) for r in rows.collect()]
    pos, neg = [s for s, p in data if p], [s for s, p in data if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    curve = metrics.roc(rows, "positive", "score")
    assert metrics.auc(curve).first().auc == pytest.approx(want)
    last = curve.orderBy("score").first()
    assert (last.tpr, last.fpr) == (1.0, 1.0) and curve.count() == len({s for s, _ in data})


def test_density_counts_equal_values(spark):
    rows = spark.createDataFrame([(1.0,)] * 3 + [(2.0,), (5.0,), (None,)], "v double")
    got = {r.x: r.density for r in features.density(rows, "v", 5, 1.0).collect()}
    from math import exp, pi

    want = {x: sum(exp(-((x - v) ** 2) / 2) for v in (1, 1, 1, 2, 5)) / (5 * (2 * pi) ** 0.5) for x in (1.0, 2.0, 3.0, 4.0, 5.0)}
    assert got == pytest.approx(want, abs=1e-8)
    assert features.density(rows.where("v = 1"), "v", 5, 1.0).count() == 1 and features.density(rows.limit(0), "v", 5, 1.0).count() == 0


def test_probe_connects(spark):
    with socket.create_server(("127.0.0.1", 0)) as server, socket.create_server(("127.0.0.1", 0)) as closed:
        live, dead = server.getsockname()[1], closed.getsockname()[1]
        closed.close()
        rows = spark.createDataFrame([(1, "127.0.0.1", live), (2, "127.0.0.1", dead), (3, None, live), (4, "127.0.0.1", None), (5, "127.0.0.1", live), (6, "127.0.0.1", 70000)], "id int, host string, port int")
        found = {r.id: r.connected for r in probe.probe(rows, timeout=1.0).collect()}
    assert found == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert probe.probe(rows.limit(0)).count() == 0
