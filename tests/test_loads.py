import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.operators import loads
from gridloom.sources import database


@pytest.fixture
def store(spark, tmp_path):
    return loads.Store(spark, f"t_{uuid.uuid4().hex[:8]}", "k BIGINT, x STRING", f"file://{tmp_path}/t")


def held(store):
    return sorted((tuple(r) for r in store.rows().collect()), key=str)


def test_failed_loads_leave_the_old_rows(spark, store, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, x string")
    assert held(store) == []
    store.replace(rows, loads.unique("k"))
    with pytest.raises(loads.Rejected):
        store.replace(rows.union(rows), loads.unique("k"))
    with pytest.raises(loads.Rejected):
        store.replace(rows, loads.not_null("x"))
    with pytest.raises(loads.Rejected):
        store.replace(rows, loads.refers("k", spark.range(2), "id"))
    with pytest.raises(Exception, match="half-way"):
        store.replace(spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") == 900, F.raise_error(F.lit("half-way"))).otherwise("y").alias("x")).withColumnRenamed("id", "k"))
    assert held(store) == [(1, "a"), (2, None)]
    assert len(list((tmp_path / "t").iterdir())) == 1  # failed stages are gone
    store.replace(rows.where("k = 2"), loads.refers("k", spark.range(5), "id"))
    assert held(store) == [(2, None)]


def test_append_doubles_nothing(spark, store):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, x string")
    for batch in (rows.where("k = 1"), rows, rows, rows.withColumn("more", F.lit(1))):
        store.append(batch, ["k"], loads.unique("k"))
    assert held(store) == [(1, "a"), (2, "b"), (None, "c")]
    with pytest.raises(loads.Rejected):
        store.append(spark.createDataFrame([(7, "x"), (7, "y")], "k long, x string"), ["k"], loads.unique("k"))
    assert len(held(store)) == 3


def test_keys_go_on(spark):
    known, want, last = spark.createDataFrame([], "id long, x string"), {}, 0
    for batch in (["b", "a", None, "a"], ["c", None, "a"], ["c", None, "a"], ["", "z", "b"]):
        for x in sorted({x for x in batch if x not in want}, key=lambda x: (x is not None, x or "")):
            last += 1
            want[x] = last
        known = spark.createDataFrame(loads.extended(known, spark.createDataFrame([(x,) for x in batch], "x string"), "x", "id").collect(), "id long, x string")
    assert {r.x: r.id for r in known.collect()} == want and known.count() == len(want)


def test_database(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"
    rows = spark.range(1000).select(F.expr("nullif(id, -1)").alias("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), F.col("id"))).alias("name"))
    for part in (rows.where("id < 400"), rows.where("id >= 400"), spark.createDataFrame([(None, "none")], "id long, name string")):
        database.append(part, url, "things", connections=3)
    found = database.read(spark, url, "SELECT * FROM things", '"id"', rows=100)
    assert found.select(F.spark_partition_id()).distinct().count() > 5
    assert sorted(map(str, found.collect())) == sorted(map(str, [*rows.collect(), *spark.createDataFrame([(None, "none")], "id long, name string").collect()]))
    plan = found.where("id > 990")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,990)]" in plan
    assert database.read(spark, url, 'SELECT count(*) AS "n" FROM things').first()[0] == 1001
    assert database.read(spark, url, 'SELECT * FROM things WHERE 1 = 0', '"id"').count() == 0
