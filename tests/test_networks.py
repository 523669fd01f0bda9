import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import learners


def table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label int")


@pytest.mark.parametrize("adam,part_rows", [(False, 1000), (True, 1000), (True, 30)])
def test_parts_are_averaged(spark, adam, part_rows):
    """Against plain steps over the same parts, averaged after each epoch."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 4)) + 3 * np.eye(4)[y]
    df, plan = table(spark, x, y), learners.Plan("n", [4, 5, 3], adam, 0.05, 8)
    found = learners.fit_networks(df, [plan], "relu", 3, part_rows=part_rows)["n"]
    n = -(-90 // part_rows)
    dealt = df.repartition(n, "id").select("id", F.spark_partition_id().alias("p")).collect()
    parts = [sorted(r.id for r in dealt if r.p == p) for p in range(n)]
    state, steps = plan.network("relu").state(), 0
    for epoch in range(3):
        out = []
        for own in filter(None, parts):
            net = plan.network("relu").load(state, steps)
            net.epoch(x[own], y[own], np.random.default_rng([epoch, own[0]]).permutation(np.arange(len(own))))
            out.append((net.state(), len(own), net.steps))
        state = sum(s * m for s, m, _ in out) / 90
        steps = round(sum(k * m for _, m, k in out) / 90)
    np.testing.assert_allclose(found, state, atol=1e-9)


def test_learns_and_stops(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 3)) + 4 * np.eye(3)[y]
    df = table(spark, x, y)
    plans = [learners.Plan("sgd", [3, 8, 3], False, 0.1, 16), learners.Plan("adam", [3, 8, 3], True, 0.01, 16)]
    found = learners.fit_networks(df, plans, "relu", 40, validation=0.2, part_rows=150)
    for plan in plans:
        assert (plan.network("relu").load(found[plan.name]).predict(x) == y).mean() > 0.95
    assert learners.fit_networks(df.limit(0), plans, "relu", 3) == {}
