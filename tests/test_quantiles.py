import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import features
from gridloom.operators.quantiles import _inside, bounds, quantiles

PROBS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def values(kind, n, rng):
    return {
        "distinct": lambda: [rng.random() for _ in range(n)], "few": lambda: [float(rng.randrange(3)) for _ in range(n)], "one": lambda: [7.5] * n,
        "tails": lambda: [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(n)], "spike": lambda: [0.0 if rng.random() < 0.7 else rng.gauss(0, 1) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("limit,accuracy,proposals", [(10**6, 10_000, 1024), (5, 50, 8), (40, 1000, 16)])
def test_against_sorting(spark, limit, accuracy, proposals):
    rng = random.Random(1)
    held = {(g, k): values(k, n, rng) for g, (k, n) in enumerate([("distinct", 900), ("few", 500), ("one", 300), ("tails", 700), ("spike", 800), ("distinct", 1), ("distinct", 2), ("few", 3)])}
    rows = [(None if g == 4 else g, x) for (g, _), xs in held.items() for x in [*xs, None]] + [(99, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, x double").repartition(3)
    found = {r.g: r for r in quantiles(df, "x", PROBS, ["g"], limit, accuracy, proposals).collect()}
    assert set(found) == {None if g == 4 else g for g, _ in held}
    for (g, _), xs in held.items():
        xs, r = sorted(xs), found[None if g == 4 else g]
        assert r.n == len(xs)
        for i, p in enumerate(PROBS):
            at = p * (len(xs) - 1)
            low, part = math.floor(at), at - math.floor(at)
            want = (1 - part) * xs[low] + part * xs[min(low + 1, len(xs) - 1)]
            assert r[f"q{i}"] == want, (g, p)
    whole = quantiles(df, "x", [0.5], limit=limit, accuracy=accuracy, proposals=proposals).first()
    assert whole.q0 == df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert quantiles(df.limit(0), "x", [0.5]).count() == 0 and quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0


def test_ten_million_distinct_values(spark):
    """What lies between the bounds stays under the limit, and the bounds are right."""
    n = 10_000_000
    rows = spark.range(n).select(F.pmod(F.col("id") * 48271, F.lit(n)).cast("double").alias("_v"))
    state = bounds(rows, [0.5, 0.999], [], limit=1000, accuracy=1000, proposals=256)
    inside, t = state.select(F.transform("t", _inside), "t").first()
    assert max(inside) <= 1000
    for x, p in zip(t, (0.5, 0.999)):
        assert x.rank == math.floor(p * (n - 1)) and x.lo <= x.rank and x.rank + 1 <= x.hi and x.below == x.lo
    r = quantiles(rows, "_v", [0.5, 0.999], limit=1000, accuracy=1000, proposals=256).first()
    assert (r.q0, r.q1) == pytest.approx((0.5 * (n - 1), 0.999 * (n - 1)), rel=1e-15)


def test_features_use_them(spark):
    rng = np.random.default_rng(2)
    xs = rng.gamma(1.0, 5.0, 400)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, x double")
    train = xs[[i % 5 != 0 for i in range(400)]]
    q1, q3 = np.quantile(train, [0.25, 0.75])
    found = {r.id: r.x for r in features.winsorize(df, "x", "id % 5 <> 0").collect()}
    assert [found[i] for i in range(400)] == pytest.approx(np.minimum(xs, q3 + 1.5 * (q3 - q1)).tolist())
