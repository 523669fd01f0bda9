import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, gram


def pairwise(x):
    """r of each pair from the rows where both are known, None where it has none."""
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            u, v = x[both, i], x[both, j]
            flat = not both.any() or (u == u[0]).all() or (v == v[0]).all()
            out[f"c{i}", f"c{j}"] = None if flat else np.corrcoef(u, v)[0, 1]
    return out


def frame(spark, x, parts=5):
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(parts)


def same(found, want, far=None):
    """Equal to 1e-9; to 1e-7 with a column whose values near 1e9 are themselves no finer."""
    got = {(r.a, r.b): r.r for r in found.collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k] is None) == (r is None) and (r is None or abs(got[k] - r) < (1e-7 if far in k else 1e-9)), k


@pytest.mark.parametrize("rows,merge,parts", [(4096, 16, 5), (7, 2, 9)])
def test_missing_constant_and_far_columns(spark, monkeypatch, rows, merge, parts):
    monkeypatch.setattr(gram, "ROWS", rows)
    monkeypatch.setattr(gram, "MERGE", merge)
    monkeypatch.setattr(gram, "STRIP", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 9))
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=120) * 1e-3
    x[:, 2], x[:, 3] = 0.1, 1e9 + x[:, 3]
    x[:, 5] = -x[:, 4]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan
    x[:60, 7], x[60:, 8] = np.nan, np.nan
    same(gram.correlations(frame(spark, x, parts), [f"c{i}" for i in range(9)]), pairwise(x), "c3")


def test_500_columns(spark):
    """The plan is as short as for two columns."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 500)) + rng.normal(size=(60, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    data, names = frame(spark, x), [f"c{i}" for i in range(500)]
    same(gram.correlations(data, names), pairwise(x))
    kept = {r.name for r in features.correlation_filter(data, names, 0.8).where("kept").collect()}
    late = {b for (_, b), r in pairwise(x).items() if r is not None and abs(r) > 0.8}
    assert kept == set(names) - late


def test_nothing_and_values_that_are_none(spark):
    schema = "c0 double, c1 double, c2 double"
    assert gram.correlations(spark.createDataFrame([], schema), ["c0"]).count() == 0
    rows = spark.createDataFrame([(1.0, 2.0, None), (2.0, 5.0, 1.0), (float("nan"), None, 3.0), (3.0, 1.0, 7.0)], schema)
    got = {(r.a, r.b): r.r for r in gram.correlations(rows, ["c0", "c1", "c2"]).collect()}
    assert got["c0", "c2"] is None and abs(got["c0", "c1"] - np.corrcoef([1, 2, 3], [2, 5, 1])[0, 1]) < 1e-12
    assert gram.correlations(rows.where(F.lit(False)), ["c0", "c1"]).count() == 0
    assert {r.kept for r in features.correlation_filter(rows.where(F.lit(False)), ["c0", "c1"], 0.8).collect()} == {True}


def test_few_columns_as_many(spark):
    """The plan for few columns gives what the blocks give."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 3.0
    data, names = frame(spark, x), [f"c{i}" for i in range(5)]
    for found in (features.correlations(data, names), gram.correlations(data, names)):
        same(found, pairwise(x))
    assert features.correlations(data.limit(0), names).count() == 0
