import numpy as np
import pytest

from gridloom.operators import learners


def table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, label int")


def dual(x, y, model):
    """The objective that a fit maximises."""
    sv, coef = np.array([list(v) for v in model.sv]), np.array(model.coef)
    return np.abs(coef).sum() - 0.5 * coef @ learners.rbf(sv, sv, 0.5) @ coef


@pytest.mark.parametrize("noise", [0.0, 0.15])
def test_cascade_reaches_one_fit(spark, noise):
    """Parts of 60 rows against one fit of all: the same objective, and the same side for nearly all rows."""
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, size=(200, 2))
    y = ((x**2).sum(axis=1) > 2.2).astype(int)
    y = np.where(rng.random(200) < noise, 1 - y, y)
    df = table(spark, x, y)
    whole, parts = (learners.one_vs_one(df, [0, 1], fit_rows=n).first() for n in (1000, 60))
    assert dual(x, y, parts) == pytest.approx(dual(x, y, whole), rel=0.03)
    side = lambda m: learners.rbf(x, np.array([list(v) for v in m.sv]), 0.5) @ np.array(m.coef) + m.b >= 0
    assert (side(whole) == side(parts)).mean() > 0.97


def test_whole_pairs_and_width(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 4)) + 3 * np.eye(4)[y]
    df = table(spark, x, y)
    gamma = learners.scale_gamma(df)
    assert gamma == pytest.approx(1 / (4 * x.var()))
    models = learners.one_vs_one(df, [0, 1, 2], gamma=gamma, fit_rows=30)
    assert models.count() == 3
    found = {r.id: r.predicted for r in learners.vote(df, models, gamma).collect()}
    assert np.mean([found[i] == t for i, t in enumerate(y)]) > 0.9
    assert learners.one_vs_one(df.limit(0), [0, 1]).count() == 0 and learners.scale_gamma(df.limit(0)) == 1.0


def test_working_sets_reach_the_whole_kernels_fit(monkeypatch):
    """A fit that holds a small part of its kernel, from nothing and from the weights of a part, against one that holds all."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    y = np.where((x**2).sum(axis=1) + rng.normal(size=300) > 2.5, 1.0, -1.0)
    whole = learners.Smo(tolerance=1e-6).fit(x, y)
    monkeypatch.setattr(learners, "KERNEL_ROWS", 50)
    monkeypatch.setattr(learners, "KERNEL_PART", 6000)
    sizes, plain = [], learners.rbf
    monkeypatch.setattr(learners, "rbf", lambda a, b, g: sizes.append(len(a) * len(b)) or plain(a, b, g))
    start = np.zeros(300)
    start[:150] = learners.Smo(tolerance=1e-6).fit(x[:150], y[:150]).a
    for model in (learners.Smo(tolerance=1e-6).fit(x, y), learners.Smo(tolerance=1e-6).fit(x, y, start)):
        np.testing.assert_allclose(model.a, whole.a, atol=1e-3)
        assert model.b == pytest.approx(whole.b, abs=1e-4)
    assert max(sizes) <= 6000


def test_votes_and_decisions_of_distributed_models(spark):
    """Against decisions made row by row from the models; a vector serves several pairs."""
    rng = np.random.default_rng(10)
    y = rng.integers(0, 3, 120)
    x = rng.normal(size=(120, 4)) + 1.5 * np.eye(4)[y]
    df = table(spark, x, y)
    models = learners.one_vs_one(df, [0, 1, 2])
    pairs = sorted(models.collect(), key=lambda m: (m.c1, m.c2))
    want = np.stack([learners.rbf(x, np.array([list(v) for v in m.sv]), 0.5) @ np.array(m.coef) + m.b for m in pairs], axis=1)
    found = {r.id: r.f for r in learners.decisions(df, models).collect()}
    np.testing.assert_allclose([found[i] for i in range(120)], want)
    total = np.stack([sum((want[:, i] >= 0) if m.c1 == c else (want[:, i] < 0) for i, m in enumerate(pairs) if c in (m.c1, m.c2)) for c in range(3)], axis=1)
    assert {r.id: r.predicted for r in learners.vote(df, models).collect()} == dict(enumerate(total.argmax(axis=1)))
