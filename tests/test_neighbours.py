import numpy as np
import pytest

from gridloom.operators import neighbours


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)


def brute(x, y, k, p):
    out = set()
    for i, v in enumerate(y):
        d = neighbours.distances(v[None], x, p)[0]
        out |= {(1000 + i, r + 1, int(j)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d))[:k])}
    return out


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("pivots,part", [(1, 8192), (7, 5), (40, 8192)])
def test_against_all_pairs(spark, p, pivots, part):
    """Random, clustered, repeated and gridded vectors, whose distances tie."""
    rng = np.random.default_rng(int(10 * p) + pivots)
    kinds = [rng.normal(size=(60, 3)), rng.normal(size=(60, 3)) * 0.1 + 9 * rng.integers(0, 3, (60, 1)), np.repeat(rng.normal(size=(6, 3)), 10, axis=0), rng.integers(0, 3, (60, 3)).astype(float)]
    x, y = np.concatenate(kinds), np.concatenate([k[:8] + (0.01 if i < 2 else 0) for i, k in enumerate(kinds)])
    found = neighbours.nearest(table(spark, x), table(spark, y, 1000), 4, p, pivots=pivots, part=part)
    assert {(r.test_id, r["rank"], r.train_id) for r in found.collect()} == brute(x, y, 4, p)


def test_few_rows_and_none(spark):
    x = np.arange(6.0).reshape(3, 2)
    assert neighbours.nearest(table(spark, x), table(spark, x, 1000), 9).count() == 9
    assert neighbours.nearest(table(spark, x).limit(0), table(spark, x, 1000), 2).count() == 0
    assert neighbours.nearest(table(spark, x), table(spark, x, 1000).limit(0), 2).count() == 0


def test_most_cells_are_not_visited(spark):
    """In clustered data a query is compared with the rows of few cells."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 10
    x = np.concatenate([c + rng.normal(size=(50, 8)) for c in centres])
    y = x[::10] + 0.01
    known = neighbours.cells(table(spark, x), 5, 2, pivots=60)
    assert known.size.sum() == len(x)
    sent = [(r.cell, r.id) for r in neighbours.routed(table(spark, y, 5000), known).collect()]
    share = sum(known.size[c] for c, _ in sent) / (len(x) * len(y))
    assert share < 0.15


def votes(d, ids, labels, k):
    near = [labels[j] for j in np.lexsort((ids, d))[:k]]
    return min(set(near), key=lambda c: (-near.count(c), c)) if near else None


def test_shares_equal_separate_runs(spark):
    """Gridded vectors tie; every share is what a run on its rows alone gives, the own fold left out."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (90, 3)).astype(float)
    fold, number = rng.integers(0, 3, 90), rng.integers(1, 5, 90)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(fold[i]), int(number[i])) for i in range(90)], "id long, x array<double>, fold int, number int").repartition(3)
    found = {(r.share, r.test_id, r["rank"], r.train_id) for r in neighbours.by_share(rows, 4, 4).collect()}
    want = set()
    for share in range(1, 5):
        for i in range(90):
            held = np.flatnonzero((fold != fold[i]) & (number <= share))
            d = neighbours.distances(x[i : i + 1], x[held], 2)[0]
            want |= {(share, i, r + 1, int(held[j])) for r, j in enumerate(np.lexsort((held, d))[:4])}
    assert found == want
    assert neighbours.by_share(rows.limit(0), 4, 4).count() == 0


@pytest.mark.parametrize("tile", [2048, 7])
def test_exchanged_components_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "ROWS", tile)
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(40, 3)) * 4) / 4, np.round(rng.normal(size=(9, 3)) * 4) / 4
    labels = rng.integers(0, 3, 40)
    others = np.stack([np.roll(y, r + 1, axis=0) for r in range(2)], axis=1)
    train = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "id long, x array<double>, label int").repartition(3)
    test = spark.createDataFrame([(100 + i, v.tolist(), o.tolist()) for i, (v, o) in enumerate(zip(y, others))], "id long, x array<double>, others array<array<double>>")
    want = set()
    for i, v in enumerate(y):
        variants = {(-1, -1): v} | {(f, r): np.where(np.arange(3) == f, others[i, r], v) for f in range(3) for r in range(2)}
        want |= {(100 + i, f, r, int(votes(((w - x) ** 2).sum(axis=1), np.arange(40), labels, 5))) for (f, r), w in variants.items()}
    assert {tuple(r) for r in neighbours.exchanged(train, test, 5, 2).collect()} == want
    assert neighbours.exchanged(train, test.limit(0), 5, 2).count() == 0
    assert neighbours.exchanged(train.limit(0), test, 5, 2).count() == 0


def test_variants_are_measured_on_few_rows(monkeypatch):
    """Of the pairs of a variant and a row a small share is measured, and the k nearest are those of all of them."""
    rng = np.random.default_rng(8)
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(4000, 32)), rng.normal(size=(9, 32))))
    others = np.stack([np.roll(q, r, axis=0) for r in (1, 2)], axis=1)
    measured, plain = [], neighbours._Exchanged.measure
    monkeypatch.setattr(neighbours._Exchanged, "measure", lambda self, i, v, *rest: measured.append(len(v)) or plain(self, i, v, *rest))
    fold = neighbours._Exchanged(np.arange(9), np.c_[q, others.reshape(9, -1)], 5, 2)
    for at in range(0, 4000, 1000):
        fold.read(np.arange(at, at + 1000), np.c_[np.zeros(1000), x[at : at + 1000]])
    assert sum(measured) < 0.05 * 9 * 65 * 4000
    for i in (0, 4):
        for f in range(32):
            for r in (0, 1):
                d = ((np.where(np.arange(32) == f, others[i, r], q[i]) - x) ** 2).sum(axis=1)
                assert fold.id[i, 1 + 2 * f + r].tolist() == np.argsort(d)[:5].tolist()


@pytest.mark.parametrize("p", [1, 2, 3])
def test_nearest_rows_measure_few_pairs(monkeypatch, p):
    """The k nearest of all, with the distances of all pairs; for p of 2 and 3 few pairs are measured."""
    rng = np.random.default_rng(11)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(20, 64)), rng.normal(size=(3000, 64))))
    y[7] = y[2000]
    d = neighbours.distances(x, y, p)
    seen, plain = [], neighbours._pairs
    monkeypatch.setattr(neighbours, "_pairs", lambda *a: seen.append(len(a[2])) or plain(*a))
    near, found = neighbours.nearest_rows(x, y, 5, p)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (near == want).all() and (found == np.take_along_axis(d, want, axis=1)).all()
    assert p == 1 or sum(seen) < 0.2 * d.size
