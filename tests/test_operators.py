import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import functions as gf
from gridloom import streaming
from gridloom.operators import features, keys, learners, metrics, neighbours, series
from gridloom.plans import models
from gridloom.sources import delimited


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sequence_numbers_all_rows(spark):
    df = spark.range(1000).selectExpr("id % 37 AS a", "id AS b").repartition(5)
    out = keys.sequence(df, ["a", "b"], "k", after=10)
    assert rows(out.select("k", "a", "b")) == [(11 + i, a, b) for i, (a, b) in enumerate(sorted((i % 37, i) for i in range(1000)))]
    assert keys.sequence(df.limit(0), ["a"], "k").count() == 0


def test_dimension_keeps_one_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), (None,)], "x string")
    assert keys.dimension(df, ["x"], "k").orderBy("k").collect() == [(1, None), (2, "a"), (3, "b")]


def test_label_joins_fan_out(spark):
    dim = spark.createDataFrame([(1, "p", "x"), (2, "p", "y")], "k int, name string, parent string")
    facts = spark.createDataFrame([("p", "x")], "name string, parent string")
    assert keys.resolve(facts, dim, ["name", "parent"]).count() == 1
    assert keys.resolve(facts, dim, ["name", "parent"], strict=False).count() == 2
    assert rows(keys.fan_out(dim, "name")) == [("p", 2)]
    assert rows(keys.orphans(spark.createDataFrame([(3,), (None,), (1,)], "k int"), dim, "k", "k")) == [(3,)]


def test_text_repair(spark):
    df = spark.createDataFrame([("DÃ©connectÃ©",), ("Déconnecté",), ("plain",), ("€",), (None,)], "s string")
    assert [r[0] for r in df.select(gf.repair_text(F.col("s"))).collect()] == ["Déconnecté", "Déconnecté", "plain", "€", None]


def test_safe_ratio_and_codes(spark):
    df = spark.createDataFrame([(1.0, 0.0, "a"), (1.0, 2.0, "z"), (None, 2.0, None)], "x double, y double, s string")
    assert [tuple(r) for r in df.select(gf.safe_ratio(F.col("x"), F.col("y")), gf.codes(F.col("s"), {"a": 1})).collect()] == [(0.0, 1), (0.5, None), (0.0, None)]


def test_resample_fills_gaps(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 02:50:00", 2.0)], "t string, total double").withColumn("ts", F.to_timestamp("t"))
    out = series.resample(df, 45).orderBy("start").collect()
    assert [r["sum"] for r in out] == [1.0, 0.0, 0.0, 2.0] and out[-1]["start"].hour == 2 and out[-1]["start"].minute == 15


def test_counter_reset_gives_null(spark):
    df = spark.createDataFrame([("h", 1, 10), ("h", 2, 15), ("h", 3, 4), ("h", 4, 9)], "k string, t int, c int")
    assert [r.delta for r in series.deltas(df, "k", ["t"], "c").orderBy("t").collect()] == [None, 5, None, 5]


def test_stream_keeps_the_last_counter(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, counter long"
    for n, part in enumerate(([(1, 1, 10), (1, 2, 15)], [(1, 3, 4), (2, 4, 7)], [(1, 5, 9)])):
        df = spark.createDataFrame([(u, e, c) for u, e, c in part], "user_id long, event_id long, counter long").selectExpr("user_id", "event_id", "timestamp_seconds(event_id) AS ts", "counter")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.drain(streaming.delta(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert {r.event_id: r.delta for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: None, 2: 5, 3: None, 4: None, 5: 5}


def test_scaler(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0), (2.0, 3.0, 5.0), (4.0, 8.0, 5.0)], "a double, b double, c double")
    out = np.array(features.standardize(df, ["a", "b", "c"]).collect())
    assert out.mean(axis=0) == pytest.approx([0, 0, 0]) and out.std(axis=0) == pytest.approx([1, 1, 0])


def test_fitted_on_training_rows_only(spark):
    long = spark.createDataFrame([(i, "v", float(i)) for i in range(1, 5)] + [(5, "v", None), (10, "v", 100.0)] + [(i, "w", None) for i in range(1, 11)], "id int, name string, v double")
    out = {r.id: r.v for r in features.impute_median(long, "name", "v", "id % 10 <> 0", 0.5).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0, 5: 2.5, 10: 100.0}


def test_modes_and_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "id int, x string")
    assert {r.id: r.x for r in features.impute_mode(df, "x").collect()}[5] == "a"
    assert {r.x: r.code for r in features.factorize(df, "x", "id").collect()} == {"b": 0, "a": 1, None: 2}
    assert {r.x: r.code for r in features.label_encode(df.na.drop(), "x").collect()} == {"a": 0, "b": 1}


def test_yeo_johnson(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double")
    for power in (0.0, 1.0, 2.0, 0.5):
        up = lambda x, p=power: np.log1p(x) if p == 0 else ((x + 1) ** p - 1) / p
        down = lambda x, p=power: -np.log1p(-x) if p == 2 else -((1 - x) ** (2 - p) - 1) / (2 - p)
        assert [r[0] for r in df.select(features.yeo_johnson(F.col("x"), power)).collect()] == pytest.approx([down(-2.0), 0.0, up(3.0)])


def test_stratified_split(spark):
    df = spark.range(103).selectExpr("id", "if(id < 20, 'a', 'b') AS y")
    out = {(r.y, r.train): r["count"] for r in features.stratified_split(df, "y", "id", 0.8).groupBy("y", "train").count().collect()}
    assert out == {("a", True): 16, ("a", False): 4, ("b", True): 67, ("b", False): 16}


def test_kernel():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [3.0, 4.0]])
    k = learners.rbf(x, x, 0.5)
    assert np.diag(k) == pytest.approx([1, 1, 1]) and (k == k.T).all() and k[0, 1] == pytest.approx(np.exp(-0.5))


def test_smo_separates_blobs():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(-2, 0.5, (20, 2)), rng.normal(2, 0.5, (20, 2))]
    y = np.r_[-np.ones(20), np.ones(20)]
    model = learners.Smo(gamma=0.5).fit(x, y)
    assert (np.where(model.decision(x) >= 0, 1, -1) == y).all()
    assert abs(model.weight.sum()) < 1e-9 and (np.abs(model.weight) <= 1 + 1e-9).all()
    ring = np.c_[np.cos(np.arange(60)), np.sin(np.arange(60))] * np.repeat([1.0, 3.0], 30)[:, None]
    side = np.repeat([1.0, -1.0], 30)
    assert (np.sign(learners.Smo(gamma=1.0).fit(ring, side).decision(ring)) == side).mean() > 0.95


def test_votes_tie_to_the_lowest_class(spark):
    train = spark.createDataFrame([(i, [float(c * 5), float(i % 3)], c) for i, c in enumerate([0, 1, 2] * 10)], "id long, x array<double>, label int")
    models = learners.one_vs_one(train, [0, 1, 2])
    out = {r.id: r.predicted for r in learners.vote(train, models).collect()}
    assert all(out[i] == i % 3 for i in out)


def test_network_learns_and_stops():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    for kwargs in ({"activation": "sigmoid", "rate": 0.5}, {"activation": "relu", "rate": 0.01, "adam": True, "batch": 16}):
        net = learners.Network([4, 8, 2], **kwargs).fit(x, y, 30, validation=0.1)
        assert (net.predict(x) == y).mean() > 0.9
    assert learners.parameters([1024, 64, 10]) == 1024 * 64 + 64 + 64 * 10 + 10


def test_pairs_by_tiles_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 7)  # three groups of queries, and of candidates as many as cores ask for
    monkeypatch.setattr(neighbours, "ROWS", 10)
    x = np.random.default_rng(3).normal(size=(50, 4)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(6)
    asked, d = range(0, 50, 3), np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    queries = df.where("id % 3 = 0")
    near = neighbours.nearest(df, queries, 4).select("test_id", "rank", "train_id")
    assert rows(near) == [(i, r + 1, int(j)) for i in asked for r, j in enumerate(np.lexsort((np.arange(50), d[i]))[:4])]
    found = neighbours.summaries(df, queries).orderBy("test_id").collect()
    other = [np.delete(d[i], i) for i in asked]
    assert [(r.test_id, r.n) for r in found] == [(i, 49) for i in asked]
    np.testing.assert_allclose([(r.lo, r["mean"], r.hi) for r in found], [(o.min(), o.mean(), o.max()) for o in other])
    cells = neighbours.kernel(df, queries, 0.5).orderBy("i", "j").collect()
    np.testing.assert_allclose([r.k for r in cells], np.exp(-0.5 * d[list(asked)] ** 2).ravel())
    assert neighbours.summaries(df.limit(1), df.limit(0)).count() == 0
    one = df.where("id = 0")
    assert neighbours.summaries(one, one).count() == 0


def test_permutation_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    x[:, 1] += 3 * label
    table = [(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, label))]
    spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hashes = spark.range(60).select("id", F.pmod(F.xxhash64("id"), F.lit(8)).alias("b"), *[F.xxhash64("id", F.lit(r)).alias(f"h{r}") for r in range(3)]).orderBy("id").collect()
    centres = np.array([x[label == t].mean(axis=0) for t in range(3)])
    score = lambda rows: (((rows[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == label).mean()
    want = []
    for i in range(3):
        drops = []
        for r in range(3):
            mixed = x.copy()
            for b in range(8):
                ring = sorted((h[f"h{r}"], h.id) for h in hashes if h.b == b)
                for (_, a), (_, z) in zip(ring, ring[1:] + ring[:1]):
                    mixed[a, i] = x[z, i]
            drops.append(score(x) - score(mixed))
        want.append((i, round(float(np.mean(drops)), 6)))
    found = rows(models.permutation(spark, str(tmp_path)))
    assert [f for f, _ in found] == [0, 1, 2]
    np.testing.assert_allclose([v for _, v in found], [v for _, v in want], atol=1e-6)


def test_neighbours(spark):
    train = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, [1.0], 1), (4, [9.0], 0)], "id long, x array<double>, label int")
    test = spark.createDataFrame([(10, [1.0]), (11, [0.5])], "id long, x array<double>")
    near = neighbours.nearest(train, test, 2)
    assert rows(near.select("test_id", "rank", "train_id")) == [(10, 1, 2), (10, 2, 3), (11, 1, 1), (11, 2, 2)]
    labels = train.select(F.col("id").alias("train_id"), "label")
    assert rows(neighbours.classify(near, labels)) == [(10, 1), (11, 0)]
    targets = train.select(F.col("id").alias("train_id"), (F.col("id") * 10.0).alias("y"))
    assert rows(neighbours.regress(near, targets)) == [(10, 25.0), (11, 15.0)]


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    report = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.class_report(metrics.confusion(df, [0, 1, 2])).collect()}
    assert report[0] == pytest.approx((1.0, 0.5, 2 / 3, 2)) and report[2] == (0.0, 0.0, 0.0, 1)
    scores = spark.createDataFrame([(True, 0.9), (False, 0.5), (True, 0.5), (False, 0.1)], "positive boolean, score double")
    assert metrics.auc(metrics.roc(scores, "positive", "score")).first().auc == pytest.approx(0.875)


def test_sniffed_files(spark):
    a = "date,x,y\n2024-01-01,1,2\n2024-01-02,,3\n"
    b = "2024-02-01,5,-6\n2024-02-02,7,8\n"
    files = spark.createDataFrame([("a.csv", a.encode()), ("b.csv", b.encode()), ("c.csv", b"p,q\n1,2\n"), ("d.csv", b"")], "path string, content binary")
    found = delimited.sniffed(files, ["date", "x", "y"])
    assert rows(found.select("date", "path")) == [("2024-01-01", "a.csv"), ("2024-01-02", "a.csv"), ("2024-02-01", "b.csv"), ("2024-02-02", "b.csv")]
    assert rows(delimited.cleaned(found, ["x", "y"]).select("date", "x", "y")) == [("2024-01-01", 1.0, 2.0), ("2024-02-02", 7.0, 8.0)]


def test_pair_models_of_all_classes(spark):
    """All 45 pairs of ten classes have a model, and every test row a prediction."""
    rng = np.random.default_rng(1)
    held = [(i, [float(v) for v in rng.normal(i // 40, 0.1, 4)], i // 40, i % 5 == 0) for i in range(400)]
    held = spark.createDataFrame(held, "id long, x array<double>, label int, test boolean")
    patch = pytest.MonkeyPatch()
    patch.setattr(models, "vectors", lambda spark, d: held)
    try:
        assert models.QUERIES["ev_sv_count"](spark, "").count() == 45
        assert models.QUERIES["topk_pairs"](spark, "").count() == 15
        test = models.split(held)[1]
        found = {r.id: r.predicted for r in models.QUERIES["ml_ovo"](spark, "").collect()}
        assert set(found) == {r.id for r in test.collect()} and set(found.values()) == set(range(10))
    finally:
        patch.undo()
