"""Models and their evaluation on the labelled vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import features, learners, metrics, neighbours
from gridloom.operators.series import measurements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLASSES = list(range(10))

V = """v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x, vec_id % 5 = 0 AS test FROM embeddings),
    p AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS predicted, embedding[1]::DOUBLE + 0.5 AS score FROM embeddings)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {V}{sql}" if sql.startswith(",") else f"WITH {V} {sql}"
        return f

    return keep


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 5 == 0).alias("test"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, predicted, score): every third row is predicted one class too high."""
    rows = vectors(spark, d)
    guess = F.when(F.col("id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("id", "label", guess.alias("predicted"), (F.col("x")[0] + 0.5).alias("score"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("NOT test"), rows.where("test")


# --- nearest neighbours ---------------------------------------------------------------------------------------------

MINKOWSKI = {1: "list_sum(list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i])))", 2: "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.x[i] - b.x[i], 2))))", 3: "pow(list_sum(list_transform(range(1, 65), lambda i: pow(abs(a.x[i] - b.x[i]), 3))), 1 / 3.0::DOUBLE)"}


def near_sql(k: int, p: int = 2) -> str:
    return f", n AS (SELECT a.id AS test_id, b.id AS train_id, b.label, {MINKOWSKI[p]} AS distance, row_number() OVER (PARTITION BY a.id ORDER BY {MINKOWSKI[p]}, b.id) AS rank FROM v a JOIN v b ON a.test AND NOT b.test QUALIFY rank <= {k})"


def knn(spark: SparkSession, d: str, k: int, p: int = 2) -> DataFrame:
    train, test = split(vectors(spark, d))
    return neighbours.nearest(train, test, k, p)


query("win_knn_rank", near_sql(5) + " SELECT test_id, rank::INTEGER AS rank, train_id FROM n")(lambda spark, d: knn(spark, d, 5).select("test_id", "rank", "train_id"))
for p in (1, 2, 3):
    query("ml_knn_cls" if p == 2 else f"ml_knn_cls_p{p}", near_sql(5, p) + ", c AS (SELECT test_id, label, count(*) AS k FROM n GROUP BY ALL) SELECT test_id, first(label ORDER BY k DESC, label) AS predicted FROM c GROUP BY test_id")(
        lambda spark, d, p=p: neighbours.classify(knn(spark, d, 5, p), vectors(spark, d).select(F.col("id").alias("train_id"), "label"))
    )
query("ml_knn_reg", near_sql(5) + " SELECT test_id, round(sum(b.x[1] / n.distance) / sum(1 / n.distance), 6) AS predicted FROM n JOIN v b ON b.id = n.train_id GROUP BY test_id")(
    lambda spark, d: neighbours.regress(knn(spark, d, 5), vectors(spark, d).select(F.col("id").alias("train_id"), F.col("x")[0].alias("y"))).select("test_id", F.round("predicted", 6).alias("predicted"))
)


ASKED = "id % 20 = 0"  # the rows that pairwise queries ask for, against all rows


def distance_summary(spark: SparkSession, d: str) -> DataFrame:
    """Least, mean and largest distance of every twentieth row to all others."""
    rows = vectors(spark, d)
    return neighbours.summaries(rows, rows.where(ASKED)).select("test_id", "n", *[F.round(c, 6).alias(c) for c in ("lo", "mean", "hi")])


query("jn_cross_dist", f" SELECT test_id, count(*) AS n, round(min(distance), 6) AS lo, round(avg(distance), 6) AS mean, round(max(distance), 6) AS hi FROM (SELECT a.id AS test_id, {MINKOWSKI[2]} AS distance FROM v a JOIN v b ON a.{ASKED} AND a.id <> b.id) GROUP BY test_id")(distance_summary)


def gram(spark: SparkSession, d: str) -> DataFrame:
    """(i, j, k): the kernel exp(-0.5 |x_i - x_j|^2) of every twentieth row and all rows."""
    rows = vectors(spark, d)
    return neighbours.kernel(rows, rows.where(ASKED), 0.5).select("i", "j", F.round("k", 8).alias("k"))


query("ml_rbf", f" SELECT a.id AS i, b.id AS j, round(exp(-0.5 * pow({MINKOWSKI[2]}, 2)), 8) AS k FROM v a JOIN v b ON a.{ASKED}")(gram)

# --- naive Bayes, regressions ---------------------------------------------------------------------------------------


def bayes_scores(spark: SparkSession, d: str) -> DataFrame:
    return learners.gaussian_bayes(*split(vectors(spark, d)))


BAYES = """, l AS (SELECT id, label, test, i, x[i] AS v FROM v, range(1, 65) t(i)), e AS (SELECT 1e-9 * max(a) AS eps FROM (SELECT var_pop(v) AS a FROM l WHERE NOT test GROUP BY i)),
    s AS (SELECT label, i, avg(v) AS mu, var_pop(v) + any_value(eps) AS var FROM l, e WHERE NOT test GROUP BY label, i), r AS (SELECT label, ln(count(*)::DOUBLE / (SELECT count(*) FROM v WHERE NOT test)) AS prior FROM v WHERE NOT test GROUP BY label),
    b AS (SELECT l.id, s.label, any_value(prior) + sum(-0.5 * ln(2 * pi() * var) - pow(v - mu, 2) / (2 * var)) AS score FROM l JOIN s USING (i) JOIN r ON r.label = s.label WHERE l.test GROUP BY l.id, s.label)"""
query("ml_gnb", BAYES + " SELECT id, first(label ORDER BY score DESC, label) AS predicted, round(max(score), 4) AS score FROM b GROUP BY id")(
    lambda spark, d: bayes_scores(spark, d).groupBy("id").agg(F.max_by("label", F.struct("score", (-F.col("label")).alias("l"))).alias("predicted"), F.round(F.max("score"), 4).alias("score"))
)
CERTAIN = """, c AS (SELECT id, 1 / sum(exp(score - top)) AS p FROM (SELECT *, max(score) OVER (PARTITION BY id) AS top FROM b) GROUP BY id) SELECT least(floor(p * 20), 19)::INTEGER AS bin, count(*) AS n FROM c GROUP BY 1"""


def certainty(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the largest class probability, in twenty bins."""
    rows = bayes_scores(spark, d).groupBy("id").agg(F.collect_list("score").alias("s"))
    p = 1 / F.aggregate(F.transform("s", lambda x: F.exp(x - F.array_max("s"))), F.lit(0.0), lambda a, b: a + b)
    return rows.groupBy(F.least(F.floor(p * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


query("ev_certainty", BAYES + CERTAIN)(certainty)


def linear(spark: SparkSession, d: str) -> DataFrame:
    """Weights of total on minute of the week and download, with their product."""
    m = measurements(spark, d).select((F.hour("ts") / 24).alias("h"), "download", "total")
    w = learners.least_squares(features.interactions(m, ["h", "download"]), ["h", "download", "h_x_download"], "total")
    return spark.createDataFrame([(n, round(x, 6)) for n, x in zip(["intercept", "h", "download", "h_x_download"], w)], "name string, weight double")


query("ml_linreg")(linear)


def simple_line(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    a, b = learners.least_squares(m, ["download"], "total")
    return spark.createDataFrame([(round(b, 6), round(a, 6))], "slope double, intercept double")


query("ml_linreg_line", " SELECT round(regr_slope(value, y), 6) AS slope, round(regr_intercept(value, y), 6) AS intercept FROM (SELECT value, CASE WHEN event_type IN ('view', 'click', 'error') THEN value ELSE 0.0 END AS y FROM events)")(simple_line)


def assembled(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors(spark, d).select("id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"), "test")


def logistic(spark: SparkSession, d: str) -> DataFrame:
    """(id, predicted) of a multinomial logistic regression with penalty C = 1."""
    from pyspark.ml.classification import LogisticRegression

    train, test = split(assembled(spark, d))
    model = LogisticRegression(maxIter=100, regParam=1.0 / max(1, train.count()), family="multinomial").fit(train)
    return model.transform(test).select("id", F.col("prediction").cast("int").alias("predicted"))


def linear_svc(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.classification import LinearSVC, OneVsRest

    train, test = split(assembled(spark, d))
    model = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01)).fit(train)
    return model.transform(test).select("id", F.col("prediction").cast("int").alias("predicted"))


query("ml_logreg")(logistic)
query("ml_svc")(linear_svc)

# --- kernel SVM and networks ----------------------------------------------------------------------------------------


def pair_models(spark: SparkSession, d: str, classes: list[int]) -> DataFrame:
    train, _ = split(vectors(spark, d).where(F.col("label").isin(classes)))
    return learners.one_vs_one(train.drop("test"), classes)


def support(spark: SparkSession, d: str) -> DataFrame:
    return pair_models(spark, d, CLASSES).select("c1", "c2", F.size("sv").alias("support_vectors"))


def rbf_svc(spark: SparkSession, d: str) -> DataFrame:
    """(id, predicted) of test rows by one-vs-one kernel machines whose width comes from the training rows."""
    train, test = split(vectors(spark, d))
    gamma = learners.scale_gamma(train)
    return learners.vote(test, learners.one_vs_one(train.drop("test"), CLASSES, gamma=gamma), gamma)


query("ml_svc_rbf")(rbf_svc)
query("ml_smo")(lambda spark, d: pair_models(spark, d, [0, 1]).select("c1", "c2", F.size("sv").alias("support_vectors"), F.round("b", 3).alias("b")))
query("ev_sv_count")(support)
query("topk_pairs")(lambda spark, d: support(spark, d).orderBy(F.col("support_vectors").desc(), "c1", "c2").limit(15))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """(id, side) of test rows by the model of classes 0 and 1."""
    _, test = split(vectors(spark, d).where("label < 2"))
    found = learners.decisions(test, pair_models(spark, d, [0, 1]))
    return found.select("id", F.when(F.col("f")[0] >= 0, 0).otherwise(1).alias("predicted"))


query("ml_decision")(decisions)
query("ml_ovo")(lambda spark, d: learners.vote(split(vectors(spark, d).where(F.col("label").isin(CLASSES)))[1], pair_models(spark, d, CLASSES)))
query("ml_ovo_votes", " SELECT id, first(c ORDER BY k DESC, c)::INTEGER AS predicted FROM (SELECT id, c, count(*) AS k FROM (SELECT id, CASE WHEN (id + a + b) % 2 = 0 THEN a ELSE b END AS c FROM v, range(4) s(a), range(4) t(b) WHERE a < b) GROUP BY id, c) GROUP BY id")(
    lambda spark, d: vectors(spark, d).select("id", F.explode(F.array(*[F.when((F.col("id") + a + b) % 2 == 0, a).otherwise(b) for a in range(4) for b in range(a + 1, 4)])).alias("c"))
    .groupBy("id", "c").agg(F.count("*").alias("k")).groupBy("id").agg(F.max_by("c", F.struct("k", (-F.col("c")).alias("l"))).alias("predicted"))
)
CONFIGS = [("sgd_64", [64], False, 0.1, 32), ("adam_64", [64], True, 0.001, 32), ("adam_128", [128], True, 0.001, 32), ("adam_128_64", [128, 64], True, 0.001, 32)]


def networks(spark: SparkSession, d: str, configs: list[tuple], activation: str, epochs: int, validation: float) -> DataFrame:
    """(config, parameters, train_accuracy, test_accuracy): networks fitted on all training rows and scored on all rows.
    Nothing where there are no training rows."""
    rows = vectors(spark, d)
    train, _ = split(rows)
    width = (train.agg(F.max(F.size("x"))).first()[0] or 0) if configs else 0
    plans = [learners.Plan(name, [width, *hidden, len(CLASSES)], adam, rate, batch) for name, hidden, adam, rate, batch in configs]
    nets = learners.fit_networks(train, plans, activation, epochs, validation)

    def score(batches):
        for pdf in batches:
            if len(pdf):
                x, out = np.stack(pdf["x"]).astype(float), []
                for plan in plans:
                    if plan.name in nets:
                        hit = plan.network(activation).load(nets[plan.name]).predict(x) == pdf["label"].to_numpy()
                        out += [(plan.name, learners.parameters(plan.sizes), bool(t), int(hit[pdf["test"] == t].sum()), int((pdf["test"] == t).sum())) for t in (False, True)]
                yield pd.DataFrame(out, columns=["config", "parameters", "test", "hits", "n"])

    scored = rows.select("x", "label", "test").mapInPandas(score, "config string, parameters int, test boolean, hits long, n long")
    share = lambda which: F.coalesce(F.try_divide(F.sum(F.when(which, F.col("hits"))), F.sum(F.when(which, F.col("n")))), F.lit(0.0))
    return scored.groupBy("config", "parameters").agg(share(~F.col("test")).alias("train_accuracy"), share(F.col("test")).alias("test_accuracy"))


query("ml_mlp_scratch")(lambda spark, d: networks(spark, d, [("scratch", [64], False, 0.12, 1)], "sigmoid", 50, 0.0))
query("ml_mlp_configs")(lambda spark, d: networks(spark, d, CONFIGS, "relu", 100, 0.1))
SIZES = " UNION ALL ".join(f"SELECT '{c[0]}' AS config, {learners.parameters([64, *c[1], 10])}::INTEGER AS parameters" for c in CONFIGS)
query("ml_param_count", SIZES)(lambda spark, d: spark.createDataFrame([(c[0], [64, *c[1], 10]) for c in CONFIGS], "config string, sizes array<int>").select("config", F.aggregate(F.transform(F.sequence(F.lit(1), F.size("sizes") - 1), lambda i: (F.get("sizes", i - 1) + 1) * F.get("sizes", i)), F.lit(0), lambda a, b: a + b).alias("parameters")))
query("ev_overfit", " SELECT config, CASE WHEN gap < 5 THEN 'good' WHEN gap < 15 THEN 'slight' ELSE 'strong' END AS verdict FROM (VALUES ('a', 3.0), ('b', 7.5), ('c', 15.0)) t(config, gap)")(
    lambda spark, d: spark.createDataFrame([("a", 3.0), ("b", 7.5), ("c", 15.0)], "config string, gap double").select("config", F.when(F.col("gap") < 5, "good").when(F.col("gap") < 15, "slight").otherwise("strong").alias("verdict"))
)


def strongest_weights(spark: SparkSession, d: str) -> DataFrame:
    """The five centroid components of largest size of each class, with their sign."""
    means = vectors(spark, d).select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg("v"), 6).alias("w"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.abs("w").desc(), "i"))
    return means.withColumn("rank", place).where("rank <= 5").select("label", "rank", "i", "w")


query("topk_abs", " SELECT label, rank::INTEGER AS rank, (i - 1)::INTEGER AS i, w FROM (SELECT label, i, w, row_number() OVER (PARTITION BY label ORDER BY abs(w) DESC, i) AS rank FROM (SELECT label, i, round(avg(x[i]), 6) AS w FROM v, range(1, 65) t(i) GROUP BY label, i)) WHERE rank <= 5")(strongest_weights)

# --- evaluation -----------------------------------------------------------------------------------------------------

query("ev_accuracy", " SELECT round(avg((label = predicted)::INTEGER), 6) AS accuracy FROM p")(lambda spark, d: metrics.accuracy(predictions(spark, d)).select(F.round("accuracy", 6).alias("accuracy")))
MATRIX = ", m AS (SELECT a.i::INTEGER AS label, b.i::INTEGER AS predicted, count(p.id) AS n FROM range(10) a(i) CROSS JOIN range(10) b(i) LEFT JOIN p ON p.label = a.i AND p.predicted = b.i GROUP BY ALL)"
matrix = lambda spark, d: metrics.confusion(predictions(spark, d), CLASSES)
query("ev_confusion", MATRIX + " SELECT label, predicted, n FROM m")(matrix)
REPORT = MATRIX + ", r AS (SELECT l.label, l.hits, l.support, g.guessed FROM (SELECT label, coalesce(sum(n) FILTER (label = predicted), 0) AS hits, sum(n)::BIGINT AS support FROM m GROUP BY label) l JOIN (SELECT predicted AS label, sum(n) AS guessed FROM m GROUP BY predicted) g USING (label)), t AS (SELECT label, CASE WHEN guessed = 0 THEN 0 ELSE hits::DOUBLE / guessed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS recall, CASE WHEN guessed + support = 0 THEN 0 ELSE 2 * hits::DOUBLE / (guessed + support) END AS f1, support FROM r)"
tidy = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])
query("ev_report", REPORT + " SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM t")(lambda spark, d: tidy(metrics.class_report(matrix(spark, d))))
query("ev_report_averages", REPORT + " SELECT 'macro' AS kind, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM t UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM t")(
    lambda spark, d: tidy(metrics.averages(metrics.class_report(matrix(spark, d))))
)
query("ev_class_acc", REPORT + " SELECT label, round(recall, 6) AS accuracy FROM t")(lambda spark, d: metrics.class_report(matrix(spark, d)).select("label", F.round("recall", 6).alias("accuracy")))
query("ev_logloss", " SELECT round(avg(-ln(greatest(1e-15, least(1 - 1e-15, score)))), 6) AS loss FROM p")(lambda spark, d: predictions(spark, d).agg(F.round(metrics.log_loss(F.col("score")), 6).alias("loss")))
positive = lambda spark, d: predictions(spark, d).select("id", (F.col("label") < 5).alias("positive"), "score")
CURVE = ", c AS (SELECT score, count(*) FILTER (label < 5) AS p, count(*) FILTER (label >= 5) AS n FROM p GROUP BY 1), k AS (SELECT score, p, n, sum(p) OVER o AS cp, sum(n) OVER o AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c WINDOW o AS (ORDER BY score DESC))"
query("ev_roc_auc", CURVE + " SELECT round(sum(n * (cp - p / 2.0::DOUBLE)) / (any_value(tp) * any_value(tn)), 6) AS auc FROM k")(lambda spark, d: metrics.auc(metrics.roc(positive(spark, d), "positive", "score")).select(F.round("auc", 6).alias("auc")))
query("ev_roc_curve", CURVE + " SELECT score, round(cp::DOUBLE / tp, 6) AS tpr, round(cn::DOUBLE / tn, 6) AS fpr FROM k")(lambda spark, d: metrics.roc(positive(spark, d), "positive", "score").select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr")))
query("ev_mse_mae_r2", " SELECT round(avg(pow(x[1] - x[2], 2)), 6) AS mse, round(avg(abs(x[1] - x[2])), 6) AS mae, round(1 - avg(pow(x[1] - x[2], 2)) / var_pop(x[1]), 6) AS r2 FROM v")(
    lambda spark, d: tidy(metrics.regression(vectors(spark, d).select(F.col("x")[0].alias("y"), F.col("x")[1].alias("p")), "y", "p"))
)


def drawn(what: str, n: int) -> Column:
    """A number below n from the md5 of the id and a text."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(what))), 1, 6), 16, 10).cast("long"), F.lit(n)).cast("int")


def drawn_sql(what: str, n: int | str) -> str:
    return f"(('0x' || md5(id || '{what}')[1:6])::BIGINT % {n})::INTEGER"


REPEATS = 10


def permutation(spark: SparkSession, d: str, repeats: int = REPEATS) -> DataFrame:
    """(feature, drop, deviation): loss of 5-nearest-neighbour accuracy if test rows exchange one component, mean and
    deviation over the repeats. A repeat gives a row the component of its successor in the order of a hash, the last one
    that of the first, within a block of rows; the number of blocks grows with the table."""
    train, test = split(vectors(spark, d))
    block = drawn("block", 1 + test.count() // 50_000)
    order = [Window.partitionBy("block").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{r}"))), "id") for r in range(repeats)]
    rows = test.withColumn("block", block)
    rows = rows.select("id", "x", F.array(*[F.coalesce(F.lead("x").over(w), F.first("x").over(w)) for w in order]).alias("others"))
    found = neighbours.exchanged(train, rows, 5, repeats).join(test.select(F.col("id").alias("test_id"), "label"), "test_id")
    share = found.groupBy("feature", "repeat").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
    base = share.where("feature < 0").select(F.col("a").alias("base"))
    drop = share.where("feature >= 0").crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("a"))
    return drop.groupBy("feature").agg(F.round(F.avg("drop"), 6).alias("drop"), F.round(F.stddev_pop("drop"), 6).alias("deviation"))


query(
    "ev_permutation",
    f""", o AS (SELECT id, label, x, r, coalesce(lead(x) OVER w, first(x) OVER w) AS o FROM (SELECT *, {drawn_sql("block", "(SELECT 1 + count(*) // 50000 FROM v WHERE test)")} AS block FROM v WHERE test), range({REPEATS}) t(r) WINDOW w AS (PARTITION BY r, block ORDER BY md5(id || '-' || r), id)),
    d AS (SELECT a.id, a.label, a.r, a.x, a.o, b.id AS train_id, b.label AS guess, b.x AS y, list_sum(list_transform(range(1, 65), lambda i: pow(a.x[i] - b.x[i], 2))) AS d FROM o a JOIN v b ON NOT b.test),
    e AS (SELECT id, label, r, i, train_id, guess, CASE WHEN i = 0 THEN d ELSE d - pow(x[i] - y[i], 2) + pow(o[i] - y[i], 2) END AS d FROM d, range(65) t(i)),
    n AS (SELECT id, label, r, i, unnest(near) AS guess FROM (SELECT id, label, r, i, arg_min(guess, struct_pack(d := d, t := train_id), 5) AS near FROM e GROUP BY id, label, r, i)),
    g AS (SELECT id, label, r, i, first(guess ORDER BY k DESC, guess) AS guess FROM (SELECT id, label, r, i, guess, count(*) AS k FROM n GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT r, i, avg((label = guess)::INTEGER) AS a FROM g GROUP BY r, i)
    SELECT (a.i - 1)::INTEGER AS feature, round(avg(z.a - a.a), 6) AS drop, round(stddev_pop(z.a - a.a), 6) AS deviation FROM a JOIN a z ON z.r = a.r AND z.i = 0 WHERE a.i > 0 GROUP BY a.i""",
)(permutation)


SHARES = 10


def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    """(share, fold, accuracy) of the five nearest neighbours for ten growing shares of the training rows, in five folds."""
    rows = vectors(spark, d).select("id", "label", "x", drawn("fold", 5).alias("fold"), (drawn("share", SHARES) + 1).alias("number"))
    found = neighbours.by_share(rows, 5, SHARES)
    votes = found.join(rows.select(F.col("id").alias("train_id"), F.col("label").alias("guess")), "train_id").groupBy("share", "test_id", "guess").agg(F.count("*").alias("n"))
    best = votes.groupBy("share", "test_id").agg(F.max_by("guess", F.struct("n", (-F.col("guess")).alias("l"))).alias("guess"))
    truth = rows.select(F.col("id").alias("test_id"), "fold", "label")
    return best.join(truth, "test_id").groupBy("share", "fold").agg(F.round(F.avg((F.col("guess") == F.col("label")).cast("double")), 6).alias("accuracy"))


query(
    "ev_learning_curve",
    f""", r AS (SELECT id, label, x, {drawn_sql("fold", 5)} AS fold, {drawn_sql("share", SHARES)} + 1 AS number FROM v),
    d AS (SELECT a.id, a.fold, a.label, b.id AS train_id, b.label AS guess, b.number, {MINKOWSKI[2]} AS d FROM r a JOIN r b ON a.fold <> b.fold),
    n AS (SELECT share, fold, id, label, unnest(near) AS guess FROM (SELECT share, fold, id, label, arg_min(guess, struct_pack(d := d, t := train_id), 5) AS near FROM d JOIN range(1, {SHARES + 1}) s(share) ON number <= share GROUP BY share, fold, id, label)),
    g AS (SELECT share, fold, id, label, first(guess ORDER BY k DESC, guess) AS guess FROM (SELECT share, fold, id, label, guess, count(*) AS k FROM n GROUP BY ALL) GROUP BY ALL)
    SELECT share::INTEGER AS share, fold, round(avg((label = guess)::INTEGER), 6) AS accuracy FROM g GROUP BY share, fold""",
)(learning_curve)


def best_k(spark: SparkSession, d: str) -> DataFrame:
    """The (p, k) of largest accuracy among p = 1, 2 and k = 1, 3, 5; the first of equals."""
    labels, out = vectors(spark, d).select(F.col("id").alias("train_id"), "label"), None
    truth = vectors(spark, d).select(F.col("id").alias("test_id"), F.col("label").alias("truth"))
    for p in (1, 2):
        found = knn(spark, d, 5, p)
        for k in (1, 3, 5):
            one = neighbours.classify(found.where(F.col("rank") <= k), labels).join(truth, "test_id").agg(F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("accuracy")).select(F.lit(p).alias("p"), F.lit(k).alias("k"), "accuracy")
            out = one if out is None else out.union(one)
    return out.orderBy(F.col("accuracy").desc(), "p", "k").limit(1).select("p", "k", F.round("accuracy", 6).alias("accuracy"))


def grid_sql() -> str:
    parts = [f"SELECT {p} AS p, {k} AS k, avg((c.predicted = t.label)::INTEGER) AS accuracy FROM (SELECT test_id, first(label ORDER BY n DESC, label) AS predicted FROM (SELECT test_id, label, count(*) AS n FROM n{p} WHERE rank <= {k} GROUP BY ALL) GROUP BY test_id) c JOIN v t ON t.id = c.test_id" for p in (1, 2) for k in (1, 3, 5)]
    heads = "".join(near_sql(5, p).replace(", n AS", f", n{p} AS") for p in (1, 2))
    return f"{heads} SELECT p, k, round(accuracy, 6) AS accuracy FROM ({' UNION ALL '.join(parts)}) ORDER BY accuracy DESC, p, k LIMIT 1"


query("ev_grid_best", grid_sql())(best_k)
query("fe_scale255", " SELECT id AS vec_id, round(list_sum(list_transform(x, lambda e: least(255, greatest(0, floor((e + 0.53) * 255))) / 255.0::DOUBLE)), 6) AS total FROM v")(
    lambda spark, d: vectors(spark, d).select(F.col("id").alias("vec_id"), F.round(F.aggregate(F.transform("x", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e + 0.53) * 255))) / 255.0), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))
)
