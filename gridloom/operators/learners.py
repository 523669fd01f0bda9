"""Models that Spark ML lacks: kernel SVM by sequential minimal optimisation, small networks, naive Bayes, least squares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import neighbours
from gridloom.operators.quantiles import held


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |a - b|^2) of all rows, made in one array; rounding cannot make a distance negative."""
    out = a @ b.T
    out *= -2
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)[None, :]
    np.maximum(out, 0.0, out=out)
    out *= -gamma
    return np.exp(out, out=out)


#: Rows up to which a fit holds its whole kernel, and values of a kernel's part that larger fits and decisions hold.
KERNEL_ROWS, KERNEL_PART = 2000, 1 << 22


def weighted(x: np.ndarray, sv: np.ndarray, weight: np.ndarray, gamma: float) -> np.ndarray:
    """rbf(x, sv) @ weight, a part of the kernel at a time."""
    out, step = np.zeros((len(x), *weight.shape[1:])), max(1, KERNEL_PART // max(1, len(x)))
    for at in range(0, len(sv), step):
        out += rbf(x, sv[at : at + step], gamma) @ weight[at : at + step]
    return out


class Smo:
    """Binary kernel SVM by sequential minimal optimisation on the gradient of the dual.

    Each step takes the row that violates the optimality conditions most, and of the rows that pair with it the one whose
    pair promises the largest gain by its second-order model. It ends when no pair violates the conditions by more than
    the tolerance, or after `most` steps a row.
    """

    def __init__(self, c: float = 1.0, gamma: float = 0.5, tolerance: float = 1e-3, most: int = 1000):
        self.c, self.gamma, self.tolerance, self.most = c, gamma, tolerance, most

    def fit(self, x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None) -> Smo:
        """From weights 0, or from those of fits of parts, whose signed sum is 0. More rows than KERNEL_ROWS are fitted by
        working sets: the rows that violate most, of both sides, are optimised with all others fixed, and the slopes of all
        rows follow, so only the kernel of a working set and all rows is held."""
        n = len(y)
        a = np.zeros(n) if start is None else start.astype(float).copy()
        if n <= KERNEL_ROWS:
            k = rbf(x, x, self.gamma)
            slope = y * (k @ (a * y)) - 1.0 if a.any() else np.full(n, -1.0)
            top, bottom = self.steps(k, y, a, slope, self.most * n)
        else:
            kept = a > 0
            slope = y * weighted(x, x[kept], (a * y)[kept], self.gamma) - 1.0 if kept.any() else np.full(n, -1.0)
            size, top, bottom = max(2, min(1024, KERNEL_PART // n)), 0.0, 0.0
            for _ in range(self.most * n // size + 1):
                score, plus = -y * slope, y > 0
                up, down = (np.flatnonzero(m) for m in (np.where(plus, a < self.c, a > 0), np.where(plus, a > 0, a < self.c)))
                if not len(up) or not len(down):
                    break
                top, bottom = score[up].max(), score[down].min()
                if top - bottom < self.tolerance:
                    break
                half = max(1, size // 2)
                up = up[np.argpartition(-score[up], min(half, len(up)) - 1)[:half]]
                down = down[np.argpartition(score[down], min(half, len(down)) - 1)[:half]]
                own = np.union1d(up, down)
                k = rbf(x[own], x, self.gamma)
                part, before = a[own], a[own].copy()
                self.steps(k[:, own], y[own], part, slope[own], 100 * len(own))
                a[own] = part
                slope += y * (((part - before) * y[own]) @ k)
        free = (a > 0) & (a < self.c)
        self.b = float((-y * slope)[free].mean()) if free.any() else float(top + bottom) / 2
        self.kept = a > 1e-7
        self.a, self.x, self.weight = a, x[self.kept], (a * y)[self.kept]
        return self

    def steps(self, k: np.ndarray, y: np.ndarray, a: np.ndarray, slope: np.ndarray, most: int) -> tuple[float, float]:
        """Steps on the rows of a kernel that change their weights and slopes; the last extremes of the conditions."""
        own, plus = np.diag(k).copy(), y > 0
        top = bottom = 0.0
        for _ in range(most):
            score = -y * slope
            can_rise, can_fall = np.where(plus, a < self.c, a > 0), np.where(plus, a > 0, a < self.c)
            if not can_rise.any() or not can_fall.any():
                break
            i = int(np.where(can_rise, score, -np.inf).argmax())
            top, bottom = score[i], np.where(can_fall, score, np.inf).min()
            if top - bottom < self.tolerance:
                break
            gap, bend = top - score, np.maximum(own[i] + own - 2 * k[i], 1e-12)
            j = int(np.where(can_fall & (gap > 0), gap * gap / bend, -np.inf).argmax())
            step = min(gap[j] / bend[j], self.c - a[i] if plus[i] else a[i], a[j] if plus[j] else self.c - a[j])
            a[i], a[j] = a[i] + y[i] * step, a[j] - y[j] * step
            for t in (i, j):  # at a bound exactly, or rounding would leave it open
                a[t] = 0.0 if a[t] < 1e-12 else self.c if a[t] > self.c - 1e-12 else a[t]
            slope += y * step * (k[i] - k[j])
        return top, bottom

    def decision(self, x: np.ndarray) -> np.ndarray:
        return weighted(x, self.x, self.weight, self.gamma) + self.b


MODEL = "c1 int, c2 int, sv array<array<double>>, coef array<double>, b double"


#: Rows that one fit takes, unless more of them are support vectors; parts that one step of the cascade merges.
FIT_ROWS, MERGED = 6000, 2


def one_vs_one(train: DataFrame, classes: list[int], c: float = 1.0, gamma: float = 0.5, fit_rows: int = FIT_ROWS, rounds: int = 20, tolerance: float = 0.05) -> DataFrame:
    """A model per pair of classes, from (id, x, label): c1 is +1, c2 is -1. Fitted on all rows, by a cascade.

    A pair's rows are dealt by a hash of their id to parts of about fit_rows. Each part is fitted, its support vectors go
    on to the next step, where parts are merged two by two, and so on to one model. That is held against all rows: of
    those that it leaves on the wrong side of the margin, by more than the tolerance, and that are no support vectors of
    it, the worst fit_rows join its support vectors in another fit, whose objective cannot be less; until there are none
    or `rounds` are over. A task holds a part, or the model and so many rows. A pair of one part is one fit.
    """
    spark = train.sparkSession
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(classes) for b in classes[i + 1 :]], "c1 int, c2 int")
    of_pair = (F.col("label") == F.col("c1")) | (F.col("label") == F.col("c2"))
    rows = train.join(F.broadcast(pairs), of_pair).select("c1", "c2", F.col("label").cast("int").alias("label"), F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.lit(0.0).alias("a"))
    row = "c1 int, c2 int, label int, id long, x array<double>"

    def fit(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Smo]:
        pdf = pdf.assign(h=pd.util.hash_array(pdf["id"].to_numpy().astype("<u8"))).sort_values(["h", "id"])
        x, c1 = np.stack(pdf["x"]).astype(float), int(pdf["c1"].iloc[0])
        model = Smo(c, gamma).fit(x, np.where(pdf["label"].to_numpy() == c1, 1.0, -1.0), pdf["a"].to_numpy())
        return pdf, model

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, model = fit(pdf)
        return pdf.assign(a=model.a)[model.kept][["c1", "c2", "part", "label", "id", "x", "a"]]

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, model = fit(pdf)
        return pd.DataFrame([{"c1": pdf["c1"].iloc[0], "c2": pdf["c2"].iloc[0], "sv": model.x.tolist(), "coef": model.weight.tolist(), "b": float(model.b), "ids": pdf["id"][model.kept].tolist()}])

    def cascade(some: DataFrame) -> DataFrame:
        parts = some.groupBy("c1", "c2").agg(F.ceil(F.count("*") / fit_rows).cast("int").alias("parts"))
        some = some.join(F.broadcast(parts), ["c1", "c2"])  # a row for each pair of classes
        some = some.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")).drop("parts")
        left = parts.agg(F.max("parts")).first()[0] or 1
        while left > 1:
            many = some.groupBy("c1", "c2", "part").applyInPandas(reduced, "c1 int, c2 int, part int, label int, id long, x array<double>, a double")
            some, left = held(many.withColumn("part", F.floor(F.col("part") / MERGED).cast("int"))), ceil(left / MERGED)
        return held(some.groupBy("c1", "c2").applyInPandas(last, MODEL + ", ids array<long>"))

    several = rows.groupBy("c1", "c2").count().where(F.col("count") > fit_rows).limit(1).count() > 0
    models = cascade(rows)
    for _ in range(rounds if several else 0):
        asked = train.where(F.col("label").isin(classes)).select("id", F.concat(F.array(F.col("label").cast("double")), F.col("x").cast("array<double>")).alias("x"))
        found = _against_models(asked, models, lambda ids, x, known: _Wrong(ids, x, known, gamma, tolerance), row + ", margin double")
        own = models.select("c1", "c2", F.explode(F.arrays_zip("ids", "coef")).alias("s")).select("c1", "c2", F.col("s.ids").alias("id"), F.abs("s.coef").alias("a"))
        worst = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("margin", "id"))
        more = held(found.join(own, ["c1", "c2", "id"], "left_anti").withColumn("_r", worst).where(F.col("_r") <= fit_rows).select(*rows.columns[:-1], F.lit(0.0).alias("a")))
        if not more.limit(1).count():
            break
        vectors = rows.drop("a").join(own, ["c1", "c2", "id"]).select(rows.columns)
        models = held(vectors.union(more).groupBy("c1", "c2").applyInPandas(last, MODEL + ", ids array<long>"))
    return models.drop("ids")


class _Decided(neighbours.Fold):
    """Decisions of all pairs' models, known as (c1, c2, b) a pair, on queries: rows are (a weight for each pair, vector)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, known: list[tuple[int, int, float]], gamma: float):
        self.ids, self.x, self.known, self.gamma = ids, x, known, gamma
        self.f = np.tile([b for _, _, b in known], (len(ids), 1)).astype(float)

    def read(self, ids: np.ndarray, x: np.ndarray) -> None:
        n = len(self.known)
        self.f += weighted(self.x, x[:, n:], x[:, :n], self.gamma)

    def end(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[at : at + 4096]), pa.array(self.f[at : at + 4096].tolist(), pa.list_(pa.float64()))], ["id", "f"])


class _Voted(_Decided):
    """The class that most pairs vote for, the least of equals."""

    def end(self) -> Iterator[pa.RecordBatch]:
        labels = sorted({c for c1, c2, _ in self.known for c in (c1, c2)})
        total = np.zeros((len(self.ids), len(labels)), int)
        for i, (c1, c2, _) in enumerate(self.known):
            side = self.f[:, i] >= 0
            total[:, labels.index(c1)] += side
            total[:, labels.index(c2)] += ~side
        yield pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(np.array(labels, np.int32)[total.argmax(axis=1)])], ["id", "predicted"])


class _Wrong(_Decided):
    """Of queries (label, vector) those on the wrong side of the margin of a model of their class, once for each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, known: list[tuple[int, int, float]], gamma: float, tolerance: float):
        super().__init__(ids, np.ascontiguousarray(x[:, 1:]), known, gamma)
        self.label, self.tolerance = x[:, 0].astype(np.int32), tolerance

    def end(self) -> Iterator[pa.RecordBatch]:
        for i, (c1, c2, _) in enumerate(self.known):
            margin = np.where(self.label == c1, self.f[:, i], -self.f[:, i])
            found = np.flatnonzero(((self.label == c1) | (self.label == c2)) & (margin < 1 - self.tolerance))
            for at in (found[lo : lo + 4096] for lo in range(0, len(found), 4096)):
                same = [pa.array(np.full(len(at), c, np.int32)) for c in (c1, c2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(self.label[at]), pa.array(self.ids[at]), pa.array(self.x[at].tolist(), pa.list_(pa.float64())), pa.array(margin[at])], ["c1", "c2", "label", "id", "x", "margin"])


def _against_models(rows: DataFrame, models: DataFrame, fold: Callable, schema: str) -> DataFrame:
    """What fold (ids, vectors, pairs) gives of rows (id, x) after all support vectors were read past them. A vector that
    several pairs share is read once, with its weight in each; models stay distributed, the driver sees a row a pair."""
    known = [tuple(m) for m in models.select("c1", "c2", "b").orderBy("c1", "c2").collect()]
    if not known:
        return rows.sparkSession.createDataFrame([], schema)
    sv = models.select("c1", "c2", F.explode(F.arrays_zip("sv", "coef")).alias("s")).select("c1", "c2", F.col("s.sv").alias("sv"), F.col("s.coef").alias("w"))
    of = lambda c1, c2: F.coalesce(F.sum(F.when((F.col("c1") == c1) & (F.col("c2") == c2), F.col("w"))), F.lit(0.0))
    once = sv.groupBy("sv").agg(F.array(*[of(c1, c2) for c1, c2, _ in known]).alias("w")).select(F.xxhash64("sv").alias("id"), F.concat("w", "sv").alias("x"))
    return neighbours._against(once, rows.select("id", "x"), lambda ids, x: fold(ids, x, known), schema, max(1024, neighbours.BYTES // (16 * (len(known) + 64))))


def decisions(rows: DataFrame, models: DataFrame, gamma: float = 0.5) -> DataFrame:
    """(id, f): the decisions of all pairs on rows (id, x), in the order of the pairs; none without models."""
    return _against_models(rows, models, lambda ids, x, known: _Decided(ids, x, known, gamma), "id long, f array<double>")


def scale_gamma(train: DataFrame) -> float:
    """The kernel width 1 / (components * variance of all of them) of the vectors x; 1 where that has no value."""
    width, spread = train.select(F.size("x").alias("n"), F.explode("x").alias("v")).agg(F.max("n"), F.var_pop("v")).first()
    return 1.0 / (width * spread) if spread else 1.0


def vote(rows: DataFrame, models: DataFrame, gamma: float = 0.5) -> DataFrame:
    """(id, predicted): the class that most pairs vote for, the least of equals; a decision of 0 is for c1."""
    return _against_models(rows, models, lambda ids, x, known: _Voted(ids, x, known, gamma), "id long, predicted int")


ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "relu": (lambda z: np.maximum(z, 0.0), lambda a: (a > 0).astype(float)),
}


class Network:
    """Dense layers with a softmax at the end, trained on cross-entropy by plain gradient steps or Adam, in batches;
    stops once the validation loss has not improved for `patience` epochs and then has its best weights."""

    def __init__(self, sizes: list[int], activation: str = "sigmoid", rate: float = 0.12, adam: bool = False, batch: int = 1, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        self.act, self.slope = ACTIVATIONS[activation]
        self.rate, self.adam, self.batch = rate, adam, batch
        self.weights = [[self.rng.normal(size=(a, b)) / np.sqrt(a), np.zeros(b)] for a, b in zip(sizes, sizes[1:])]
        self.moments = [[(np.zeros_like(p), np.zeros_like(p)) for p in layer] for layer in self.weights]
        self.steps = 0

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for w, b in self.weights[:-1]:
            out.append(self.act(out[-1] @ w + b))
        z = out[-1] @ self.weights[-1][0] + self.weights[-1][1]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return [*out, e / e.sum(axis=1, keepdims=True)]

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return float(-np.log(self.forward(x)[-1][np.arange(len(y)), y] + 1e-8).mean())

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        layers = self.forward(x)
        delta = layers[-1].copy()
        delta[np.arange(len(y)), y] -= 1
        delta /= len(y)
        self.steps += 1
        for i in range(len(self.weights) - 1, -1, -1):
            grads = layers[i].T @ delta, delta.sum(axis=0)
            if i:
                delta = (delta @ self.weights[i][0].T) * self.slope(layers[i])
            for k, g in enumerate(grads):
                if self.adam:
                    m, v = self.moments[i][k]
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    self.moments[i][k] = m, v
                    g = m / (1 - 0.9**self.steps) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)
                self.weights[i][k] = self.weights[i][k] - self.rate * g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, validation: float = 0.0, patience: int = 5) -> Network:
        held = len(y) - int(len(y) * validation)
        best, kept, waited = np.inf, None, 0
        for _ in range(epochs):
            order = self.rng.permutation(held)
            for at in range(0, held, self.batch):
                self.step(x[order[at : at + self.batch]], y[order[at : at + self.batch]])
            if held < len(y):
                now = self.loss(x[held:], y[held:])
                if now < best:
                    best, kept, waited = now, [[p.copy() for p in layer] for layer in self.weights], 0
                else:
                    waited += 1
                    if waited >= patience:
                        break
        if kept:
            self.weights = kept
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1].argmax(axis=1)

    def state(self) -> np.ndarray:
        """Weights and, for Adam, moments, as one row of numbers."""
        parts = [p.ravel() for layer in self.weights for p in layer]
        return np.concatenate([*parts, *[m.ravel() for layer in self.moments for both in layer for m in both if self.adam]])

    def load(self, state: np.ndarray, steps: int = 0) -> Network:
        at = 0

        def take(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return state[at - like.size : at].reshape(like.shape).copy()

        self.weights = [[take(p) for p in layer] for layer in self.weights]
        if self.adam:
            self.moments = [[(take(a), take(b)) for a, b in layer] for layer in self.moments]
        self.steps = steps
        return self

    def epoch(self, x: np.ndarray, y: np.ndarray, order: np.ndarray) -> None:
        for at in range(0, len(order), self.batch):
            self.step(x[order[at : at + self.batch]], y[order[at : at + self.batch]])


#: Training rows of a part, which a task holds.
PART_ROWS = 50_000


@dataclass
class Plan:
    """A network to fit: its layers, and how it learns."""

    name: str
    sizes: list[int]
    adam: bool
    rate: float
    batch: int

    def network(self, activation: str) -> Network:
        return Network(self.sizes, activation, self.rate, self.adam, self.batch)


def fit_networks(train: DataFrame, plans: list[Plan], activation: str, epochs: int, validation: float = 0.0, patience: int = 5, part_rows: int = PART_ROWS) -> dict[str, np.ndarray]:
    """The weights of each network, by name, fitted on all rows (id, x, label); none for an empty table.

    Rows are dealt by a hash of their id to parts that a task can hold. In each epoch every part goes through its rows once
    in steps of the batch, starting from the common weights; weights and moments are then averaged by the parts' rows. One
    job does an epoch of all networks, sums are combined by position, and the driver sees one state a network. A share of
    `validation` of the rows, by the hash, is held out; each epoch measures their loss under the weights it starts from,
    and a network stops once that has not improved for `patience` epochs, with the best weights so far. A table of one
    part is fitted by the plain steps of one task.
    """
    n = train.count()
    if not n:
        return {}
    held = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) < F.lit(1000 * validation)
    rows = train.select("id", F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"), held.alias("held"))
    rows = rows.repartition(ceil(n / part_rows), "id").sortWithinPartitions("id").persist(StorageLevel.MEMORY_AND_DISK)
    nets = {i: p.network(activation) for i, p in enumerate(plans)}
    states, done = {i: (net.state(), 0) for i, net in nets.items()}, {}
    best: dict[int, tuple[float, np.ndarray, int]] = {i: (np.inf, s, 0) for i, (s, _) in states.items()}

    def run_of(now: dict[int, tuple[np.ndarray, int]], epoch: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            table = pa.Table.from_batches(parts).combine_chunks()
            label, out_ = table["label"].to_numpy(), table["held"].to_numpy()
            x = table["x"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
            own, rest = np.flatnonzero(~out_), np.flatnonzero(out_)
            for i, (state, steps) in now.items():
                net = plans[i].network(activation).load(state, steps)
                loss = net.loss(x[rest], label[rest]) * len(rest) if len(rest) else 0.0
                if not last:
                    net.epoch(x, label, np.random.default_rng([epoch, int(table["id"][0].as_py()) & 0xFFFFFFFF]).permutation(own))
                values = np.r_[net.state() * len(own), loss, len(rest), len(own), net.steps * len(own)]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], ["i", "v"])

        return run

    try:
        for epoch in range(epochs + 1):
            now = {i: s for i, s in states.items() if i not in done}
            if not now or epoch == epochs and not validation:
                break
            sums = rows.mapInArrow(run_of(now, epoch, epoch == epochs), "i int, v array<double>").select("i", F.posexplode("v").alias("at", "v"))
            total: dict[int, np.ndarray] = {i: np.zeros(len(s) + 4) for i, (s, _) in now.items()}
            for r in sums.groupBy("i", "at").agg(F.sum("v").alias("v")).collect():  # a row for each weight
                total[r["i"]][r["at"]] = r["v"]
            for i, v in total.items():
                loss, of, own, steps = v[-4:]
                if validation and of:
                    least, kept, waited = best[i]
                    best[i] = (loss / of, now[i][0], 0) if loss / of < least else (least, kept, waited + 1)
                    if best[i][2] >= patience:
                        done[i] = best[i][1]
                states[i] = (v[:-4] / max(own, 1), round(steps / max(own, 1)))
    finally:
        rows.unpersist()
    return {p.name: (done.get(i) if i in done else best[i][1] if validation and best[i][0] < np.inf else states[i][0]) for i, p in enumerate(plans)}


def parameters(sizes: list[int]) -> int:
    return sum(a * b + b for a, b in zip(sizes, sizes[1:]))


def gaussian_bayes(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(id, label, score): log prior plus log densities for every class, from (id, x, label); the variances of all
    classes get smoothing times the largest variance of a component. The fitted table has a row per class and component."""
    long = train.select("label", F.posexplode("x").alias("i", "v"))
    spread = F.broadcast(long.groupBy("i").agg(F.var_pop("v").alias("all")).agg((smoothing * F.max("all")).alias("eps")))
    stats = long.groupBy("label", "i").agg(F.avg("v").alias("mu"), F.var_pop("v").alias("var")).crossJoin(spread).select("label", "i", "mu", (F.col("var") + F.col("eps")).alias("var"))
    priors = train.groupBy("label").agg(F.count("*").alias("n"))
    priors = priors.crossJoin(F.broadcast(priors.agg(F.sum("n").alias("total")))).select("label", F.ln(F.col("n") / F.col("total")).alias("prior"))
    table = stats.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "mu", "var"))).alias("s")).join(priors, "label")
    term = lambda s, v: -0.5 * F.ln(2 * 3.141592653589793 * s["var"]) - F.pow(v - s["mu"], 2) / (2 * s["var"])
    score = F.col("prior") + F.aggregate(F.zip_with("s", "x", term), F.lit(0.0), lambda a, b: a + b)
    return test.select("id", "x").crossJoin(F.broadcast(table)).select("id", "label", score.alias("score"))


def least_squares(df: DataFrame, features: list[str], y: str) -> list[float]:
    """Intercept and weights from sums of products: the driver solves a system of the size of the features."""
    names = ["1.0", *features]
    sums = df.selectExpr(*[f"cast({n} as double) as c{i}" for i, n in enumerate(names)], f"cast({y} as double) as y")
    row = sums.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(len(names)) for j in range(len(names))], *[F.sum(F.col(f"c{i}") * F.col("y")) for i in range(len(names))]).first()
    n = len(names)
    a, b = np.array(row[: n * n], float).reshape(n, n), np.array(row[n * n :], float)
    return np.linalg.lstsq(a, b, rcond=None)[0].tolist()
