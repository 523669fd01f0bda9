"""Operator 7: toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words and word beginnings as insults and threats with weights, targets, negations, verbs of
reported speech or nothing. Transducers for negation, reported speech and targets are composed into one machine, which
rewrites the classes of a clause, so that what counts is the matched clause and not the word alone: a negated or
reported insult is another symbol than a plain or a targeted one. What the symbols and the best clause of a document
are worth is fitted on labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import spool

#: The most labelled rows that the lexicon and the weights are fitted on, the first by a hash of the id.
LABELLED = 20_000
#: The likelihood ratio (chi-square, one degree), log odds and toxic documents that a word or beginning needs.
EVIDENCE, ODDS, SUPPORT = 20.0, 1.5, 3
PREFIXES = range(3, 9)
#: Words after a negation that it covers.
SCOPE = 3
#: Weights of the arcs that read a hit in the scope of a negation, or in reported speech; along a path they multiply.
NEGATED, REPORTED = 0.3, 0.5

#: Closed word classes of the four languages of the corpus, and threats.
TARGETS = "you your yours yourself he she they them their him her these those du dich dir dein deine ihr euch sie er tu te toi ton ta vous votre vos il elle ils elles tú te ti usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not no never none isn't aren't wasn't don't doesn't didn't won't can't without nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans nunca jamás ningún ninguna sin".split()
REPORTS = "said says say saying called calls call told tells wrote writes quoted quote claimed claims allegedly sagte sagt nannte schrieb behauptete dit disait appelé écrit dijo dice llamó escribió".split()
THREATS = "kill hurt murder stab shoot burn destroy beat strangle töten umbringen schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir".split()

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)


@dataclass
class Transducer:
    """A deterministic weighted transducer over small integers: arcs (state, symbol) -> (state, output, weight); a missing
    arc copies with weight 1."""

    start: int = 0
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, other: Transducer, symbols: int) -> Transducer:
        """The machine that gives what `other` makes of this one's output; the weights of both multiply."""
        numbers, arcs, waiting = {(self.start, other.start): 0}, {}, [(self.start, other.start)]
        while waiting:
            pair = waiting.pop()
            for x in range(symbols):
                a, y, v = self.step(pair[0], x)
                b, z, w = other.step(pair[1], y)
                if (a, b) not in numbers:
                    numbers[a, b] = len(numbers)
                    waiting.append((a, b))
                arcs[numbers[pair], x] = numbers[a, b], z, v * w
        return Transducer(0, arcs)


# Outputs beside the classes: the class plus MARK if negated, plus 2 * MARK if reported, plus 4 * MARK if targeted.
MARK = 8
HITS = (INSULT, THREAT)


def negation() -> Transducer:
    """State s > 0: the next s words lie in the scope of a negation."""
    arcs = {}
    for s in range(SCOPE + 1):
        for x in (NONE, TARGET, REPORT, *HITS):
            covered = s and x in HITS
            arcs[s, x] = max(0, s - 1), x + MARK if covered else x, NEGATED if covered else 1.0
        arcs[s, NEGATION], arcs[s, END] = (SCOPE, NEGATION, 1.0), (0, END, 1.0)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """State 1: a verb of reported speech stands before in the clause."""
    arcs = {(0, REPORT): (1, REPORT, 1.0), (1, END): (0, END, 1.0)}
    arcs |= {(1, x + m): (1, x + m + 2 * MARK, REPORTED) for x in HITS for m in (0, MARK)}
    return Transducer(0, arcs)


def targeted() -> Transducer:
    """State 1: a target stands before in the clause."""
    arcs = {(0, TARGET): (1, TARGET, 1.0), (1, END): (0, END, 1.0)}
    arcs |= {(1, x + m): (1, x + m + 4 * MARK, 1.0) for x in HITS for m in (0, MARK, 2 * MARK, 3 * MARK)}
    return Transducer(0, arcs)


def grammar() -> Transducer:
    return negation().compose(reported(), 8 * MARK).compose(targeted(), 8 * MARK)


def _word(token: str) -> str:
    """The token without what is no letter at its ends."""
    i, j = 0, len(token)
    while i < j and not token[i].isalpha():
        i += 1
    while i < j and not token[j - 1].isalpha():
        j -= 1
    return token[i:j]


class Lexical(dict):
    """Token -> (class, weight, arc, whether a clause ends after it), looked up once for each token."""

    def __init__(self, arcs: dict[str, float]):
        self.arcs = arcs
        self.closed = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}

    def __missing__(self, token: str):
        word, end = _word(token), token[-1:] in ".!?;:"
        found = (NONE, 0.0, "", end)
        if word in self.arcs:
            if self.arcs[word] > 0:
                found = (INSULT, self.arcs[word], word, end)
        elif word in self.closed:
            found = (self.closed[word], 1.0, word, end)
        else:
            for n in reversed(PREFIXES):
                if n < len(word) and (w := self.arcs.get(word[:n] + "*", 0.0)) > 0:
                    found = (INSULT, w, word[:n] + "*", end)
                    break
        if len(self) < 300_000:
            self[token] = found
        return found


FEATURES = ("insults", "negated", "reported", "targeted", "threats", "clause", "arcs", "density")


def features(text: str, lexical: Lexical, machine: Transducer) -> list[float]:
    """What the machine finds in a text; all zero where it has neither insult nor threat."""
    tokens = text.lower().split()
    read = [lexical[t] for t in tokens]
    hits = [i for i, r in enumerate(read) if r[0] in HITS]
    if not hits:
        return [0.0] * len(FEATURES)
    sums, arcs, best, done = dict.fromkeys(FEATURES, 0.0), set(), 0.0, -1
    for hit in hits:
        if hit <= done:
            continue
        first = hit
        while first - 1 > done and not read[first - 1][3]:
            first -= 1
        state, clause, i = machine.start, 0.0, first
        while True:
            kind, weight, arc, end = read[i]
            state, out, part = machine.step(state, kind)
            if kind in HITS:
                marks, base = divmod(out, MARK)
                name = "negated" if marks & 1 else "reported" if marks & 2 else "threats" if base == THREAT else "targeted" if marks & 4 else "insults"
                sums[name] += weight
                if kind == INSULT:
                    arcs.add(arc)
                    clause += weight * part
            if end or i + 1 == len(read):
                break
            i += 1
        best, done = max(best, clause), i
    scaled = {k: np.log1p(v) for k, v in sums.items()}
    scaled |= {"clause": np.log1p(best), "arcs": np.log1p(len(arcs)), "density": np.log1p(1000 * sum(sums.values()) / (len(tokens) + 20))}
    return [float(scaled[k]) for k in FEATURES]


def evidence(t: np.ndarray, n: np.ndarray, all_t: float, all_n: float) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio and log odds of words on t of all_t toxic and n of all_n other documents."""
    share, rest = all_t / max(1.0, all_t + all_n), all_n / max(1.0, all_t + all_n)
    both = t + n
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(t > 0, t * np.log(t / (both * share)), 0) + np.where(n > 0, n * np.log(n / (both * rest)), 0))
    odds = np.log((t + 0.5) / (all_t - t + 0.5)) - np.log((n + 0.5) / (all_n - n + 0.5))
    return ratio, odds


def strong(t: np.ndarray, n: np.ndarray, all_t: float, all_n: float) -> np.ndarray:
    """Whether each word speaks for toxicity; none does where documents of one kind are lacking."""
    if not all_t or not all_n:
        return np.zeros(len(t), bool)
    ratio, odds = evidence(t, n, all_t, all_n)
    return (ratio >= EVIDENCE) & (odds > ODDS) & (t >= SUPPORT)


def lexicon(counts: list[tuple[str, float, float]], all_t: float, all_n: float) -> dict[str, float]:
    """Arcs with their log odds; a beginning needs no word of its own. Words that speak against toxicity under a
    beginning that speaks for it are kept with weight 0."""
    if not counts or not all_t or not all_n:
        return {}
    names = [c[0] for c in counts]
    t, n = (np.array([c[i] for c in counts]) for i in (1, 2))
    kept, odds = strong(t, n, all_t, all_n), evidence(t, n, all_t, all_n)[1]
    arcs = {names[i]: float(odds[i]) for i in np.flatnonzero(kept)}
    for i in np.flatnonzero(~kept & (n >= SUPPORT) & (odds < 2)):
        if not names[i].endswith("*") and any(names[i][:k] + "*" in arcs for k in PREFIXES):
            arcs[names[i]] = 0.0
    return arcs


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and last the intercept of a logistic regression with a ridge penalty, by Newton's method."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    arcs: dict[str, float]
    weights: np.ndarray

    def scorer(self):
        lexical, machine = Lexical(self.arcs), grammar()

        def score(text: str) -> float:
            z = float(np.dot(features(text, lexical, machine), self.weights[:-1]) + self.weights[-1])
            return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))

        return score


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Lexicon and weights from labelled documents that are not held out, at most LABELLED of them.

    The weights are fitted on features for which either half of the rows is read with the other half's lexicon, so they
    do not trust words that are rare in the whole. Equal texts count once. To the driver come the words that speak for
    toxicity and those under such a beginning that speak against it, both bounded by the LABELLED texts. Without rows,
    or without labels of either kind, the model has no arcs and scores every text near 0.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64(id_col), id_col).limit(LABELLED)
    known = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(rows), id_col)
    known, _ = spool(known.groupBy("t").agg(F.max("y").alias("y")).withColumn("fold", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, y, fold in zip(*(batch.column(i) for i in range(3))):
                words = {_word(t) for t in text.as_py().lower().split()}
                found = words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)}
                seen.update((w, fold.as_py(), y.as_py()) for w in found if w)
            columns = list(zip(*((*k, n) for k, n in seen.items()))) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "fold", "y", "n"])

    sums = known.select("t", "y", "fold").mapInArrow(count, "word string, fold int, y int, n long")
    part = lambda f, y: F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n"))), F.lit(0))
    sums = sums.groupBy("word").agg(part(0, 1).alias("t0"), part(0, 0).alias("n0"), part(1, 1).alias("t1"), part(1, 0).alias("n1"))
    sums, _ = spool(sums, "words")
    sizes = {(r["fold"], r["y"]): r["n"] for r in known.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    number = lambda f, y: float(sizes.get((f, y), 0))
    totals = [(number(0, 1), number(0, 0)), (number(1, 1), number(1, 0))]
    totals.append(tuple(a + b for a, b in zip(*totals)))

    def speaking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t0, n0, t1, n1 = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 5))
            halves = [(t0, n0), (t1, n1), (t0 + t1, n0 + n1)]
            yield batch.filter(pa.array(np.logical_or.reduce([strong(*half, *total) for half, total in zip(halves, totals)])))

    found = sums.mapInArrow(speaking, sums.schema)
    beginnings = found.where(F.col("word").endswith("*")).select(F.col("word").alias("beginning"))
    lengths = F.sequence(F.lit(PREFIXES.start), F.least(F.lit(PREFIXES.stop), F.length("word")) - 1)
    against = sums.where(~F.col("word").endswith("*") & (F.length("word") > PREFIXES.start) & (F.col("n0") + F.col("n1") >= SUPPORT))
    against = against.withColumn("beginning", F.explode(F.transform(lengths, lambda k: F.concat(F.col("word").substr(F.lit(1), k), F.lit("*")))))
    against = against.join(beginnings, "beginning", "left_semi").drop("beginning")
    kept = found.union(against).distinct().orderBy("word").collect()
    arcs = [lexicon([(r["word"], float(r[f"t{f}"]), float(r[f"n{f}"])) for r in kept], *totals[f]) for f in (0, 1)]
    whole = lexicon([(r["word"], float(r["t0"] + r["t1"]), float(r["n0"] + r["n1"])) for r in kept], *totals[2])
    if not whole:
        return Model({}, np.r_[np.zeros(len(FEATURES)), -30.0])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicals, machine = [Lexical(arcs[1]), Lexical(arcs[0])], grammar()
        for batch in batches:
            x = [features(t.as_py(), lexicals[f.as_py()], machine) for t, f in zip(batch.column(0), batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    measured = known.select("t", "y", "fold").mapInArrow(measure, "x array<double>, y int").collect()
    return Model(whole, fit(np.array([r["x"] for r in measured]), np.array([r["y"] for r in measured], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; null texts are empty, and empty ones get the score of a text without matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t.as_py() or "") for t in batch.column(1)], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
