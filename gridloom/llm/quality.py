"""Operator 3: quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The words of the model are characters, of any number and unfolded but for the digits; counts, probabilities and costs are tables dealt out
by n-gram, which the n-grams of all texts join (ngrams.py).

Texts are dealt to FOLDS by a hash, and each is scored by the model of the trusted texts of the other folds: neither a
text nor its copies teach the model that scores it, so trusted and unlabelled documents are measured alike.

The second half of this module, from alphabet on, is a closed model over 64 folded symbols that one process can hold
whole. Neither classify nor kept uses it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import spool, without
from gridloom.llm.ngrams import FOLDS, costed, fold_of

ORDER, SIZE = 4, 64
#: Texts are read in runs of so many characters.
RUN = 1 << 20
#: Symbols at the median of the language that every text gets besides its own: short texts prove little.
PRIOR = 100
QUANTILE = 0.998
_SPACE, _BREAK, _UPPER, _DIGIT, _OTHER, _LETTERS, _SIGNS, _FOREIGN = 0, 1, 2, 3, 4, 5, 31, 51
_MARKS = ".,;:!?'\"()-|#$%&*/@="


def thresholds(found: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(lang, middle, threshold) of the trusted documents of each language, from a table with _cost and _symbols."""
    good = trusted_ids(labels, id_col)
    rows = found.join(good, id_col, "left_semi").select(F.col(lang_col).alias("lang"), "_cost", "_symbols")
    middle = rows.where("_symbols > 0").groupBy("lang").agg(F.percentile_approx(F.col("_cost") / F.col("_symbols"), 0.5, 100_000).alias("middle"))
    both = rows.join(middle.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    return both.groupBy("lang", "middle").agg(F.percentile_approx(smoothed(), quantile, 100_000).alias("threshold"))


def smoothed() -> Column:
    return (F.col("_cost") + PRIOR * F.col("middle")) / (F.col("_symbols") + PRIOR)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()


def judge(found: DataFrame, limits: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Adds middle, threshold and _keep to a table with _cost and _symbols."""
    limits = limits.withColumnRenamed("lang", "_lang")
    out = found.join(limits, F.col(lang_col).eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return out.withColumn("_keep", F.coalesce(smoothed() <= F.col("threshold"), F.lit(True)))


def learn(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(id, lang, _digest, _cost, _symbols) of all rows by the folds' models of the documents labelled quality 1, and the
    languages' thresholds."""
    found, _ = spool(costed(docs, trusted_ids(labels, id_col), id_col, text_col, lang_col), "costs")
    limits, _ = spool(thresholds(found, labels, quantile, id_col, lang_col), "thresholds")
    return found, limits


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, perplexity, threshold, keep) of every row.

    A text's perplexity is taken over its characters and PRIOR more at the median of its language; it is rejected above
    the quantile of that among the trusted documents of the language. Languages without trusted documents, null being
    one of its own, reject nothing; empty and null texts have the median and stay. Repeated rows stay repeated.
    """
    found, limits = learn(docs, labels, quantile, id_col, text_col, lang_col)
    out = judge(found, limits, lang_col)
    return out.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.exp(F.coalesce(smoothed(), F.col("_cost") / F.greatest(F.col("_symbols"), F.lit(1)))).alias("perplexity"), F.exp("threshold").alias("threshold"), F.col("_keep").alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that classify keeps, with their columns. Equal texts of a language are judged alike, so those that
    are rejected are left out by language and MD5."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns of any name pass through under plain ones
    place = {c: names[docs.columns.index(c)] for c in (id_col, text_col, lang_col)}
    found, limits = learn(docs, labels, quantile, id_col, text_col, lang_col)
    rejected, _ = spool(judge(found, limits, lang_col).where("NOT _keep").select("_digest", F.col(lang_col).alias("_lang")).distinct(), "rejected")
    rows = docs.toDF(*names)
    digest = F.unhex(F.md5(F.coalesce(F.col(place[text_col]), F.lit(""))))
    same = (digest == F.col("_digest")) & F.col(place[lang_col]).eqNullSafe(F.col("_lang"))
    return without(rows, rejected, same, F.xxhash64(digest), F.xxhash64("_digest")).toDF(*docs.columns)


def alphabet() -> np.ndarray:
    """Symbol of each character of the basic plane: blanks, breaks, capitals and digits are one each, a-z and common
    marks have their own, other letters share thirteen, all else is one."""
    table = np.full(1 << 16, _OTHER, np.int64)
    for c in range(0xAA, 1 << 16):
        if (x := chr(c)).isalpha():
            table[c] = _UPPER if x.isupper() else _FOREIGN + c % (SIZE - _FOREIGN)
    for c in range(128):
        x = chr(c)
        if x in " \t":
            table[c] = _SPACE
        elif x.isspace():
            table[c] = _BREAK
        elif x.isupper():
            table[c] = _UPPER
        elif x.isdigit():
            table[c] = _DIGIT
        elif x.isalpha():
            table[c] = _LETTERS + c - ord("a")
        elif x in _MARKS:
            table[c] = _SIGNS + _MARKS.index(x)
    return table


def codes(text: str, table: np.ndarray, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-grams that end at each character, as numbers to the base SIZE, run by run; a text starts after breaks."""
    tail = np.full(order - 1, _BREAK, np.int64)
    for at in range(0, len(text), RUN):
        points = np.frombuffer(text[at : at + RUN].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = np.concatenate([tail, table[np.minimum(points, 0xFFFF)] if points.max(initial=0) <= 0xFFFF else np.where(points > 0xFFFF, _OTHER, table[np.minimum(points, 0xFFFF)])])
        code = s[: len(s) - order + 1].copy()
        for k in range(1, order):
            code *= SIZE
            code += s[k : len(s) - order + 1 + k]
        yield code
        tail = s[len(s) - order + 1 :]


def count(texts: DataFrame, text_col: str = "text", folds: int = 1) -> DataFrame:
    """(fold, code, n) of the n-grams of all texts of each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = alphabet(), {}
        for batch in batches:
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
                if fold not in counts:
                    counts[fold] = np.zeros(SIZE**ORDER, np.uint32)
                for code in codes(text.as_py() or "", table):
                    np.add.at(counts[fold], code, 1)
        for fold, own in counts.items():
            found = np.flatnonzero(own)
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                columns = [pa.array(np.full(len(part), fold, np.int32)), pa.array(part.astype(np.int64)), pa.array(own[part].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["fold", "code", "n"])

    found = texts.select(F.col(text_col), fold_of(text_col, folds)).mapInArrow(run, "fold int, code long, n long")
    return found.groupBy("fold", "code").agg(F.sum("n").alias("n"))


#: Keys and values of the entries of each order.
Entries = dict[int, tuple[np.ndarray, np.ndarray]]


def costs_of(seen: Entries, weight: Entries) -> np.ndarray:
    """-log p of every n-gram, from the probabilities of those that were seen and the weights of contexts; one that was
    not seen has its context's weight times the lower order's probability."""
    p = np.full(1, 1 / SIZE, np.float32)
    for k in range(1, ORDER + 1):
        shares = np.ones(SIZE ** (k - 1), np.float32)
        if k in weight:
            shares[weight[k][0]] = weight[k][1]
        lower = p.reshape(-1, SIZE) if k > 1 else np.full((1, SIZE), p[0], np.float32)
        p = (shares.reshape(-1, len(lower), 1) * lower[None]).reshape(-1)
        if k in seen:
            p[seen[k][0]] = seen[k][1]
    return -np.log(np.maximum(p, 1e-12))


@dataclass
class Model:
    """Probabilities of the n-grams that were seen and weights of lower orders, by order."""

    seen: Entries
    weight: Entries

    def costs(self) -> np.ndarray:
        return costs_of(self.seen, self.weight)


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """A model of all the texts."""
    return fit(spool(count(texts, text_col), "counts")[0].select("code", "n"))


def train_folds(texts: DataFrame, text_col: str = "text") -> list[Model]:
    """For each fold the model of the texts of all others."""
    counts, _ = spool(count(texts, text_col, FOLDS), "counts")
    return [fit(spool(counts.where(F.col("fold") != f).groupBy("code").agg(F.sum("n").alias("n")), "counts")[0]) for f in range(FOLDS)]


def fit(counts: DataFrame) -> Model:
    """A model from (code, n). Counts of the highest order are those of all texts; a lower order counts the different
    symbols before an n-gram. Discounts for counts of one, two and more come from the counts of counts of each order."""
    seen, weight, lower = {}, {}, None
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy((F.col("code") % SIZE**k).alias("code")).agg(F.count("*").alias("n"))
    for k in range(1, ORDER + 1):
        t = tables[k]
        n1, n2, n3, n4 = (float(x) for x in t.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        d = [max(0.0, i - (i + 1) * y * b / a) if a else 0.0 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2]))
        t = t.withColumn("context", F.floor(F.col("code") / SIZE).cast("long"))
        contexts = t.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
        own = t.join(contexts, "context").select("code", ((F.col("n") - discount) / F.col("total")).alias("own"), "weight")
        if lower is None:
            full = own.select("code", (F.col("own") + F.col("weight") / SIZE).alias("p"))
        else:
            suffix = lower.withColumnRenamed("code", "suffix").withColumnRenamed("p", "lower")
            full = own.withColumn("suffix", F.col("code") % SIZE ** (k - 1)).join(suffix, "suffix").select("code", (F.col("own") + F.col("weight") * F.col("lower")).alias("p"))
        lower, _ = spool(full, "probabilities")
        for into, rows in ((seen, lower), (weight, contexts.select("context", "weight"))):
            found = rows.toPandas()
            into[k] = found.iloc[:, 0].to_numpy(np.int64), found.iloc[:, 1].to_numpy(np.float32)
    return Model(seen, weight)


def scored(docs: DataFrame, models: list[Model], text_col: str = "text") -> DataFrame:
    """docs with the columns _cost, the sum of -log p over the whole text by its fold's model, and _symbols, its length."""
    shared = docs.sparkSession.sparkContext.broadcast([{"seen": m.seen, "weight": m.weight} for m in models])  # plain arrays need no package there
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields]).add("_cost", "double").add("_symbols", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = alphabet(), shared.value
        for model in held:
            if "costs" not in model:  # once for all tasks of a worker
                model["costs"] = costs_of(model["seen"], model["weight"])
        for batch in batches:
            sums, sizes = [], []
            for text, fold in zip(batch.column(place), batch.column(batch.num_columns - 1).to_pylist()):
                text, costs = text.as_py() or "", held[fold]["costs"]
                sums.append(sum(float(costs[c].sum(dtype=np.float64)) for c in codes(text, table)))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], schema.names)

    return docs.select("*", fold_of(text_col, len(models)).alias("_fold")).mapInArrow(run, schema)
