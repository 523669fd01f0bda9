"""Evaluation of predictions, all from grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import safe_ratio


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, classes: list[int], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n) of all pairs of the classes, also those without rows."""
    counts = df.groupBy(label, predicted).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "label int, predicted int")
    return grid.join(counts.select(F.col(label).alias("label"), F.col(predicted).alias("predicted"), "n"), ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) from a confusion matrix; ratios without value are 0."""
    own = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    by_label = matrix.groupBy("label").agg(own.alias("hits"), F.sum("n").alias("support"))
    by_guess = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    rows = by_label.join(by_guess, "label")
    p, r = safe_ratio(F.col("hits"), F.col("guessed")), safe_ratio(F.col("hits"), F.col("support"))
    return rows.select("label", p.alias("precision"), r.alias("recall"), safe_ratio(2 * F.col("hits"), F.col("guessed") + F.col("support")).alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and weighted means of a report."""
    names = ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro").alias("kind"), *[F.avg(n).alias(n) for n in names])
    weighted = report.agg(F.lit("weighted").alias("kind"), *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names])
    return macro.union(weighted)


def log_loss(p: Column, floor: float = 1e-15) -> Column:
    return F.avg(-F.ln(F.greatest(F.lit(floor), F.least(F.lit(1 - floor), p))))


#: Blocks into which a curve's scores are parted.
BLOCKS = 256


def roc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """(score, tpr, fpr) at every threshold, equal scores together. The curve has a row for each distinct score: its
    running sums go over blocks of scores, parted at quantiles of the scores themselves, with the sums of higher blocks
    added, so the blocks hold about equally many whatever the scores are."""
    points = df.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    edges = points.agg(F.percentile_approx(score, [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS).alias("edges"))
    higher = F.size(F.filter("edges", lambda e: e > F.col(score)))
    points = points.crossJoin(F.broadcast(edges)).withColumn("block", higher).drop("edges")  # one row
    sums = points.groupBy("block").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    sums = sums.select("block", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn"), F.sum("bp").over(whole).alias("tp"), F.sum("bn").over(whole).alias("tn"))
    run = Window.partitionBy("block").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = points.join(sums, "block")
    up, right = F.col("bp") + F.sum("p").over(run), F.col("bn") + F.sum("n").over(run)
    return rows.select(score, "p", "n", "tp", "tn", up.alias("cp"), right.alias("cn"), (up / F.col("tp")).alias("tpr"), (right / F.col("tn")).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids: each threshold's negatives pass the positives before it and half its own."""
    return curve.agg((F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2)) / (F.first("tp") * F.first("tn"))).alias("auc"))


def regression(df: DataFrame, y: str, predicted: str) -> DataFrame:
    e = F.col(y) - F.col(predicted)
    rows = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return rows.select("mse", "mae", (1 - F.col("mse") / F.col("v")).alias("r2"))
