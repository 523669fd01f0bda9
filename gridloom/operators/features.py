"""Statistics and features: fitted numbers are one-row tables that join as broadcasts, fitted on the training rows only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import gram, keys
from gridloom.operators.quantiles import quantiles


#: Columns whose pairs are aggregates of one plan; more go by blocks.
FEW = 12


def correlations(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """(a, b, r) of every pair of columns, pairs with a missing value left out; null where r has no value, no pairs of no
    rows. Few columns are aggregated in the JVM; with many the plan would grow with their pairs, so blocks are summed."""
    found = _few_correlations(df, columns) if 2 <= len(columns) <= FEW else gram.correlations(df, columns)
    return found.withColumn("r", F.round("r", digits)) if digits is not None else found


def _few_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = list(combinations(columns, 2))

    def r_of(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))  # corr itself fails on a constant

    row = df.agg(F.count("*").alias("rows"), *[r_of(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).where("rows > 0")
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*each)).alias("p")).select("p.a", "p.b", F.nanvl("p.r", F.lit(None).cast("double")).alias("r"))


def correlation_filter(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """(name, kept): a column goes if its |r| with any earlier column exceeds the limit."""
    late = correlations(df, columns).where(F.abs("r") > limit).select(F.col("b").alias("name")).distinct().withColumn("kept", F.lit(False))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return every.join(late, "name", "left").select("name", F.coalesce("kept", F.lit(True)).alias("kept"))


def factorize(df: DataFrame, column: str, order: str) -> DataFrame:
    """Codes of a column's values from 0 by their first appearance."""
    first = df.groupBy(F.col(column).alias("_value")).agg(F.min(order).alias("_first"))
    coded = keys.sequence(first, ["_first", "_value"], "code", after=-1).select("_value", "code")
    return df.join(coded, df[column].eqNullSafe(F.col("_value"))).drop("_value")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Codes from 0 in the order of the values."""
    values = df.select(F.col(column).alias("_value")).distinct()
    coded = keys.sequence(values, ["_value"], "code", after=-1)
    return df.join(coded, df[column].eqNullSafe(F.col("_value"))).drop("_value")


def density(df: DataFrame, column: str, points: int, width: float) -> DataFrame:
    """Gaussian kernel density on a grid from the least to the largest value. Equal values are counted first; each distinct
    one adds to the sums of all grid points, which are columns of one aggregate, so no row meets the grid."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = [F.col("lo") + i * (F.col("hi") - F.col("lo")) / (points - 1) for i in range(points)]
    sums = [F.sum(F.col("n") * F.exp(-0.5 * F.pow((x - F.col("v")) / width, 2))).alias(f"s{i}") for i, x in enumerate(at)]
    whole = values.crossJoin(F.broadcast(ends)).groupBy("lo", "hi").agg(F.sum("n").alias("n"), *sums)  # one row of ends
    norm = width * (2 * 3.141592653589793) ** 0.5
    rows = F.array(*[F.struct(x.alias("x"), F.round(F.col(f"s{i}") / (F.col("n") * norm), 8).alias("density")) for i, x in enumerate(at)])
    return whole.select(F.inline(rows)).groupBy("x").agg(F.first("density").alias("density"))  # one value: one point


def one_hot(df: DataFrame, column: str, values: list[str], drop_first: bool = False) -> DataFrame:
    """An integer column for each of the values in their order."""
    values = sorted(values)[1 if drop_first else 0 :]
    return df.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values]).drop(column)


def impute_median(long: DataFrame, name: str, value: str, train: str, least: float) -> DataFrame:
    """Long rows with missing values set to the training rows' median; names with too few values there are dropped."""
    fitted = long.where(train)
    sizes = fitted.groupBy(F.col(name).alias("_name")).agg(F.count(value).alias("_known"), F.count("*").alias("_all"))
    medians = sizes.join(quantiles(fitted, value, [0.5], [name]).select(F.col(name).alias("_of"), F.col("q0").alias("_median")), F.col("_name") == F.col("_of"), "left").drop("_of")
    medians = medians.where(F.col("_known") >= least * F.col("_all"))
    return long.join(medians, F.col(name) == F.col("_name")).withColumn(value, F.coalesce(value, "_median")).drop("_name", "_median", "_known", "_all")


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Missing values set to the most frequent one, the least of equals."""
    mode = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_mode")).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), "_mode").limit(1).select("_mode")
    return df.crossJoin(F.broadcast(mode)).withColumn(column, F.coalesce(column, "_mode")).drop("_mode")


def standardize(df: DataFrame, columns: list[str], train: str = "true") -> DataFrame:
    """(x - mean) / population deviation of the training rows; a deviation of almost 0 counts as 1."""
    fitted = df.where(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(fitted))
    for c in columns:
        scale = F.when(F.col(f"_s_{c}") < 1e-12, 1.0).otherwise(F.col(f"_s_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / scale)
    return out.drop(*fitted.columns)


def winsorize(df: DataFrame, column: str, train: str = "true") -> DataFrame:
    """Values cut at the third quartile plus 1.5 times the quartiles' distance of the training rows."""
    q = quantiles(df.where(train), column, [0.25, 0.75]).select(F.col("q0").alias("_q1"), F.col("q1").alias("_q3"))
    limit = F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))
    return df.crossJoin(F.broadcast(q)).withColumn(column, F.least(F.col(column), limit)).drop("_q1", "_q3")


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    """The products of all pairs beside the columns."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(columns, 2)])


def yeo_johnson(x: Column, power: float) -> Column:
    up = F.log1p(x) if power == 0 else (F.pow(x + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-x) if power == 2 else -(F.pow(1 - x, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_fit(df: DataFrame, column: str, train: str = "true") -> DataFrame:
    """The column under the power of largest likelihood on a grid of step 0.05, standardised; all powers in one pass."""
    powers = [round(-2 + 0.05 * i, 2) for i in range(81)]
    x = F.col(column)
    slope = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    row = df.where(train).agg(F.count("*").alias("n"), slope.alias("s"), *[F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(powers)]).first()
    from math import log

    power = max(range(len(powers)), key=lambda i: -row["n"] / 2 * log(max(row[f"v{i}"], 1e-300)) + (powers[i] - 1) * row["s"])
    out = standardize(df.withColumn(column, yeo_johnson(x, powers[power])), [column], train)
    return out.withColumn("power", F.lit(powers[power]))


def stratified_split(df: DataFrame, label: str, key: str, share: float) -> DataFrame:
    """Adds train: the first share of each class, rounded up, by a hash of the key.

    Hash ranges of a class are counted first, so only the rows of one range are ordered in a task.
    """
    rows = df.withColumn("_h", F.xxhash64(key)).withColumn("_block", F.shiftright("_h", 54))
    sizes = rows.groupBy(label, "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_block")
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(label)))
    place = F.row_number().over(Window.partitionBy(label, "_block").orderBy("_h", key))
    out = rows.withColumn("_place", place).join(sizes, [label, "_block"])
    return out.withColumn("train", F.col("_before") + F.col("_place") <= F.ceil(share * F.col("_all"))).drop("_h", "_block", "_n", "_before", "_all", "_place")


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order, null where df lacks one."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
