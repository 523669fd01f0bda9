"""Exact quantiles by distributed selection: no task ever orders more than a bounded number of values."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows between the bounds of a quantile, beyond which they are narrowed once more.
LIMIT = 100_000
#: Accuracy of the sketches that propose bounds, and the number of proposals after the first.
ACCURACY, PROPOSALS = 10_000, 1024


def held(df: DataFrame) -> DataFrame:
    """df, computed once: a checkpoint in the folder that the cluster names, for local sessions a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint()


def _with_state(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    if not by:
        return rows.crossJoin(F.broadcast(state))  # one row
    keys = [f"_k{i}" for i in range(len(by))]
    on = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]
    return rows.join(state.withColumnsRenamed(dict(zip(by, keys))), on).drop(*keys)


_TARGET = "struct<rank:bigint,part:double,lo:double,below:bigint,upto:bigint,hi:double,under:bigint,a:double,b:double>"


def _inside(t: Column) -> Column:
    """How many values lie strictly between the bounds."""
    return F.greatest(t["under"] - t["upto"], F.lit(0))


def bounds(rows: DataFrame, probabilities: list[float], by: list[str], limit: int = LIMIT, accuracy: int = ACCURACY, proposals: int = PROPOSALS, passes: int = 64) -> DataFrame:
    """(by, n, t) for rows (by, _v) without nulls; t is an array with a struct for each probability.

    The values of ranks `rank` and rank + 1, counted from 0, lie in [lo, hi], null being no bound. `below` values are
    smaller than lo, `upto` at most lo, `under` smaller than hi; at most `limit` lie strictly between, in every group.

    A sketch of bounded size proposes a and b, which exact counts accept as bounds or not; a sketch of what lies between
    proposes the next. Each pass reads the rows once and combines before its shuffle. A sketch that errs costs a pass.
    """
    first = [x for p in probabilities for x in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    start = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", first, accuracy).alias("_s"))
    none, zero, v = F.lit(None).cast("double"), F.lit(0).cast("long"), F.col("_v")

    def struct(**fields: Column) -> Column:
        return F.struct(*[x.alias(k) for k, x in fields.items()]).cast(_TARGET)

    def target(i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("n") - 1)
        return struct(rank=F.floor(at), part=at - F.floor(at), lo=none, below=zero, upto=zero, hi=none, under=F.col("n"), a=F.col("_s")[2 * i], b=F.col("_s")[2 * i + 1])

    state = held(start.select(*by, "n", F.array(*[target(i, p) for i, p in enumerate(probabilities)]).alias("t")))
    grid = [i / proposals for i in range(proposals + 1)]
    for _ in range(passes):
        if not state.where(F.exists("t", lambda t: _inside(t) > limit)).limit(1).count():
            break
        found = [F.first("n").alias("n"), F.first("t").alias("t")]
        for i in range(len(probabilities)):
            t = F.col("t")[i]
            wide = _inside(t) > limit
            found += [F.count(F.when(wide & test, 1)).alias(f"{name}{i}") for name, test in (("lt_a", v < t["a"]), ("le_a", v <= t["a"]), ("lt_b", v < t["b"]), ("le_b", v <= t["b"]))]
            between = (F.coalesce(v > F.coalesce(t["a"], t["lo"]), F.lit(True))) & (F.coalesce(v < F.coalesce(t["b"], t["hi"]), F.lit(True)))
            found.append(F.percentile_approx(F.when(wide & between, v), grid, accuracy).alias(f"s{i}"))
        counted = _with_state(rows, state, by).groupBy(*by).agg(*found)

        def narrowed(i: int) -> Column:
            t = F.col("t")[i]
            cuts = {c: (t[c], F.col(f"lt_{c}{i}"), F.col(f"le_{c}{i}")) for c in "ab"}
            low = lambda c: cuts[c][0].isNotNull() & (cuts[c][1] <= t["rank"])
            high = lambda c: cuts[c][0].isNotNull() & (cuts[c][2] >= F.least(t["rank"] + 2, F.col("n")))
            pick = lambda of, k, old: F.when(of("b"), cuts["b"][k]).when(of("a"), cuts["a"][k]).otherwise(t[old])
            least = lambda k, old: F.when(high("a"), cuts["a"][k]).when(high("b"), cuts["b"][k]).otherwise(t[old])
            lo, below, upto, hi, under = pick(low, 0, "lo"), pick(low, 1, "below"), pick(low, 2, "upto"), least(0, "hi"), least(1, "under")
            # the sketch covers what is left if it was of the same stretch: between a and b, or lo and hi without them
            fits = lo.eqNullSafe(F.coalesce(t["a"], t["lo"])) & hi.eqNullSafe(F.coalesce(t["b"], t["hi"]))
            at = F.floor((t["rank"] - upto) * proposals / F.greatest(under - upto, F.lit(1)))
            of_grid = lambda k: F.when(fits, F.get(F.col(f"s{i}"), F.least(F.greatest(at + k, F.lit(0)), F.lit(proposals)).cast("int")))
            out = struct(rank=t["rank"], part=t["part"], lo=lo, below=below, upto=upto, hi=hi, under=under, a=of_grid(-2), b=of_grid(3))
            return F.when(_inside(t) > limit, out).otherwise(t)

        state = held(counted.select(*by, "n", F.array(*[narrowed(i) for i in range(len(probabilities))]).alias("t")))
    return state


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None, limit: int = LIMIT, accuracy: int = ACCURACY, proposals: int = PROPOSALS) -> DataFrame:
    """(by, n, q0, q1, ...): for each group the exact quantiles of a column, interpolated between neighbouring values.

    Nulls are left out; a group without values, and an empty table, give no row. The bounds of each quantile are narrowed
    until few values lie between them; these are counted by value and numbered, at most `limit` and the two bounds in a
    task, however many values a group has.
    """
    by = list(by or [])
    rows = df.select(*by, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    state = bounds(rows, probabilities, by, limit, accuracy, proposals)
    within = lambda t: F.coalesce(F.col("_v") >= t["lo"], F.lit(True)) & F.coalesce(F.col("_v") <= t["hi"], F.lit(True))
    near = _with_state(rows, state, by).select(*by, "n", "_v", F.posexplode("t").alias("_i", "_t")).where(within(F.col("_t")))
    counted = near.groupBy(*by, "n", "_i", "_v").agg(F.first("_t").alias("_t"), F.count("*").alias("_c"))
    order = Window.partitionBy(*by, "_i").orderBy("_v")
    upto = F.col("_t.below") + F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)
    at = lambda k: F.min(F.when(F.col("_upto") > F.least(F.col("_t.rank") + k, F.col("n") - 1), F.col("_v")))
    values = placed.groupBy(*by, "n", "_i").agg(at(0).alias("_low"), at(1).alias("_high"), F.first("_t.part").alias("_part"))
    value = (1 - F.col("_part")) * F.col("_low") + F.col("_part") * F.col("_high")
    return values.groupBy(*by, "n").agg(*[F.max(F.when(F.col("_i") == i, value)).alias(f"q{i}") for i in range(len(probabilities))])
