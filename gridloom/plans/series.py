"""Queries on measurements over time, their statistics and features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import functions as gf
from gridloom.operators import features, series
from gridloom.operators.quantiles import quantiles
from gridloom.operators.series import measurements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

M = """m AS (
    SELECT event_id, ts, user_id, CASE WHEN event_type = 'error' THEN 'Déconnecté' ELSE 'Connecté' END AS status, CASE WHEN event_type IN ('view', 'click', 'error') THEN value ELSE 0.0 END AS download,
        CASE WHEN event_type IN ('view', 'click', 'error') THEN 0.0 ELSE value END AS upload, value AS total, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id FROM events
)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {M} {sql}"
        return f

    return keep


def on_m(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, d: f(measurements(spark, d)))


def total(c: str, digits: int = 4) -> Column:
    return F.round(F.sum(c), digits)


def mean(c, digits: int = 6) -> Column:
    return F.round(F.avg(c), digits)


# --- filters, conditions, maps --------------------------------------------------------------------------------------

on_m("flt_nonneg", lambda m: m.where("download - 1 >= 0 AND upload >= 0 AND total >= 0").select("event_id"), "SELECT event_id FROM m WHERE download - 1 >= 0 AND upload >= 0 AND total >= 0")


def below_quantiles(m: DataFrame) -> DataFrame:
    """Rows below the 99 % quantiles of download and upload; the two numbers are one row, joined as a broadcast."""
    limits = quantiles(m, "download", [0.99]).select(F.col("q0").alias("qd")).crossJoin(F.broadcast(quantiles(m, "upload", [0.99]).select(F.col("q0").alias("qu"))))
    return m.crossJoin(F.broadcast(limits)).where("download < qd AND upload < qu").select("event_id")


on_m("flt_quantile", below_quantiles, "SELECT event_id FROM m, (SELECT quantile_cont(download, 0.99) AS qd, quantile_cont(upload, 0.99) AS qu FROM m) WHERE download < qd AND upload < qu")
on_m("flt_isin", lambda m: m.select("event_id", series.day_name(F.col("ts")).isin("Samedi", "Dimanche").cast("int").alias("weekend")), "SELECT event_id, (isodow(ts) >= 6)::INTEGER AS weekend FROM m")
on_m("flt_dropna", lambda m: m.withColumn("x", F.when(F.col("download") > 0, F.col("download"))).na.drop(subset=["x"]).select("event_id"), "SELECT event_id FROM m WHERE download > 0")
on_m("flt_session", lambda m: m.where(F.col("session_id") == "8-2024-01-01").select("event_id", "total"), "SELECT event_id, total FROM m WHERE session_id = '8-2024-01-01'")
HOUR = "hour(ts)"
P7 = "CASE " + " ".join(f"WHEN {HOUR} >= {h} THEN '{x}'" for h, x in series.PARTS_7) + " ELSE 'Aube' END"
P4 = "CASE " + " ".join(f"WHEN {HOUR} >= {h} THEN '{x}'" for h, x in series.PARTS_4) + " ELSE 'Nuit' END"
on_m("cse_period7", lambda m: m.select("event_id", series.day_part(F.hour("ts"), series.PARTS_7, "Aube").alias("part")), f"SELECT event_id, {P7} AS part FROM m")
on_m("cse_period4", lambda m: m.select("event_id", series.day_part(F.hour("ts"), series.PARTS_4, "Nuit").alias("part")), f"SELECT event_id, {P4} AS part FROM m")
on_m("map_dict", lambda m: m.select("event_id", gf.codes(F.col("status"), {"Connecté": 1}).alias("code")), "SELECT event_id, CASE WHEN status = 'Connecté' THEN 1 END AS code FROM m")

# --- aggregates -----------------------------------------------------------------------------------------------------

on_m("agg_value_counts", lambda m: m.groupBy("status").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)), "SELECT status, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY status")
on_m("agg_mean_by", lambda m: m.groupBy("status").agg(mean("download").alias("download"), mean("total").alias("total")), "SELECT status, round(avg(download), 6) AS download, round(avg(total), 6) AS total FROM m GROUP BY status")
on_m(
    "agg_cond_mean",
    lambda m: m.agg(F.round(F.avg(F.when(F.col("status") == "Connecté", F.col("total"))), 6).alias("up"), F.round(F.avg(F.when(F.col("status") != "Connecté", F.col("total"))), 6).alias("down")).withColumn("ratio", F.round(F.try_divide("up", "down"), 4)),
    "SELECT *, round(up / down, 4) AS ratio FROM (SELECT round(avg(total) FILTER (status = 'Connecté'), 6) AS up, round(avg(total) FILTER (status <> 'Connecté'), 6) AS down FROM m)",
)


def described(m: DataFrame) -> DataFrame:
    q = quantiles(m, "total", [0.25, 0.5, 0.75]).select(*[F.round(f"q{i}", 6).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])
    rest = m.agg(F.count("total").alias("n"), mean("total").alias("mean"), F.round(F.stddev("total"), 6).alias("std"), F.min("total").alias("lo"), F.max("total").alias("hi"))
    return rest.crossJoin(F.broadcast(q)).select("n", "mean", "std", "lo", "q25", "q50", "q75", "hi")


on_m(
    "agg_describe",
    described,
    "SELECT count(total) AS n, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std, min(total) AS lo, round(quantile_cont(total, 0.25), 6) AS q25, round(quantile_cont(total, 0.5), 6) AS q50, round(quantile_cont(total, 0.75), 6) AS q75, max(total) AS hi FROM m",
)
on_m("agg_quantile", lambda m: quantiles(m, "total", [0.25, 0.75, 0.99], ["status"]).select("status", *[F.round(f"q{i}", 6).alias(f"q{p}") for i, p in enumerate((25, 75, 99))]), "SELECT status, " + ", ".join(f"round(quantile_cont(total, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.75, 0.99)) + " FROM m GROUP BY status")
on_m("agg_median", lambda m: quantiles(m, "total", [0.5], ["status"]).select("status", F.round("q0", 6).alias("median")), "SELECT status, round(median(total), 6) AS median FROM m GROUP BY status")


def session_totals(m: DataFrame) -> DataFrame:
    out = m.groupBy("session_id").agg(F.count("*").alias("n"), total("download").alias("download"), total("upload").alias("upload"), total("total").alias("total"))
    return out.withColumn("total_go", F.col("total") / 1024)


SESSION = "SELECT *, total / 1024 AS total_go FROM (SELECT session_id, count(*) AS n, round(sum(download), 4) AS download, round(sum(upload), 4) AS upload, round(sum(total), 4) AS total FROM m GROUP BY session_id)"
on_m("agg_session_totals", session_totals, SESSION)


def resample_sql(minutes: int) -> str:
    bin_ = f"time_bucket(INTERVAL {minutes} MINUTES, {{}}, TIMESTAMP '1970-01-01')"
    return (
        f"SELECT s.start, coalesce(round(sum(total), 4), 0) AS sum FROM (SELECT unnest(generate_series({bin_.format('min(ts)')}, {bin_.format('max(ts)')}, INTERVAL {minutes} MINUTES)) AS start FROM m) s"
        f" LEFT JOIN m ON {bin_.format('m.ts')} = s.start GROUP BY s.start"
    )


for minutes in (15, 30, 45, 60):
    on_m("agg_resample" if minutes == 45 else f"agg_resample_{minutes}", lambda m, minutes=minutes: series.resample(m, minutes).select("start", F.round("sum", 4).alias("sum")), resample_sql(minutes))


def by_weekday(m: DataFrame) -> DataFrame:
    """Sums of the seven days in their order, days without rows as 0."""
    spark = m.sparkSession
    days = spark.createDataFrame([(i, d) for i, d in enumerate(series.DAYS)], "place int, day string")
    sums = m.groupBy(series.day_name(F.col("ts")).alias("day")).agg(total("total").alias("total"))
    return days.join(sums, "day", "left").select("place", "day", F.coalesce("total", F.lit(0.0)).alias("total"))


DAY_LIST = "[" + ", ".join(f"'{d}'" for d in series.DAYS) + "]"
on_m("agg_by_ordered_cat", by_weekday, f"SELECT (i - 1)::INTEGER AS place, {DAY_LIST}[i] AS day, coalesce(round(sum(total), 4), 0) AS total FROM range(1, 8) t(i) LEFT JOIN m ON isodow(ts) = i GROUP BY i")


def numeric_histogram(m: DataFrame) -> DataFrame:
    """Fifty bins of equal width from the least to the largest value, the last one closed."""
    ends = m.agg(F.min("total").alias("lo"), F.max("total").alias("hi"))
    bin_ = F.least(F.floor((F.col("total") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50)), F.lit(49))
    return m.crossJoin(F.broadcast(ends)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


HIST = "SELECT least(floor((total - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM m, (SELECT min(total) AS lo, max(total) AS hi FROM m) GROUP BY 1"
on_m("agg_histogram", numeric_histogram, HIST)

# --- windows, sorting, sets -----------------------------------------------------------------------------------------


def counter(m: DataFrame) -> DataFrame:
    """Cumulative bytes of each user, as a counter would show them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("user_id", "event_id", "ts", F.sum((F.col("total") * 100).cast("long")).over(w).alias("counter"))


on_m("win_lag_delta", lambda m: series.deltas(counter(m), "user_id", ["ts", "event_id"], "counter").select("event_id", "delta"), "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN trunc(total * 100)::BIGINT END AS delta FROM m")


def chronological(m: DataFrame) -> DataFrame:
    from gridloom.operators import keys

    return keys.sequence(m.select("ts", "event_id"), ["ts", "event_id"], "row_id").select("row_id", "event_id")


on_m("srt_chrono", chronological, "SELECT row_number() OVER (ORDER BY ts, event_id) AS row_id, event_id FROM m")


def head_middle_tail(m: DataFrame) -> DataFrame:
    """Of the users by mean total: the first ten, the middle five and the last five."""
    from gridloom.operators import keys

    rows = m.groupBy("user_id").agg(F.round(F.avg("total"), 6).alias("mean"))
    ranked = keys.sequence(rows, [F.col("mean").desc(), F.col("user_id")], "place").withColumn("place", F.col("place").cast("int"))
    ranked = ranked.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    middle = F.floor(F.col("n") / 2)
    return ranked.where((F.col("place") <= 10) | F.col("place").between(middle - 1, middle + 3) | (F.col("place") > F.col("n") - 5)).select("user_id", "mean", "place")


on_m(
    "srt_head_tail_mid",
    head_middle_tail,
    "SELECT user_id, mean, place::INTEGER AS place FROM (SELECT user_id, mean, row_number() OVER (ORDER BY mean DESC, user_id) AS place, count(*) OVER () AS n FROM (SELECT user_id, round(avg(total), 6) AS mean FROM m GROUP BY user_id))"
    " WHERE place <= 10 OR place BETWEEN n // 2 - 1 AND n // 2 + 3 OR place > n - 5",
)
on_m("set_union_all", lambda m: m.where("download > 0").select("event_id", "total").unionByName(m.where("upload > 0").select("total", "event_id")), "SELECT event_id, total FROM m WHERE download > 0 UNION ALL SELECT event_id, total FROM m WHERE upload > 0")
on_m(
    "set_union_schema",
    lambda m: m.where("download > 0").select("event_id", "download").unionByName(m.where("upload > 0").select("event_id", "upload"), allowMissingColumns=True),
    "SELECT event_id, download, NULL::DOUBLE AS upload FROM m WHERE download > 0 UNION ALL SELECT event_id, NULL, upload FROM m WHERE upload > 0",
)

# --- scalar functions -----------------------------------------------------------------------------------------------


def scalar(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    on_m(name, lambda m: m.select("event_id", *columns()), f"SELECT event_id, {sql} FROM m")


c = F.col
scalar("fn_year_month_quarter_day", lambda: [F.year("ts").alias("y"), F.month("ts").alias("mo"), F.quarter("ts").alias("q"), F.day("ts").alias("d")], "year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, quarter(ts)::INTEGER AS q, day(ts)::INTEGER AS d")
scalar("fn_monthname", lambda: [F.date_format("ts", "MMMM").alias("name")], "monthname(ts) AS name")
scalar("fn_yyyymmdd", lambda: [F.date_format("ts", "yyyyMMdd").cast("int").alias("day_id")], "strftime(ts, '%Y%m%d')::INTEGER AS day_id")
scalar("fn_hour_minute", lambda: [F.hour("ts").alias("h"), F.split_part(F.date_format("ts", "HH:mm"), F.lit(":"), F.lit(2)).cast("int").alias("mi")], "hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi")
scalar("fn_minute_of_week", lambda: [series.minute_of_week(c("ts")).alias("minute")], "((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts))::INTEGER AS minute")
scalar("fn_day_fr", lambda: [series.day_name(c("ts")).alias("day")], f"{DAY_LIST}[isodow(ts)] AS day")
scalar("fn_format_ts", lambda: [F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t"), F.date_format("ts", "'S'yyyyMMdd_HHmmss").alias("s")], "strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, 'S%Y%m%d_%H%M%S') AS s")
scalar("fn_to_datetime", lambda: [F.try_to_timestamp(F.when(c("event_id") % 3 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("parsed")], "CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS parsed")
scalar("fn_cast", lambda: [F.expr("cast(cast(total as decimal(10,2)) as double)").alias("two"), F.expr("try_cast(case when event_id % 2 = 0 then '' else cast(event_id as string) end as int)").alias("i"), F.floor("total").cast("int").alias("whole")], "total::DECIMAL(10,2)::DOUBLE AS two, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id END::INTEGER AS i, floor(total)::INTEGER AS whole")
scalar("fn_concat", lambda: [F.concat(c("user_id").cast("string"), F.lit("%")).alias("p"), F.format_number(c("event_id") * 1000, 0).alias("n")], "user_id || '%' AS p, format('{:,}', event_id * 1000) AS n")
scalar("fn_replace", lambda: [F.replace("session_id", F.lit("-"), F.lit("")).alias("r"), F.when(c("status").isin("", " ", "nan", "Déconnecté"), "Sans").otherwise(c("status")).alias("s")], "replace(session_id, '-', '') AS r, CASE WHEN status IN ('', ' ', 'nan', 'Déconnecté') THEN 'Sans' ELSE status END AS s")
scalar("fn_fillna", lambda: [F.coalesce(F.when(c("download") > 5, c("download")), F.lit(0.0)).alias("d"), F.coalesce(F.when(c("status") == "Connecté", c("status")), F.lit("Aucune")).alias("s")], "coalesce(CASE WHEN download > 5 THEN download END, 0) AS d, coalesce(CASE WHEN status = 'Connecté' THEN status END, 'Aucune') AS s")
scalar("fn_mojibake", lambda: [gf.repair_text(F.when(c("event_id") % 3 == 0, F.decode(F.encode("status", "UTF-8"), "ISO-8859-1")).otherwise(F.concat("status", F.lit("€")))).alias("s")], "CASE WHEN event_id % 3 = 0 THEN status ELSE status || '€' END AS s")
scalar("fn_startswith_contains", lambda: [c("session_id").startswith("8-").alias("a"), F.contains(F.lower("status"), F.lit("conn")).alias("b")], "starts_with(session_id, '8-') AS a, contains(lower(status), 'conn') AS b")
scalar(
    "fn_log1p",
    lambda: [F.round(F.log1p("download"), 6).alias("log1p"), F.round(F.exp(-c("total") / 100), 6).alias("exp"), F.round(F.sqrt("total"), 6).alias("sqrt"), F.abs(c("download") - c("upload")).alias("abs"), F.round(F.pow(c("total"), 2), 4).alias("pow"), F.round(F.atan2("upload", "download"), 6).alias("atan2"), F.round(F.sin("total"), 6).alias("sin")],
    "round(ln(1 + download), 6) AS log1p, round(exp(-total / 100), 6) AS exp, round(sqrt(total), 6) AS sqrt, abs(download - upload) AS abs, round(pow(total, 2), 4) AS pow, round(atan2(upload, download), 6) AS atan2, round(sin(total), 6) AS sin",
)
scalar("fn_round_mo", lambda: [F.bround(c("total") * 1000 / 1048576, 4).alias("mo")], "round_even(total * 1000 / 1048576, 4) AS mo")
scalar("fn_clip", lambda: [F.least(F.lit(20.0), F.greatest(F.lit(5.0), c("total"))).alias("clipped")], "least(20.0::DOUBLE, greatest(5.0::DOUBLE, total)) AS clipped")
scalar("fn_bitwise", lambda: [c("user_id").bitwiseAND(c("event_id")).alias("a"), c("user_id").bitwiseOR(c("event_id")).alias("o"), c("user_id").bitwiseXOR(c("event_id")).alias("x"), F.bitwise_not(c("user_id")).bitwiseAND(F.lit(255).cast("long")).alias("n")], "user_id & event_id AS a, user_id | event_id AS o, xor(user_id, event_id) AS x, (~user_id) & 255 AS n")
scalar("fn_argmax", lambda: [(F.array_position(F.array("download", "upload", "total"), F.greatest("download", "upload", "total")) - 1).cast("int").alias("best"), (F.array_position(F.array("download", "upload", "total"), F.least("download", "upload", "total")) - 1).cast("int").alias("worst")], "(list_position([download, upload, total], greatest(download, upload, total)) - 1)::INTEGER AS best, (list_position([download, upload, total], least(download, upload, total)) - 1)::INTEGER AS worst")
scalar("fn_prefix_zeros", lambda: [F.lpad(c("user_id").cast("string"), 5, "0").startswith(F.repeat(F.lit("0"), 3)).alias("zeros")], "starts_with(lpad(user_id::VARCHAR, 5, '0'), repeat('0', 3)) AS zeros")

# --- statistics -----------------------------------------------------------------------------------------------------

VARIABLES = ["download", "upload", "total"]


def correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pearson's r of every pair, in one pass; null for a constant column."""
    m = measurements(spark, d).withColumn("duration", F.lit(1.0))
    return features.correlations(m, [*VARIABLES, "duration"], 6)


PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("NULL::DOUBLE AS r" if "duration" in (a, b) else f"round(corr({a}, {b}), 6) AS r FROM m") for i, a in enumerate([*VARIABLES, "duration"]) for b in [*VARIABLES, "duration"][i + 1 :]
)
query("eda_corr_matrix", PAIRS)(correlations)
on_m("eda_factorize", lambda m: features.factorize(m, "status", "event_id").select("event_id", F.col("code").cast("int").alias("code")), "SELECT event_id, (dense_rank() OVER (ORDER BY first_id) - 1)::INTEGER AS code FROM (SELECT event_id, min(event_id) OVER (PARTITION BY status) AS first_id FROM m)")
on_m(
    "eda_skew_kurt",
    lambda m: m.groupBy("status").agg(F.round(F.skewness("total"), 4).alias("skew"), F.round(F.kurtosis("total"), 4).alias("kurt")),
    "SELECT status, round((avg(z * z * z)) / pow(avg(z * z), 1.5), 4) AS skew, round(avg(z * z * z * z) / pow(avg(z * z), 2) - 3, 4) AS kurt FROM (SELECT status, total - avg(total) OVER (PARTITION BY status) AS z FROM m) GROUP BY status",
)


def boxplot(m: DataFrame) -> DataFrame:
    """Quartiles, whiskers at 1.5 times their distance and the number of values beyond, by status."""
    q = quantiles(m, "total", [0.25, 0.5, 0.75], ["status"]).select("status", *[F.col(f"q{i}").alias(f"q{i + 1}") for i in range(3)])
    rows = m.join(q, "status").withColumn("reach", 1.5 * (c("q3") - c("q1")))
    inside = c("total").between(c("q1") - c("reach"), c("q3") + c("reach"))
    out = rows.groupBy("status", "q1", "q2", "q3").agg(F.min(F.when(inside, c("total"))).alias("low"), F.max(F.when(inside, c("total"))).alias("high"), F.count(F.when(~inside, 1)).alias("outliers"))
    return out.select("status", *[F.round(x, 6).alias(x) for x in ("q1", "q2", "q3", "low", "high")], "outliers")


on_m(
    "eda_boxplot",
    boxplot,
    "SELECT status, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(total) FILTER (total BETWEEN a AND b), 6) AS low, round(max(total) FILTER (total BETWEEN a AND b), 6) AS high, count(*) FILTER (total NOT BETWEEN a AND b) AS outliers"
    " FROM (SELECT m.status, total, q1, q2, q3, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM m JOIN (SELECT status, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS q2, quantile_cont(total, 0.75) AS q3 FROM m GROUP BY status) USING (status)) GROUP BY status, q1, q2, q3",
)
on_m("eda_hist_kde", lambda m: features.density(m, "total", 25, 4.0), "SELECT g AS x, round(sum(exp(-0.5 * pow((g - total) / 4.0, 2))) / (count(*) * 4.0 * sqrt(2 * pi())), 8) AS density FROM m, (SELECT lo + i * (hi - lo) / 24 AS g FROM (SELECT min(total) AS lo, max(total) AS hi FROM m), range(25) t(i)) GROUP BY g")
on_m("eda_identity_line", lambda m: m.agg(F.greatest(F.max("download"), F.max("upload")).alias("reach")), "SELECT greatest(max(download), max(upload)) AS reach FROM m")
LONG = "(SELECT event_id, 'download' AS name, CASE WHEN download > 0 THEN download END AS v FROM m UNION ALL SELECT event_id, 'upload', CASE WHEN upload > 0 THEN upload END FROM m UNION ALL SELECT event_id, 'total', total FROM m)"


def long_form(m: DataFrame) -> DataFrame:
    """(event_id, name, v): zeros of download and upload count as missing."""
    wide = m.select("event_id", *[F.when(c(x) > 0, c(x)).alias(x) if x != "total" else c(x) for x in VARIABLES])
    return wide.unpivot("event_id", VARIABLES, "name", "v")


on_m("eda_null_profile", lambda m: long_form(m).groupBy("name").agg(F.count(F.when(c("v").isNull(), 1)).alias("nulls"), (F.count("v") * 2 < F.count("*")).alias("mostly_null")), f"SELECT name, count(*) - count(v) AS nulls, count(v) * 2 < count(*) AS mostly_null FROM {LONG} GROUP BY name")
on_m("eda_class_balance", lambda m: m.groupBy("status").agg(F.count("*").alias("n")).withColumn("percent", F.round(100 * c("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4)), "SELECT status, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM m GROUP BY status")

# --- features -------------------------------------------------------------------------------------------------------

on_m("fe_transpose", lambda m: long_form(m).groupBy("event_id").pivot("name", VARIABLES).agg(F.first("v")), "SELECT event_id, CASE WHEN download > 0 THEN download END AS download, CASE WHEN upload > 0 THEN upload END AS upload, total FROM m")
on_m("fe_onehot", lambda m: features.one_hot(m.select("event_id", "status"), "status", ["Connecté", "Déconnecté"]), "SELECT event_id, (status = 'Connecté')::INTEGER AS \"status_Connecté\", (status = 'Déconnecté')::INTEGER AS \"status_Déconnecté\" FROM m")
on_m("fe_onehot_drop_first", lambda m: features.one_hot(m.select("event_id", "status"), "status", ["Connecté", "Déconnecté"], drop_first=True), "SELECT event_id, (status = 'Déconnecté')::INTEGER AS \"status_Déconnecté\" FROM m")
on_m("fe_label_encode", lambda m: features.label_encode(m, "session_id").select("event_id", F.col("code").cast("int").alias("code")), "SELECT event_id, (dense_rank() OVER (ORDER BY session_id) - 1)::INTEGER AS code FROM m")
on_m("fe_ordinal", lambda m: m.select("event_id", gf.codes(series.day_name(c("ts")), {d: i for i, d in enumerate(series.DAYS[:5])}).alias("code")), "SELECT event_id, CASE WHEN isodow(ts) <= 5 THEN isodow(ts) - 1 END::INTEGER AS code FROM m")
TRAIN = "event_id % 5 <> 0"
on_m(
    "fe_impute_median",
    lambda m: features.impute_median(long_form(m), "name", "v", TRAIN, 0.5).select("event_id", "name", F.round("v", 6).alias("v")),
    f"SELECT event_id, name, round(coalesce(v, med), 6) AS v FROM {LONG} JOIN (SELECT name, median(v) FILTER ({TRAIN}) AS med FROM {LONG} GROUP BY name HAVING count(v) FILTER ({TRAIN}) >= 0.5 * count(*) FILTER ({TRAIN})) USING (name)",
)
on_m("fe_impute_mode", lambda m: features.impute_mode(m.select("event_id", F.when(c("event_id") % 4 != 0, c("user_id")).alias("u")), "u"), "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id ELSE (SELECT user_id FROM m WHERE event_id % 4 <> 0 GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1) END AS u FROM m")


def kept_columns(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d).withColumn("twice", 2 * c("total")).withColumn("noisy", c("total") + c("download") / 100)
    return features.correlation_filter(m, [*VARIABLES, "twice", "noisy"], 0.8)


query("fe_corr_filter", "SELECT name, NOT coalesce((name = 'twice' AND abs(corr(total, 2 * total)) > 0.8) OR (name = 'noisy' AND abs(corr(total, total + download / 100)) > 0.8), false) AS kept FROM m, (SELECT unnest(['download', 'upload', 'total', 'twice', 'noisy']) AS name) GROUP BY name")(kept_columns)
on_m("fe_standardize", lambda m: features.standardize(m, ["download", "total"], TRAIN).select("event_id", F.round("download", 6).alias("download"), F.round("total", 6).alias("total")), f"SELECT event_id, round((download - a) / s, 6) AS download, round((total - b) / t, 6) AS total FROM m, (SELECT avg(download) AS a, stddev_pop(download) AS s, avg(total) AS b, stddev_pop(total) AS t FROM m WHERE {TRAIN})")
on_m("fe_winsorize", lambda m: features.winsorize(m, "total", TRAIN).select("event_id", F.round("total", 6).alias("total")), f"SELECT event_id, round(least(total, hi), 6) AS total FROM m, (SELECT quantile_cont(total, 0.75) + 1.5 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) AS hi FROM m WHERE {TRAIN})")
on_m("fe_poly_interact", lambda m: features.interactions(m.select("event_id", *VARIABLES), VARIABLES), "SELECT event_id, download, upload, total, download * upload AS download_x_upload, download * total AS download_x_total, upload * total AS upload_x_total FROM m")
scalar("fe_throughput", lambda: [F.round((c("download") + c("upload")) / 1.1, 6).alias("rate")], "round((download + upload) / 1.1, 6) AS rate")
scalar("fe_log", lambda: [F.round(F.log1p("download"), 6).alias("d"), F.round(F.log1p("upload"), 6).alias("u")], "round(ln(1 + download), 6) AS d, round(ln(1 + upload), 6) AS u")
scalar("fe_ratio", lambda: [F.round(F.log1p(c("upload") / (c("download") + 1e-9)), 6).alias("ratio")], "round(ln(1 + upload / (download + 1e-9)), 6) AS ratio")
scalar("fe_is_disconnected", lambda: [(c("status") == "Déconnecté").cast("int").alias("down"), (F.weekday("ts") >= 5).cast("int").alias("weekend")], "(status = 'Déconnecté')::INTEGER AS down, (isodow(ts) >= 6)::INTEGER AS weekend")
QUERIES["fe_weekend"], ORACLES["fe_weekend"] = QUERIES["fe_is_disconnected"], ORACLES["fe_is_disconnected"]
scalar("fe_yeojohnson", lambda: [F.round(features.yeo_johnson(c("total") - 10, 0.5), 6).alias("t")], "round(CASE WHEN total - 10 >= 0 THEN (pow(total - 10 + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - (total - 10), 1.5) - 1) / 1.5 END, 6) AS t")
on_m("fe_yeojohnson_fit", lambda m: features.yeo_johnson_fit(m.select("event_id", "total"), "total", TRAIN))
on_m("fe_split", lambda m: m.select("event_id", (c("event_id") % 5 == 0).alias("test")), "SELECT event_id, event_id % 5 = 0 AS test FROM m")
on_m("fe_split_stratified", lambda m: features.stratified_split(m, "status", "event_id", 0.8).groupBy("status", "train").agg(F.count("*").alias("n")), "SELECT status, k <= ceil(0.8 * n) AS train, count(*) AS n FROM (SELECT status, row_number() OVER (PARTITION BY status) AS k, count(*) OVER (PARTITION BY status) AS n FROM m) GROUP BY ALL")
on_m("fe_align", lambda m: features.align(m.select("event_id", "upload", "status"), ["event_id", "download", "upload"]), "SELECT event_id, NULL::DOUBLE AS download, upload FROM m")

# --- the same functions under the other names of their families -----------------------------------------------------

for name in ("exp", "sqrt", "abs", "pow", "atan2", "sin"):
    QUERIES[f"fn_{name}"], ORACLES[f"fn_{name}"] = QUERIES["fn_log1p"], ORACLES["fn_log1p"]
QUERIES["udf_apply"], ORACLES["udf_apply"] = QUERIES["cse_period7"], ORACLES["cse_period7"]
