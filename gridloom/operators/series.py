"""Measurements over time: the measurement view, day parts, resampling and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the days and of the day parts (first hour, label), as the measurement files have them.
DAYS = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
PARTS_7 = [(21, "Nuit"), (18, "Soir"), (14, "Après-midi"), (12, "Midi"), (9, "Matinée"), (5, "Matin")]
PARTS_4 = [(18, "Soir"), (12, "Après-midi"), (6, "Matin")]


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, status, download, upload, total, session_id) from the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    down = F.col("event_type").isin("view", "click", "error")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.when(F.col("event_type") == "error", "Déconnecté").otherwise("Connecté").alias("status"),
        F.when(down, F.col("value")).otherwise(0.0).alias("download"),
        F.when(down, 0.0).otherwise(F.col("value")).alias("upload"),
        F.col("value").alias("total"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
    )


def day_part(hour: Column, parts: list[tuple[int, str]], rest: str) -> Column:
    """The label of the last part that has begun; before the first one, the rest."""
    out = None
    for start, label in parts:
        out = F.when(hour >= start, label) if out is None else out.when(hour >= start, label)
    return out.otherwise(rest)


def day_name(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.weekday(ts) + 1)


def minute_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 1440 + F.hour(ts) * 60 + F.minute(ts)


def resample(df: DataFrame, minutes: int, ts: str = "ts", value: str = "total") -> DataFrame:
    """(start, sum) of every bin of so many minutes from the first to the last, empty ones with 0; bins start at midnight."""
    width = f"{minutes} minutes"
    sums = df.groupBy(F.window(ts, width).start.alias("start")).agg(F.sum(value).alias("sum"))
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    floor = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(c) / (60 * minutes)) * 60 * minutes)
    spine = ends.select(F.explode(F.sequence(floor(F.col("a")), floor(F.col("b")), F.expr(f"INTERVAL {minutes} MINUTES"))).alias("start"))
    return spine.join(sums, "start", "left").select("start", F.coalesce("sum", F.lit(0.0)).alias("sum"))


def deltas(df: DataFrame, key: str, ts: list[str], counter: str) -> DataFrame:
    """Difference of a cumulative counter to the key's previous sample; the first and those after a reset are null."""
    step = F.col(counter) - F.lag(counter).over(Window.partitionBy(key).orderBy(*ts))
    return df.withColumn("delta", F.when(step >= 0, step))
