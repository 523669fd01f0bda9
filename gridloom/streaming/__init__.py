"""Structured Streaming forms of the measurement operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators import series

SCHEMA = "event_id long, ts timestamp, user_id long, status string, download double, upload double, total double, session_id string"


def replay(spark: SparkSession, path: str, files: int | None = 1) -> DataFrame:
    """A stream of the files of a folder, so many in a batch, or all that are new."""
    stream = spark.readStream.schema(SCHEMA)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


def enrich(rows: DataFrame, *also: str) -> DataFrame:
    """Date parts, day part and total of each measurement, and other columns of it; the same for streams and tables."""
    hour = F.hour("ts")
    return rows.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm:ss").alias("time"), series.day_name(F.col("ts")).alias("weekday"), series.day_part(hour, series.PARTS_7, "Aube").alias("part"),
        "status", F.round(F.col("download") + F.col("upload"), 4).alias("total"), "session_id", *also,
    )


def tumbling(rows: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """(start, sum) of windows of so many minutes. Streamed in append mode, a window is given once, when the watermark has
    passed its end, and its state is dropped then; rows of a window that is final are left out."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.sum("total").alias("sum")).select(F.col("w.start").alias("start"), F.round("sum", 4).alias("sum"))


def session_summary(rows: DataFrame, span: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and sums of each session id and span. An id that holds its day has one span; final once the span has passed."""
    found = rows.withWatermark("ts", late).groupBy("session_id", F.window("ts", span).alias("w"))
    return found.agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in ("download", "upload", "total")]).drop("w")


def sessions(rows: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, total): runs of a user's rows of which each comes within the gap after the one before; end
    is the last row's time and the gap. Sessions that a late row joins are merged while their state is there."""
    found = rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return found.agg(F.count("*").alias("n"), F.round(F.sum("total"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def delta(rows: DataFrame) -> DataFrame:
    """(user_id, event_id, delta) of a cumulative counter (user_id, event_id, ts, counter): the state of a user is its
    last sample. The first sample and one after a reset have a null delta; samples of a batch go in the order of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        found = []
        for now in pdf["counter"]:
            found.append(int(now) - last if last is not None and now >= last else None)
            last = int(now)
        state.update((last,))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "delta": pd.array(found, "Int64")})

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, delta long", "counter long", "append", GroupStateTimeout.NoTimeout)


def drain(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Append what the stream has now to Parquet files, each row once however often this is restarted."""
    rows.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_csv(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Append what the stream has now to CSV files without headers, each row once however often this is restarted. The
    columns stand once, in 0-header.csv, written if it is missing: the files in the order of their names, one after another,
    are one table. Readers that know Spark's log of a stream's files read rows only."""
    spark = rows.sparkSession
    header = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/0-header.csv")
    files = header.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(header):
        out = files.create(header)
        out.write(bytearray((",".join(rows.columns) + "\n").encode()))
        out.close()
    rows.writeStream.format("csv").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Counters(SimpleDataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"sample": 0}

    def read(self, start: dict):
        import time

        received = sent = 0
        with open("/proc/net/dev") as lines:
            for line in list(lines)[2:]:
                numbers = line.split(":", 1)[1].split()
                received, sent = received + int(numbers[0]), sent + int(numbers[8])
        return iter([(int(time.time()), received, sent)]), {"sample": start["sample"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([])


class Counters(DataSource):
    """format("net_counters"): a sample (seconds, bytes received, bytes sent) of the driver's interfaces per trigger."""

    @classmethod
    def name(cls) -> str:
        return "net_counters"

    def schema(self) -> str:
        return "second long, received long, sent long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Counters()
