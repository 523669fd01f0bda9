"""Liveness of network addresses, by connecting to them."""

from __future__ import annotations

import socket
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reachable(host: str | None, port: int | None, timeout: float) -> bool:
    """Whether a TCP connection opens within the timeout, in seconds; refused, unknown, silent and null ones do not."""
    if host is None or port is None or not 0 < port < 65536:
        return False
    try:
        with socket.create_connection((host, port), timeout):
            return True
    except OSError:
        return False


def probe(df: DataFrame, host: str = "host", port: str = "port", timeout: float = 2.0, tasks: int = 32) -> DataFrame:
    """df with the column connected. Each distinct address is tried once, whatever number of rows bears it; addresses are
    dealt to tasks, each of which waits for one at a time. A null host or port is not connected. A task that is tried
    again asks again, so the answer is of some moment while the query ran."""
    pairs = df.select(F.col(host).cast("string").alias("_host"), F.col(port).cast("int").alias("_port")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [reachable(h.as_py(), p.as_py(), timeout) for h, p in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.bool_())], ["_host", "_port", "connected"])

    found = pairs.repartition(tasks, "_host", "_port").mapInArrow(run, "_host string, _port int, connected boolean")
    same = df[host].cast("string").eqNullSafe(found["_host"]) & df[port].cast("int").eqNullSafe(found["_port"])
    return df.join(found, same).drop("_host", "_port")
