"""Loads into tables: keys that go on from the last load, staged loads with checks and one switch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import keys

#: A check gives the rows of a stage that break it.
Check = Callable[[DataFrame], DataFrame]


class Rejected(Exception):
    """A load whose stage breaks a check; the table is as it was."""


def unique(*columns: str) -> Check:
    return lambda stage: keys.duplicates(stage, list(columns))


def refers(column: str, parent: DataFrame, parent_column: str) -> Check:
    return lambda stage: keys.orphans(stage, parent, column, parent_column)


def not_null(column: str) -> Check:
    return lambda stage: stage.where(F.col(column).isNull())


class Store:
    """A catalog table whose rows change as a whole: a load is written beside the old rows and checked there, then the
    table's location is switched to it. A load that fails or is rejected leaves no trace; readers see old or new rows."""

    def __init__(self, spark: SparkSession, table: str, schema: str, folder: str):
        self.spark, self.table, self.folder = spark, table, folder.rstrip("/")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet LOCATION '{self._place()}'")

    def _place(self) -> str:
        return f"{self.folder}/{uuid.uuid4().hex}"

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def replace(self, rows: DataFrame, *checks: Check) -> None:
        """The rows instead of the old ones, if they meet all checks."""
        path, schema = self._place(), self.rows().schema
        try:
            rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
            stage = self.spark.read.schema(schema).parquet(path)
            for n, check in enumerate(checks):
                if bad := check(stage).take(1):
                    raise Rejected(f"check {n + 1}: {bad[0]}")
        except BaseException:
            self._delete(path)
            raise
        self.spark.sql(f"ALTER TABLE {self.table} SET LOCATION '{path}'")
        self.spark.catalog.refreshTable(self.table)

    def append(self, rows: DataFrame, key: list[str], *checks: Check) -> None:
        """Old rows and those of the new ones whose key is not there yet, so that a load that is run again doubles nothing.
        Null keys are keys; of new rows that share one, the checks decide."""
        old = self.rows()
        names = [f"_k{i}" for i in range(len(key))]
        held = old.select(*[F.col(k).alias(n) for k, n in zip(key, names)])
        on: list[Column] = [rows[k].eqNullSafe(held[n]) for k, n in zip(key, names)]
        self.replace(old.unionByName(rows.select(*old.columns).join(held, on, "left_anti")), *checks)


def extended(known: DataFrame, labels: DataFrame, column: str, key: str) -> DataFrame:
    """The key map known (key, column) with the labels that it lacks, numbered after its largest key in their order, null
    first. Old labels keep their keys, so loading a batch again changes nothing; labels repeat freely, and null is one."""
    new = labels.select(column).distinct()
    held = known.select(F.col(column).alias("_held"))
    new = new.join(held, F.col(column).eqNullSafe(F.col("_held")), "left_anti")
    last = known.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = keys.sequence(new, [F.col(column).asc_nulls_first()], key, after=last)
    return known.select(key, column).unionByName(numbered.select(F.col(key).cast(known.schema[key].dataType).alias(key), column))
