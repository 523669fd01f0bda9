"""Delimited files of uneven shape: missing headers, preambles, archives."""

from __future__ import annotations

import csv
import io
import itertools
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a measurement file, in their order.
MEASUREMENT = ["date", "heure", "jour_semaine", "periode_journee", "statut_connexion", "duree_minutes", "download_Mo", "upload_Mo", "total_Mo", "session_id"]


def contract(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """Files with a header under a declared schema; fields that do not parse are null."""
    return spark.read.schema(schema).options(header="true", mode="PERMISSIVE", **options).csv(path)


def binary(spark: SparkSession, path: str, pattern: str = "*", exclude: str | None = None) -> DataFrame:
    """(path, content) of the files whose name fits the pattern and does not hold the excluded text, in either case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    if exclude:
        name = F.lower(F.element_at(F.split("path", "/"), -1))
        files = files.where(~F.contains(name, F.lit(exclude.lower())))
    return files


def sniffed(files: DataFrame, columns: list[str], first_value: str = "202") -> DataFrame:
    """Rows of files with just these columns as text, and their path: a first line that begins like a value is data and
    no header. Files of another width are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = list(csv.reader(io.StringIO(bytes(content).decode("utf-8", "replace"))))
                if not rows or len(rows[0]) != len(columns):
                    continue
                rows = rows if rows[0][0].startswith(first_value) else rows[1:]
                kept = [[x or None for x in r] for r in rows if len(r) == len(columns)]
                if kept:
                    yield pd.DataFrame(kept, columns=columns).assign(path=path)

    return files.select("path", "content").mapInPandas(read, ", ".join(f"`{c}` string" for c in [*columns, "path"]))


#: Rows of quoted files that leave a task at a time.
ROWS = 4096


def sniffed_files(spark: SparkSession, path: str, columns: list[str], pattern: str = "*", exclude: str | None = None, first_value: str = "202") -> DataFrame:
    """What sniffed gives of the files of a folder, whatever their size: they are read by lines and in parts.

    A first pass learns of each file how wide its first line is and whether it holds quotes or lone carriage returns. Files
    without are split at commas by Spark; of the others, whose rows can span lines, each is one task's, which keeps a line at
    a time. A file that ends inside quotes has a line break there.
    """
    text = F.expr("make_valid_utf8(if(endswith(value, '\\r'), left(value, length(value) - 1), value))")
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("at"), "value", text.alias("text"))
    if exclude:
        rows = rows.where(~F.contains(F.lower("name"), F.lit(exclude.lower())))
    width = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit(","))) + 1)
    # place and width of the first line as one number, so that files are summed up without sorting
    first = F.min(F.when(F.col("start") == 0, F.col("at").cast("decimal(20,0)") * 10_000 + F.least(width, F.lit(9_999))))
    files = rows.groupBy("path").agg((first % 10_000).cast("int").alias("width"), F.max(F.contains("text", F.lit('"')) | F.contains("text", F.lit("\r"))).alias("quoted"))
    files = files.where(F.col("quoted") | (F.col("width") == len(columns))).select(F.col("path").alias("_path"), "quoted")  # a row a file
    known = rows.join(F.broadcast(files), F.col("path") == F.col("_path"))

    def headless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, start, line = (batch.column(i) for i in range(3))
            keys = list(zip(file.to_pylist(), start.to_pylist())) if len(pc.unique(file)) + len(pc.unique(start)) > 2 else [(file[0].as_py(), start[0].as_py())]
            heads = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else last) and k[1] == 0]
            last = keys[-1]
            drop = [i for i in heads if not line[i].as_py().startswith(first_value)]
            if drop:
                keep = np.ones(batch.num_rows, bool)
                keep[drop] = False
                batch = batch.filter(pa.array(keep))
            yield batch.select([2, 3])

    plain = known.where(~F.col("quoted")).select(F.xxhash64("path").alias("file"), "start", "text", "path").mapInArrow(headless, "text string, path string")
    cells = F.split("text", ",", -1)
    plain = plain.select(cells.alias("r"), "path").where(F.size("r") == len(columns))
    plain = plain.select(*[F.nullif(F.col("r")[i], F.lit("")).alias(c) for i, c in enumerate(columns)], "path")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((p.as_py(), v.as_py().decode("utf-8", "replace") + "\n") for batch in batches for p, v in zip(*batch.columns))
        for file, own in itertools.groupby(lines, lambda x: x[0]):
            found = csv.reader(line for _, line in own)
            head = next(found, None)
            if head is None or len(head) != len(columns):
                continue
            data = itertools.chain([head] if head[0].startswith(first_value) else [], found)
            kept = ([x or None for x in r] + [file] for r in data if len(r) == len(columns))
            while some := list(itertools.islice(kept, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], [*columns, "path"])

    quoted = known.where("quoted").select("path", F.col("value").cast("binary").alias("line"), "start", "at").repartition("path").sortWithinPartitions("path", "start", "at")
    quoted = quoted.select("path", "line").mapInArrow(parsed, ", ".join(f"`{c}` string" for c in [*columns, "path"]))
    return plain.union(quoted)


def after_preamble(files: DataFrame, columns: list[str], skip: int = 4) -> DataFrame:
    """The named columns of files that have so many lines before their header, as text, and their path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                lines = bytes(content).decode("utf-8", "replace").splitlines()[skip:]
                rows = list(csv.DictReader(lines))
                yield pd.DataFrame([[r.get(c) or None for c in columns] for r in rows], columns=columns).assign(path=path)

    return files.select("path", "content").mapInPandas(read, ", ".join(f"`{c}` string" for c in [*columns, "path"]))


def archived(files: DataFrame) -> DataFrame:
    """(path, content) of the members of .zip, .tar.gz and .tgz files, path being archive!member; broken ones are skipped."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = []
                try:
                    if path.lower().endswith(".zip"):
                        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                            found = [(f"{path}!{n}", z.read(n)) for n in z.namelist() if not n.endswith("/")]
                    elif path.lower().endswith((".tar.gz", ".tgz")):
                        with tarfile.open(fileobj=io.BytesIO(bytes(content)), mode="r:gz") as t:
                            found = [(f"{path}!{m.name}", t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                except (zipfile.BadZipFile, tarfile.TarError, OSError):
                    continue
                yield pd.DataFrame(found, columns=["path", "content"])

    return files.select("path", "content").mapInPandas(read, "path string, content binary")


def cleaned(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """Rows without missing values whose numbers parse and are not negative."""
    out = rows.na.drop()
    for c in numbers:
        out = out.withColumn(c, F.expr(f"try_cast(`{c}` as double)")).where(F.col(c) >= 0)
    return out
