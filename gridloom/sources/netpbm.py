"""Binary PGM (P5) and PPM (P6) rasters of eight bits."""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

COLOUR = "path string, kind string, w int, h int, max_val int, r array<smallint>, g array<smallint>, b array<smallint>"
GREY = "path string, kind string, w int, h int, max_val int, v array<smallint>"
_HEADER = re.compile(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def detect(content: bytes) -> str | None:
    """'pgm', 'ppm' or None, by the first two bytes."""
    return {b"P5": "pgm", b"P6": "ppm"}.get(bytes(content[:2]))


def decode(content: bytes) -> tuple[str, int, int, int, np.ndarray]:
    """(kind, w, h, max_val, planes): one plane of a PGM, three of a PPM; a short or malformed file is a ValueError."""
    head = _HEADER.match(content)
    if not head:
        raise ValueError("no binary PGM or PPM header")
    kind, (w, h, most) = detect(content), (int(x) for x in head.groups()[1:])
    planes = 1 if kind == "pgm" else 3
    size = w * h * planes
    body = content[head.end() : head.end() + size]
    if len(body) < size or not 0 < most < 256:
        raise ValueError("too few bytes, or more than eight bits")
    return kind, w, h, most, np.frombuffer(body, np.uint8).reshape(h * w, planes).T


def encode(w: int, h: int, planes: list, most: int = 255) -> bytes:
    levels = np.stack([np.asarray(p, np.uint8) for p in planes], axis=1)
    return f"P{5 if len(planes) == 1 else 6}\n{w} {h}\n{most}\n".encode() + levels.tobytes()


def grey_plane(planes: np.ndarray) -> np.ndarray:
    """One plane as it is; of three, 0.299 R + 0.587 G + 0.114 B, rounded."""
    if len(planes) == 1:
        return planes[0]
    return np.clip(np.trunc(0.299 * planes[0] + 0.587 * planes[1] + 0.114 * planes[2] + 0.5), 0, 255)


def row(path: str, content: bytes, mode: str) -> dict:
    kind, w, h, most, planes = decode(content)
    base = {"path": path, "kind": kind, "w": w, "h": h, "max_val": most}
    if mode == "grey":
        return base | {"v": grey_plane(planes).astype(np.int16).tolist()}
    r, g, b = planes if len(planes) == 3 else planes[[0, 0, 0]]
    return base | {"r": r.astype(np.int16).tolist(), "g": g.astype(np.int16).tolist(), "b": b.astype(np.int16).tolist()}


def images(files: DataFrame, mode: str = "grey") -> DataFrame:
    """Images from (path, content); mode 'colour' gives three planes, equal ones for PGM. Files of another kind are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row(p, bytes(c), mode) for p, c in zip(batch["path"], batch["content"]) if detect(bytes(c))]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(read, GREY if mode == "grey" else COLOUR)


#: Files of a folder that one task reads, about, and the most tasks of a folder, for each lists all of it.
FILES, LISTINGS = 256, 64


def _is_picture(entry: os.DirEntry) -> bool:
    return entry.name.lower().endswith((".pgm", ".ppm")) and entry.is_file()


class _Files(DataSourceReader):
    """A task is (folder, number, of how many): it lists the folder itself and takes the files whose names hash to its
    number, so the driver counts files but holds no names."""

    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", "grey")

    def partitions(self):
        found, waiting = [], [self.path]
        while waiting:
            folder, n = waiting.pop(), 0
            with os.scandir(folder) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        if not entry.name.startswith("_"):
                            waiting.append(entry.path)
                    else:
                        n += _is_picture(entry)
            tasks = min(-(-n // FILES), LISTINGS)
            found += [InputPartition((folder, i, tasks)) for i in range(tasks)]
        return found

    def read(self, partition):
        folder, number, tasks = partition.value
        with os.scandir(folder) as entries:
            for entry in entries:
                if zlib.crc32(os.fsencode(entry.name)) % tasks == number and _is_picture(entry):
                    with open(entry.path, "rb") as f:
                        found = row(entry.path, f.read(), self.mode)
                    yield tuple(found.values())


@dataclass
class _Written(WriterCommitMessage):
    """The folder that a task has filled."""

    folder: str


class _Sink(DataSourceWriter):
    """Files <name>.pgm or <name>.ppm of rows (name, w, h, v) or (name, w, h, r, g, b); a name may have folders.

    A task writes into a folder of its own below _stage, which readers pass over. Files move to their places once all tasks
    are done, those of lost or doubled attempts never; a write that fails leaves the folder as it was.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = os.path.abspath(options["path"]), overwrite
        self.stage = os.path.join(self.path, f"_stage-{uuid.uuid4().hex}")
        os.makedirs(self.stage)

    def _clear(self):
        """Under another name first, so that a task that still runs finds no folder to write to."""
        os.replace(self.stage, f"{self.stage}-old")
        shutil.rmtree(f"{self.stage}-old", ignore_errors=True)

    def write(self, iterator):
        folder = os.path.join(self.stage, str(TaskContext.get().taskAttemptId()))
        os.mkdir(folder)
        known = {folder}
        for r in iterator:
            planes = [r["v"]] if "v" in r else [r["r"], r["g"], r["b"]]
            final = os.path.normpath(os.path.join(folder, f"{r['name']}.{'pgm' if len(planes) == 1 else 'ppm'}"))
            if not final.startswith(folder + os.sep):
                raise ValueError(f"the name {r['name']!r} leaves the folder")
            inner = os.path.dirname(final)
            missing = []
            while inner not in known:
                missing.append(inner)
                inner = os.path.dirname(inner)
            for new in reversed(missing):
                os.mkdir(new)
                known.add(new)
            with open(final, "wb") as f:
                f.write(encode(r["w"], r["h"], planes))
        return _Written(folder)

    def commit(self, messages):
        if self.overwrite:
            waiting = [self.path]
            while waiting:
                folder = waiting.pop()
                with os.scandir(folder) as entries:
                    for entry in entries:
                        if entry.is_dir(follow_symlinks=False):
                            if not entry.name.startswith("_"):
                                waiting.append(entry.path)
                        elif _is_picture(entry):
                            os.remove(entry.path)
        for message in messages:
            for folder, _, files in os.walk(message.folder):
                place = os.path.join(self.path, os.path.relpath(folder, message.folder))
                os.makedirs(place, exist_ok=True)
                for f in files:
                    os.replace(os.path.join(folder, f), os.path.join(place, f))
        self._clear()

    def abort(self, messages):
        del messages
        self._clear()


class Netpbm(DataSource):
    """format("netpbm"): a folder of .pgm and .ppm files. It opens paths itself, so the folder must be mounted on the
    driver and all executors; elsewhere read with binaryFile and images()."""

    @classmethod
    def name(cls) -> str:
        return "netpbm"

    def schema(self) -> str:
        return GREY if self.options.get("mode", "grey") == "grey" else COLOUR

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Files(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Sink(self.options, overwrite)
