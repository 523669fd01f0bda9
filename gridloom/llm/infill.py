"""Operator 12: fill-in-middle transformation of documents, cut between units found by one match with repeated captures."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit, and the whole text as a repeated capture of it.
UNIT = "[A-Za-z]+|[^A-Za-z]"
UNITS = f"({UNIT})*"
#: Code points of one match, more only where a unit is longer: the library keeps some hundred bytes for each repetition and
#: gives up at a few million of them.
STRETCH = 1 << 18
#: The sentinels, the share of documents in a hundred that are cut, and of these in the order SPM.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_OF_100, SPM_OF_100 = 90, 20


def draws(doc_id: int | None) -> list[int]:
    """The four numbers that decide on a document; a null id counts as an empty one."""
    digest = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


class Units:
    """The ends of all units of a text: one match, whose capture keeps every repetition. Very long texts are matched in
    stretches that end where a unit does, which finds the same units."""

    def __init__(self, stretch: int = STRETCH):
        import regex

        self.match, self.after, self.stretch = regex.compile(UNITS).fullmatch, regex.compile("[^A-Za-z]").search, stretch

    def __call__(self, text: str) -> Sequence[int]:
        if len(text) <= self.stretch:
            return self.match(text).ends(1)
        ends, at = array("q"), 0
        while at < len(text):
            # the character at the cut is no letter, so that no run of letters goes on behind it
            cut = m.start() if (m := self.after(text, min(at + self.stretch, len(text)))) else len(text)
            ends.extend(self.match(text, at, cut).ends(1))
            at = cut
        return ends


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    One fullmatch of the repeated unit keeps the ends of all units, so their number and both cuts are read off it. The
    form is plain (the text as it is; no lengths), psm or spm. Lengths are code points. Null texts are empty and plain;
    rows that repeat an id are cut by the same draws, each by its own number of units. An empty table gives an empty
    result. A row needs nothing of any other, so the operator has no shuffle and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(stretch)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ends = units(text)
                n, (h1, h2, h3, h4) = len(ends), draws(doc)
                if not text or h3 % 100 >= CUT_OF_100 or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((doc, n, "plain", None, None, text))
                    continue
                a, b = (ends[u - 1] if u else 0 for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                spm = h4 % 100 < SPM_OF_100
                output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
                rows.append((doc, n, "spm" if spm else "psm", a, b - a, output))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output. A text that is cut holds no sentinel, and none can arise where a part meets one, so
    the parts are what lies between the sentinels."""
    parts = F.split(F.substring(output, 4, 2**31 - 1), "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[0], parts[2], parts[1])).otherwise(F.concat(parts[1], parts[2], parts[0]))
