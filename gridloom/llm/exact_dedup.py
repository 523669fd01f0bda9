"""Operator 4 [native]: exact duplicates by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import BLANKS, spool


def _whole(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")


_ID_SPAN, _OVER_IDS = 1 << 65, 1 << 63


def normalised(text: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _rank(id_col: str, text_col: str) -> Column:
    """Code points * 2^65 + (2^63 - id), the latter 0 where the id is null: the row of the largest number stays."""
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("decimal(10,0)") * _whole(_ID_SPAN)
    return (size + F.coalesce(_whole(_OVER_IDS) - F.col(id_col).cast("long").cast("decimal(20,0)"), _whole(0))).cast("decimal(38,0)")


def _keys(norm: Column) -> list[Column]:
    return [F.unhex(F.md5(norm)).alias("_h128"), F.unhex(F.sha2(norm, 256)).alias("_sha")]


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_h128, _sha, keep_id, group_size, _best): a row for each different normalised text.

    Rows group by the MD5 of the normalised text and by its bytes, so texts that merely share the hash stay apart; the
    grouping combines copies before the shuffle, so a group of any size sends one row from each task. The rank is one
    decimal number, whose maximum a hash aggregate can keep in place.
    """
    rows = docs.select(normalised(text_col).alias("norm"), _rank(id_col, text_col).alias("rank"))
    found = rows.withColumn("h128", F.unhex(F.md5("norm"))).groupBy("h128", "norm").agg(F.max("rank").alias("rank"), F.count("*").alias("group_size"))
    low = F.pmod("rank", _whole(_ID_SPAN))
    return found.select(F.col("h128").alias("_h128"), F.unhex(F.sha2("norm", 256)).alias("_sha"), F.when(low > 0, (_whole(_OVER_IDS) - low).cast("long")).alias("keep_id"), "group_size", F.col("rank").alias("_best"))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _h128, _sha, _rank, _node) of every row; _node is a hash of id and text, which copies of other ids do not share."""
    node = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("id"), *_keys(normalised(text_col)), _rank(id_col, text_col).alias("_rank"), node.alias("_node"))


def _verdicts(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_h128, _sha, keep_id, group_size, _keep) of each group, _keep being the hash of the row that stays: of the rows of
    the largest rank, which differ in white space only, the one of the least hash."""
    known, _ = spool(groups(docs, id_col, text_col), "groups")  # read twice
    ties = rows.join(known, [rows["_h128"] == known["_h128"], rows["_sha"] == known["_sha"], rows["_rank"] == known["_best"]], "left_semi")
    return known.join(ties.groupBy("_h128", "_sha").agg(F.min("_node").alias("_keep")), ["_h128", "_sha"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, sha256) of every row, dropped ones too.

    Of equal texts the row with the most code points stays, then the one with the smallest id, null ids last, then the
    one with the least hash of id and text; of rows that repeat an id and a text one stays, so each group keeps exactly
    one row. What is joined is narrow: no text moves but those that the grouping compares. An empty table gives an empty
    result.
    """
    rows, _ = spool(_narrow(docs, id_col, text_col), "rows")
    judged = rows.join(_verdicts(docs, rows, id_col, text_col), ["_h128", "_sha"])
    first = F.row_number().over(Window.partitionBy("_node", "_h128").orderBy("_sha")) == 1
    return judged.select("id", "keep_id", "group_size", ((F.col("_node") == F.col("_keep")) & first).alias("kept"), F.lower(F.hex("_sha")).alias("sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the row that exact_duplicates keeps. Whole rows are dealt by the hash of id and
    text, so copies of one text do not meet in a task, only rows that repeat both."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns of any name pass through under plain ones
    rows = docs.toDF(*names)
    id_col, text_col = (names[docs.columns.index(c)] for c in (id_col, text_col))
    kept = _verdicts(rows, _narrow(rows, id_col, text_col), id_col, text_col).select(F.col("_keep").alias("_node"), "_sha")
    node = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).alias("_node")
    found = rows.select("*", node, F.unhex(F.sha2(normalised(text_col), 256)).alias("_sha")).join(kept.hint("merge"), ["_node", "_sha"], "left_semi")
    return found.dropDuplicates(["_node", "_sha"]).select(*names).toDF(*docs.columns)
