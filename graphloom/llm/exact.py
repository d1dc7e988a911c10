"""Exact de-duplication by content hash, with bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 text."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_with: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Groups are keyed by the hash and the text, so the aggregation compares the bytes of rows that share a hash, and rows
    that collide part.  Its map side leaves one row per group and task, so a group of any size is never in one task.  The
    decisions return to the rows by the hash and the SHA-256 that the result needs anyway, in a join whose hot partitions
    adaptive execution splits.

    ``keep``: the id that stays is the ``smallest`` or the ``largest`` of its group.  Null texts count as empty.  A null id
    stays only in a group without another id.  Rows that repeat an id with the same text all share its decision: they are
    one document.  Other columns are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_hash", hash_with(F.col("_text")))
    groups = (
        rows.groupBy("_hash", "_text")
        .agg(F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id"))
        .select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "group_size", "keep_id")
    )
    narrow = rows.select("_id", "_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"))
    return narrow.join(groups, ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def last_of_equal(docs: DataFrame, order: list[str], text_col: str = "text", hash_with: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Of each group of equal texts the row that is last by the columns ``order``, with these columns and its text.

    For callers that need the rows that stay and no decision on the others: groups are keyed as in ``exact_dedup``, and the
    columns of the best row so far go with its group, so a text is shuffled once and meets no table of decisions afterwards.
    The map side leaves one row per group and task here too.

    Nulls come first in every column.  Null texts count as empty; of rows that tie in the first of ``order``, one with an empty
    text is after one with none.  Rows that tie in everything are interchangeable.  Other columns are not read.
    """
    rows = docs.select(F.struct(order[0], F.col(text_col).isNotNull().alias("_said"), *order[1:]).alias("_row"), text_or_empty(text_col).alias("_text"))
    groups = rows.groupBy(hash_with(F.col("_text")).alias("_hash"), "_text").agg(F.max("_row").alias("_row"))
    text = F.when(F.col("_row._said"), F.col("_text")).alias(text_col)
    return groups.select(*[text if c == text_col else F.col(f"_row.{c}").alias(c) for c in docs.columns if c == text_col or c in order])
