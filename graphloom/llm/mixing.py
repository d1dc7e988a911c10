"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s should be taken t / s times.  The whole part is certain; the fraction is
rounded so that a source's words hardly change: a document trades words with another one, or with several smaller ones at once,
at random but with the right mean, until one side has a whole number of copies, and the other goes on.  Buckets of a source do this apart
and leave at most one document open; these meet in buckets of the next level, as a tree, until a source has one left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, text_or_empty, written

# Weights of the sources in their order, repeating; the share of all words to take; the most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2

#: A fraction that is nearer than this to a whole number is one, but for rounding.
WHOLE = 1e-9

_NAMES = ("id", "source", "size", "source_size", "target", "bucket", "open", "draw", "copies", "final")
_SCHEMA = "id long, source string, size long, source_size long, target double, bucket long, open double, draw double, copies int, final double"
_ARROW = pa.schema([("id", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("bucket", pa.int64()), ("open", pa.float64()), ("draw", pa.float64()), ("copies", pa.int32()), ("final", pa.float64())])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, n, source_size, target.

    Sources in order of code points, null last, have the given weights in turn.  A target is the smaller of ``most`` times
    the source's size and its weight times a level at which the targets add up to ``share`` of all sizes; that is what
    sharing the excess again and again comes to.  The windows run over one narrow row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn("_cap", most * F.col("source_size"))
    whole = Window.partitionBy(F.lit(0))
    ordered = whole.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    per = per.withColumn("_all", share * F.sum("source_size").over(whole))
    before = F.sum("_cap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap")
    rest = F.sum("_w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (F.col("_all") - before) / rest).withColumn("_at", F.row_number().over(ordered))
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_at", "_level"))).over(whole)["_level"]
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return per.select("source", "n", "source_size", target.alias("target"))


def trade(p: float, size: int, q: float, other: int, draw: float) -> tuple[float, float]:
    """Two fractions after one trade of words; at least one of them is 0 or 1, and p * size + q * other stays."""
    up = min((1 - p) * size, q * other)
    down = min(p * size, (1 - q) * other)
    if draw * (up + down) < down:
        return (1.0, q - up / other) if up == (1 - p) * size else (p + up / size, 0.0)
    return (0.0, q + down / other) if down == p * size else (p - down / size, 1.0)


def settled(row: list, p: float) -> list:
    """A row with its fraction made whole."""
    row[8] = int(row[8] or 0) + int(p > 0.5)
    row[6] = 0.0
    return row


def trade_with_rest(p: float, size: int, q: np.ndarray, sizes: np.ndarray, draw: float) -> tuple[float, np.ndarray] | None:
    """A fraction made whole by a trade of words with the first of ``q``, as few as can take as much: each gives or takes in
    proportion to its words and to how far it is from whole.  None if all of them can't.  Words and means stay."""
    room = np.minimum(q, 1 - q)
    most = np.cumsum(room * sizes)
    up, down = (1 - p) * size, p * size
    n = int(np.searchsorted(most, max(up, down) * (1 + 1e-9)))
    if n == len(q):
        return None
    room[n + 1 :] = 0
    taken = draw * (up + down) < down
    return (1.0, np.maximum(q - room * (up / most[n]), 0)) if taken else (0.0, np.minimum(q + room * (down / most[n]), 1))


def round_bucket(rows: list[list], last: bool) -> list[list]:
    """The rows of one bucket, largest first, all settled but one at most, and with ``last`` all of them.

    A row trades with the next smaller ones, as few as can make it whole, as long as there are enough; then the rest trade in
    pairs, the one that stays open going on to the next.  The last open row of a source has no one to trade with and is taken with the probability
    that it has come to.  So every row's mean stays what it was, and a source misses its target by less than the words of
    that one row, which is small where small rows are left to make larger ones whole.
    """
    out = [settled(r, 0.0) for r in rows if r[6] <= 0 or r[2] <= 0]
    rows = [r for r in rows if r[6] > 0 and r[2] > 0]
    sizes, q = np.array([r[2] for r in rows], float), np.array([r[6] for r in rows], float)
    at = 0
    while at + 1 < len(rows):
        if WHOLE < q[at] < 1 - WHOLE:
            made = trade_with_rest(q[at], sizes[at], q[at + 1 :], sizes[at + 1 :], rows[at][7])
            if made is None:
                break
            q[at], q[at + 1 :] = made
        out.append(settled(rows[at], q[at]))
        at += 1
    held = None
    for row, p in zip(rows[at:], q[at:].tolist()):
        row[6] = p
        if not WHOLE < p < 1 - WHOLE:
            out.append(settled(row, p))
        elif held is None:
            held = row
        else:
            held[6], row[6] = trade(held[6], held[2], row[6], row[2], row[7])
            still = [r for r in (held, row) if 0.0 < r[6] < 1.0]
            out += [settled(r, r[6]) for r in (held, row) if not 0.0 < r[6] < 1.0]
            held = still[0] if still else None
    if held is not None:
        out.append(settled(held, float(held[9] < held[6])) if last else held)
    return out


def _uniform(seed: int, step: int = 0) -> Column:
    """A number from 0 to 1 by a row's id and size, of its own for each step.

    The digest mixes better than xxhash64, whose values for neighbouring seeds go together.
    """
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"), F.lit(f"{seed}:{step}")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _round(last: bool):
    """Rows sorted by source and bucket, a bucket at a time; a bucket has about as many rows as the fan is wide."""

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, key = [], None
        for part in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in part.columns), strict=True)):
                if key != (row[1], row[5]):
                    out += round_bucket(bucket, last)
                    bucket, key = [], (row[1], row[5])
                bucket.append(row)
            yield batch(out)
        yield batch(round_bucket(bucket, last))

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, fan: int = 256, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target (of the source), copies, taken = copies * size.

    Sizes are words; null and empty texts have none and get no copy.  Null sources are a source.  All draws
    are hashes of ids, and buckets are dealt by hash, so neither partitions nor lost tasks change the result; rows that
    repeat id, source and size are interchangeable.  Buckets trade from the largest document to the smallest, so the one that
    stays open tends to be small.  A source of any size is dealt into buckets of about ``fan`` rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"))
    rows = written(rows, "sizes")
    targets = written(source_targets(rows, weights, share), "targets")
    buckets = F.ceil(F.col("n") / fan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = targets.withColumnRenamed("source", "_source")
    level = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "source", "size", "source_size", "target",
        F.pmod(F.xxhash64(F.col("id"), F.col("size"), F.lit(seed)), buckets).alias("bucket"),
        (rate - F.floor(rate)).alias("open"),
        F.lit(0.0).alias("draw"),
        F.floor(rate).cast("int").alias("copies"),
        _uniform(seed).alias("final"),
    )
    width = targets.agg(F.max(buckets)).first()[0] or 1
    done, depth = [], 0
    while True:
        dealt = level.withColumn("draw", _uniform(seed, depth + 1)).repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "draw", "id")
        out = written(dealt.select(*_NAMES).mapInArrow(_round(width == 1), _SCHEMA), f"level{depth}")
        done.append(out.where(F.col("open") == 0))
        if width == 1:
            break
        level = out.where(F.col("open") > 0).withColumn("bucket", F.floor(F.col("bucket") / fan))
        width, depth = -(-width // fan), depth + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    whole = whole.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    return whole.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
