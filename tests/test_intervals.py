"""The interval join by dyadic levels against every pair, and that a wide span is few rows."""

import random

from pyspark.sql import functions as F

from graphloom.operators import reads


def tables(spark, spans, points):
    return (
        spark.createDataFrame(spans, "k string, span_id long, start long, `end` long"),
        spark.createDataFrame(points, "k string, point_id long, at long"),
    )


def test_against_every_pair(spark):
    rng = random.Random(1)
    spans, points = [], []
    for i in range(400):
        start = rng.randrange(-2000, 2000)
        spans.append((rng.choice("ab"), i, start, start + rng.choice([-1, 0, 1, 2, 3, 7, 8, 64, rng.randrange(3000), 1 << 40])))
        points.append((rng.choice("abc"), i, rng.randrange(-2100, 2100)))
    spans += [("a", 1000, None, 5), ("a", 1001, 5, None), (None, 1002, 0, 5), ("b", 1003, -(1 << 61), 1 << 61)]
    points += [("a", 1000, None), (None, 1001, 3)]
    want = {}
    for key, p, at in points:
        held = [(e - s, i) for k, i, s, e in spans if k == key and None not in (k, s, e, at) and s <= at <= e]
        if held:
            want[p] = min(held)[1]
    got = {r["point_id"]: r["span_id"] for r in reads.innermost(*tables(spark, spans, points), "k").collect()}
    assert got == want and len(want) > 200


def test_rows_do_not_follow_the_width(spark):
    """A span of a trillion places is listed at most twice, where buckets of one width would list it a billion times."""
    spans, points = tables(spark, [("a", i, i, i + (1 << 40)) for i in range(1000)], [("a", i, i) for i in range(50)])
    found = reads.innermost(spans, points, "k")
    assert {r["point_id"]: r["span_id"] for r in found.collect()} == {i: 0 for i in range(50)}
    listed = spans.withColumn("_level", F.length(F.bin(F.col("end") - F.col("start"))).cast("int")).select(F.array_distinct(F.array(reads._bucket("start"), reads._bucket("end"))).alias("b"))
    assert listed.agg(F.max(F.size("b"))).first()[0] <= 2


def test_empty(spark):
    spans, points = tables(spark, [], [("a", 1, 1)])
    assert reads.innermost(spans, points, "k").collect() == []
