import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing


def shared(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 3}, {"b": 0, "a": 7, "ä": 900, "Z": 44}, {str(i): i * i for i in range(30)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = shared(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_trades_keep_words_and_means():
    rng = random.Random(3)
    for _ in range(500):
        p, q, s, t = rng.random(), rng.random(), rng.randrange(1, 99), rng.randrange(1, 99)
        ends = [mixing.trade(p, s, q, t, d) for d in (0.0, 0.9999999)]
        for a, b in ends:
            assert abs(a * s + b * t - p * s - q * t) < 1e-9 and (a in (0, 1) or b in (0, 1)) and -1e-12 <= min(a, b) and max(a, b) <= 1 + 1e-12
    n, total = 40_000, [0.0, 0.0]
    for _ in range(n):
        a, b = mixing.trade(0.3, 10, 0.6, 4, rng.random())
        total[0] += a / n
        total[1] += b / n
    assert abs(total[0] - 0.3) < 0.01 and abs(total[1] - 0.6) < 0.01


def test_a_trade_with_the_rest_keeps_words_and_means():
    rng = np.random.default_rng(2)
    done = 0
    for _ in range(300):
        sizes, q, p, size = rng.integers(1, 50, 9).astype(float), rng.random(9), rng.random(), int(rng.integers(1, 90))
        ends = [mixing.trade_with_rest(p, size, q, sizes, d) for d in (0.0, 0.9999999)]
        if ends[0]:
            done += 1
            (one, low), (zero, high) = ends
            assert (one, zero) == (1.0, 0.0) and min(low.min(), high.min()) >= -1e-12 and max(low.max(), high.max()) <= 1 + 1e-12
            assert np.allclose(p * low + (1 - p) * high, q)
            assert all(abs(x * size + r @ sizes - p * size - q @ sizes) < 1e-9 for x, r in ends)
    assert 50 < done < 300


def rounded(sizes, fractions, fan, rng):
    """Copies of each row by the buckets and levels of a source, with draws of our own."""
    level = [[i, "s", n, 0, 0.0, rng.randrange(-(-len(sizes) // fan)), p, 0.0, 0, rng.random()] for i, (n, p) in enumerate(zip(sizes, fractions))]
    width, done = -(-len(sizes) // fan), []
    while True:
        buckets = defaultdict(list)
        for row in level:
            row[7] = rng.random()
            buckets[row[5]].append(row)
        out = [r for rows in buckets.values() for r in mixing.round_bucket(sorted(rows, key=lambda r: (-r[2], r[7])), width == 1)]
        done += [r for r in out if r[6] == 0]
        if width == 1:
            return {r[0]: r[8] for r in done}
        level = [r for r in out if r[6] > 0]
        for row in level:
            row[5] //= fan
        width = -(-width // fan)


@pytest.mark.parametrize("sizes, fraction, seeds", [([7], 0.3, 6000), ([1000] + [10] * 20, 0.1, 6000), ([3, 50, 4, 4, 900], 0.37, 6000), ([5] * 100, 0.37, 6000), ([1 + i * i % 700 for i in range(50)], 0.5, 6000), ([1 + i * 7919 % 1000 for i in range(5000)], 0.62, 300)])
def test_every_document_keeps_its_mean(sizes, fraction, seeds):
    """Also ties and single rows; words miss the target by less than the largest document, and by little where there are many."""
    rng = random.Random(len(sizes))
    total, miss = [0] * len(sizes), 0
    for _ in range(seeds):
        copies = rounded(sizes, [fraction] * len(sizes), 16, rng)
        assert len(copies) == len(sizes) and set(copies.values()) <= {0, 1}
        off = abs(sum(copies[i] * n for i, n in enumerate(sizes)) - fraction * sum(sizes))
        assert off < max(sizes)
        miss += off / seeds
        for i, c in copies.items():
            total[i] += c
    sigma = (fraction * (1 - fraction) / seeds) ** 0.5
    assert all(abs(t / seeds - fraction) < max(0.03 if seeds > 1000 else 0, 5 * sigma) for t in total)
    for some in (range(0, len(sizes), 2), sorted(range(len(sizes)), key=lambda i: sizes[i])[: len(sizes) // 4 or 1]):
        assert abs(sum(total[i] for i in some) / seeds / len(some) - fraction) < 0.03
    if len(sizes) >= 50:
        assert miss < 0.01 * sum(sizes)


def test_means_hold_over_seeds_on_spark(spark):
    df = spark.createDataFrame([(i, "w " * n, "s") for i, n in enumerate([100, *[4] * 9])] + [(50 + i, "w " * 7, "t") for i in range(3)], "doc_id long, text string, source string").repartition(1).cache()
    seeds = 60
    mean = lambda rows, some: sum(r["copies"] for r in rows if some(r["doc_id"])) / seeds / len({r["doc_id"] for r in rows if some(r["doc_id"])})
    rows = [r for seed in range(seeds) for r in mixing.mix(df, seed=seed, fan=4, share=0.4, weights=(1,)).select("doc_id", "copies", "target", "source_size").collect()]
    for low, high in ((0, 1), (1, 10), (50, 53)):
        want = next(r["target"] / r["source_size"] for r in rows if low <= r["doc_id"] < high)
        assert abs(mean(rows, lambda i: low <= i < high) - want) < 5 * (0.25 / seeds / (1 if high == 1 else 3)) ** 0.5


def test_query_results(spark, documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == 1000
    per = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] = r["target"]
    want = shared({s: x[0] for s, x in per.items()})
    for s, (_, taken, target) in per.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= 0.01 * target
    again = {tuple(r) for r in mixing.mix(documents.repartition(7, F.col("n_chars"))).collect()}
    assert again == {tuple(r) for r in rows}


def test_sizes_are_words(spark, documents):
    import re

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) for r in mixing.mix(documents).collect())


def test_deep_tree(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    out = mixing.mix(df, fan=4).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x")).collect()
    assert all(abs(r["t"] - r["x"]) <= 8 for r in out)


def test_awkward_rows(awkward, nothing):
    out = mixing.mix(awkward)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r["size"] == r["taken"] == r["copies"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.mix(nothing).count() == 0
