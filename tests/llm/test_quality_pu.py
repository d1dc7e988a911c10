import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import quality_pu, queries


def test_held_out_accuracy(spark, small):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, small).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([p == y for y, _, p in held]) > 0.95


def test_held_out_labels_are_not_seen(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_pu.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_pu.quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b])


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 0, 0), (None, 1, 1), (2, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_pu.quality_scores(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_pu.quality_scores(nothing, labels).count() == 0
    none = quality_pu.quality_scores(awkward, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_basis():
    x = quality_pu.basis([np.array([0.0, 1.0, 99.0])] * len(quality_pu.KNOTS))
    assert x.shape == (3, quality_pu.WIDTH) and (x[0, 1:7] == 0).all() and x[2, 6] == 1


def made_rows(spark, n=1500, prior=0.6, known=0.4, seed=3, means=(0.35, 0.6)):
    """Statistics of two kinds of texts that overlap, and which of the good ones are trusted."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < prior
    columns = {name: np.clip(rng.normal(np.where(good, *means) * knots[-1], 0.12 * knots[-1]), 0, knots[-1]) for name, knots in quality_pu.KNOTS.items()}
    positive = good & (rng.random(n) < known)
    data = [(bool(positive[i]), *(float(c[i]) for c in columns.values())) for i in range(n)]
    return spark.createDataFrame(data, "positive boolean, " + ", ".join(f"{k} double" for k in columns)), columns, positive


def test_fit_against_brute_force(spark):
    """The same risk, minimised by plain Newton steps with a line search."""
    rows, columns, positive = made_rows(spark, means=(0.45, 0.5))  # the negatives' part stays above 0
    scorer = quality_pu.fit(rows, 0.6)
    x, n = quality_pu.basis(list(columns.values())), len(positive)
    penalty = np.full(x.shape[1], max(3e-4, 10 / n))
    penalty[0] = 0
    risk = lambda w: 0.6 * -(x[positive] @ w).mean() + np.logaddexp(0, x @ w).mean() + (penalty * w**2).sum() / 2
    w = np.zeros(x.shape[1])
    for _ in range(200):
        s = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ s / n - 0.6 * x[positive].mean(axis=0) + penalty * w
        step = np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x / n + np.diag(penalty) + 1e-9 * np.eye(len(w)), gradient)
        rate = 1.0
        while risk(w - rate * step) > risk(w) and rate > 1e-9:
            rate /= 2
        w = w - rate * step
    assert abs(scorer.risk - risk(w)) < 1e-4
    assert np.abs(1 / (1 + np.exp(-x @ scorer.weights)) - 1 / (1 + np.exp(-x @ w))).max() < 0.03


def test_prior_is_estimated_without_negatives(spark):
    for prior in (0.3, 0.8):
        rows, columns, positive = made_rows(spark, prior=prior)
        order = quality_pu.fit(rows, 0.5)
        logits = order.logit(rows).withColumnRenamed("id", "positive")
        g = quality_pu.basis(list(columns.values())) @ order.weights
        best = min((sum(g >= t) / len(g) + 1.01 * chance) / (sum(g[positive] >= t) / positive.sum()) for t in np.floor(g * 8) / 8 for chance in [np.sqrt(np.log(40) / (2 * len(g))) + np.sqrt(np.log(40) / (2 * positive.sum()))] if sum(g[positive] >= t))
        got = quality_pu.class_prior(logits)
        assert abs(got - prior) < 0.1 and got < best


def test_label_0_is_not_used(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    a, b = (quality_pu.quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, labels.where("quality = 1")))
    assert np.allclose([r["score"] for r in a], [r["score"] for r in b])
