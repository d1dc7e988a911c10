"""Quality classifier from positives and unlabelled text, by non-negative unbiased risk.

The score is logistic in piecewise linear functions of a text's statistics.  With the logistic loss, the risk of positives
counted as negatives folds into a linear term, so the unbiased risk is convex: prior * E_p[-g] + E_u[softplus(g)].  Newton
steps minimise it over all rows; each step sums gradients and second derivatives inside the partitions and then over a
fixed number of slots, so the driver gets a fixed amount.  The part that stands for the negatives' risk can't be negative;
where it is, the next step raises that part alone, as the non-negative estimator does.  The class prior is estimated from
the same two kinds of rows, and no label but the positive one is ever used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty, written
from graphloom.llm.outliers import text_counts

#: Statistics of a text, each on its own scale, and the knots between which the score is linear in them.
RATIO_KNOTS = (0.0, 0.4, 0.8, 1.4, 2.2, 3.2, 4.7)
KNOTS = {"length": (0, 2, 3, 4, 5, 6.5, 10), "word_length": (0, 1.0, 1.4, 1.6, 1.8, 2.1, 3.0)} | {n: RATIO_KNOTS for n in ("symbols", "capitals", "repeats", "dup_lines", "distinct", "marks", "numbers")}
SLOTS = 32


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and one column for each of ``KNOTS``."""
    text = text_or_empty(text_col)
    extra = [
        F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).alias("_marks"),
        F.regexp_count(text, F.lit("[0-9]")).alias("_digits"),
        F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))).alias("_distinct"),
    ]
    counted = text_counts(docs, text, [F.col(id_col).cast("long").alias("id"), *extra])
    per = lambda part, whole: F.log1p(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return counted.select(
        "id",
        F.log1p("n_words").alias("length"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))).alias("word_length"),
        per("n_symbols", "n_words").alias("symbols"),
        per("n_capitals", "word_chars").alias("capitals"),
        per("n_repeat_words", "n_words").alias("repeats"),
        per("n_dup_lines", "n_lines").alias("dup_lines"),
        per("_distinct", "n_words").alias("distinct"),
        per("_marks", "word_chars").alias("marks"),
        per("_digits", "word_chars").alias("numbers"),
    )


def basis(columns: list[np.ndarray]) -> np.ndarray:
    """1 and, for each statistic, hat functions on its knots (the first is left out; the last goes on level)."""
    out = [np.ones(len(columns[0]))]
    for x, knots in zip(columns, KNOTS.values(), strict=True):
        for i in range(1, len(knots)):
            ys = np.zeros(len(knots))
            ys[i] = 1
            out.append(np.interp(x, knots, ys))
    return np.stack(out, axis=1)


HEAD = 4
WIDTH = 1 + sum(len(k) - 1 for k in KNOTS.values())


def _sums(weights: np.ndarray):
    """Per partition: numbers of unlabelled and positive rows, and sums of softplus, of the basis and of derivatives."""

    def run(batches):
        total = np.zeros(HEAD + WIDTH * 3 + WIDTH * WIDTH)
        for batch in batches:
            x = basis([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            positive = batch.columns[-1].to_numpy(zero_copy_only=False).astype(bool)
            g = x @ weights
            s = 1 / (1 + np.exp(-g))
            xp, gp = x[positive], g[positive]
            total += np.concatenate(([len(x), len(xp), np.logaddexp(0, g).sum(), np.logaddexp(0, gp).sum()], xp.sum(axis=0), xp.T @ s[positive], x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _add(batches):
    total = 0
    for batch in batches:
        for data in batch.column(0).to_pylist():
            total = total + np.frombuffer(data)
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _collect(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The sums over all rows; the driver gets at most ``SLOTS`` of them."""
    parts = rows.mapInArrow(_sums(weights), "sums binary")
    slots = parts.withColumn("slot", F.spark_partition_id() % SLOTS).repartition(SLOTS, "slot").select("sums").mapInArrow(_add, "sums binary").collect()
    return sum((np.frombuffer(r["sums"]) for r in slots), np.zeros(HEAD + WIDTH * 3 + WIDTH * WIDTH))


class Scorer:
    """A fitted score: the probability of a positive, by the prior that it was fitted with."""

    def __init__(self, weights: np.ndarray, prior: float, risk: float):
        self.weights, self.prior, self.risk = weights, prior, risk

    def score(self, stats: DataFrame, id_col: str) -> DataFrame:
        return self.logit(stats.select("id", *KNOTS)).select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.col("logit")))).alias("score"))

    def logit(self, stats: DataFrame) -> DataFrame:
        """The first column of ``stats`` as id, which the other ones give a logit."""
        weights = self.weights

        def run(batches):
            for batch in batches:
                g = basis([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) @ weights
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g)], ["id", "logit"])

        return stats.mapInArrow(run, f"id {stats.schema[0].dataType.simpleString()}, logit double")


def class_prior(logits: DataFrame, width: float = 0.125, most: float = 40.0, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Share of positives in unlabelled text, from rows of (positive, logit): the best bin estimate.

    Above any bound there are at least prior * (share of the positives above) of all rows, and equal where no negative is.
    So the least ratio of the two shares estimates the prior; the bound is chosen with an allowance for chance, which keeps
    it from bounds that few rows exceed.  Logits are counted in bins of ``width`` up to ``most``, so the driver gets a fixed
    number of counts.
    """
    place = F.floor(F.greatest(F.least("logit", F.lit(most)), F.lit(-most)) / width).alias("bin")
    counts = logits.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("m")).orderBy(F.desc("bin")).collect()
    n, m = (np.cumsum([r[c] for r in counts]) for c in ("n", "m"))
    if not len(n) or not m[-1]:
        return 0.5
    above, good = n / n[-1], np.maximum(m / m[-1], 1e-12)
    chance = sum(np.sqrt(np.log(4 / delta) / (2 * k[-1])) for k in (n, m))
    at = np.argmin((above + (1 + gamma) * chance) / good)
    return float(min(max(above[at] / good[at], 0.02), 0.98))


def fit(rows: DataFrame, prior: float, steps: int = 16, strength: float = 10.0, least: float = 3e-4) -> Scorer:
    """``rows``: the statistics and ``positive``; every row counts as unlabelled, and the positives also as such.

    The ridge penalty is ``strength`` rows' worth, but ``least`` at least.  The negatives' part may fall below 0 by what
    chance explains for so many positives before a step corrects it.
    """
    weights = np.zeros(WIDTH)
    penalty, best = None, None
    rate = 1.0
    for _ in range(steps):
        sums = _collect(rows.select(*KNOTS, "positive"), weights)
        n, m = sums[0], max(sums[1], 1)
        if not n:
            break
        xp, sp, su = (sums[HEAD + i * WIDTH : HEAD + (i + 1) * WIDTH] / k for i, k in enumerate((m, m, n)))
        xx = sums[HEAD + 3 * WIDTH :].reshape(WIDTH, WIDTH) / n
        negative = sums[2] / n - prior * sums[3] / m
        if penalty is None:
            penalty = np.full(WIDTH, max(least, strength / n))
            penalty[0] = 0
        if negative < -0.5 / m**0.5:
            weights = weights + 0.5 * (su - prior * sp) / max(np.abs(su - prior * sp).max(), 1e-9)
            continue
        # softplus(-g) = softplus(g) - g: the positives' two losses leave a linear term.
        risk = prior * (sums[3] / m - xp @ weights) + negative + (penalty * weights**2).sum() / 2
        if best is not None and risk > best[0] - 1e-7:
            if risk <= best[0] + 1e-9 or rate < 1 / 16:
                break
            rate /= 2
            weights = best[1] - rate * best[2]
            continue
        gradient = su - prior * xp + penalty * weights
        step = np.linalg.solve(xx + np.diag(penalty) + 1e-9 * np.eye(WIDTH), gradient)
        best = (risk, weights, step)
        rate = min(1.0, rate * 2, 8 / max(np.abs(step).max(), 1e-9))
        weights = weights - rate * step
    if best is None:  # every step was a correction
        return Scorer(weights, prior, float("nan"))
    return Scorer(best[1], prior, best[0])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Rows whose id has fold 0 are held out: their labels are never seen.  Of the others, label 1 makes a trusted positive;
    label 0 is not used at all.  All documents are the unlabelled text.  A first fit, with a prior of one half, orders the
    rows; the prior is estimated along that order, and the fit with it gives the scores.
    Without any positive the score is 0.5.  Null and empty texts have
    statistics of 0 and a score like others; a null id is not held out and has no label; repeated ids repeat their score;
    where a document has several labels the largest counts.  Other columns are not read.
    """
    stats = written(statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("_lid"), F.col(label_col).cast("int").alias("_label")).where((F.col("_label") == 1) & (fold(F.col("_lid")) != 0))
    known = known.select("_lid").distinct()
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))
    rows = written(stats.join(known, F.col("id") == F.col("_lid"), "left").select(F.col("_lid").isNotNull().alias("positive"), *KNOTS), "rows")
    if rows.where("positive").isEmpty():
        scored = stats.select(F.col("id").alias(id_col), F.lit(0.5).alias("score"))
    else:
        order = fit(rows, 0.5)
        scored = fit(rows, class_prior(order.logit(rows).withColumnRenamed("id", "positive"))).score(stats, id_col)
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
